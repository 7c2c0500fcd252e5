"""Plain Python versions of the contracts, written without the operators' code."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(FOLD)


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def line_dedup(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
            if len(key) >= min_chars:
                holders[key].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(line.strip(" \t\n\x0b\x0c\r").translate(FOLD), ())
            if len(held) < min_docs or doc == max(held):
                kept.append(line)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc, len(lines), len(lines) - len(kept), digest))
    return out


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(low(text))
        if words:
            size = min(window, len(words))
            for k in range(len(words) - size + 1):
                windows[tuple(words[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = ALNUM.findall(low(text)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (items_ := windows.get(tuple(words[k : k + size]))):
                    hit.update(range(k, k + size))
                    found |= items_
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def simhash(text, xxhash, width=3):
    words = SPACED.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    """Smallest reachable id by id, for {id: fingerprint}."""
    left, out = set(prints), {}
    for root in sorted(prints):
        if root not in left:
            continue
        queue = [root]
        left.discard(root)
        while queue:
            at = queue.pop()
            out[at] = root
            near = [x for x in left if (prints[x] ^ prints[at]).bit_count() <= bits]
            left.difference_update(near)
            queue += near
    return out


def base_scores(docs, n=10):
    counts = Counter()
    tokens = {}
    for doc, text in docs:
        tokens[doc] = [*SPACED.findall(low(text)), None]
        if crc(doc, n):
            counts.update(tokens[doc])
    total, types = sum(counts.values()), len(counts)
    norm = math.log10(total + 0.1 * (types + 1))
    return {
        d: (len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10(counts[w] + 0.1) - norm for w in t)) for d, t in tokens.items()
    }


def rule_counts(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


def license_base(text):
    words = ALNUM.findall(low(text))
    found = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))
