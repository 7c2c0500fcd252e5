"""Operators with exact contracts against plain Python, on odd rows and on the small tables."""

import hashlib
import os
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnish.llm import queries, simhash
from tarnish.llm.components import components
from tarnish.llm.decontaminate import SuffixAutomaton, decontaminate, merged
from tarnish.llm.fertility import base_counts
from tarnish.llm.licenses import scan_licenses
from tarnish.llm.line_dedup import drop_repeated_lines
from tarnish.llm.packing import Tokenizer, deal, pack, special_tokens
from tarnish.llm.simhash import links, near_copies, near_duplicates
from tests.llm import plain

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def known(spark, sf=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def with_digest(df):
    return df.withColumn("d", F.sha2("kept_text", 256))


def test_lines(table, made):
    got = rows(with_digest(drop_repeated_lines(table)), "doc_id", "n_lines", "n_dropped", "d")
    want = sorted(plain.line_dedup(made), key=repr)
    assert got == want and any(w[2] for w in want)


def test_lines_keep_other_columns_and_nulls(spark, table, empty):
    assert set(drop_repeated_lines(table).columns) == {*table.columns, "n_lines", "n_dropped", "kept_text"}
    assert drop_repeated_lines(empty).count() == 0
    line = "a line that is certainly longer than forty characters"
    docs = spark.createDataFrame([(None, line), (None, line)] + [(k, line) for k in range(4)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in drop_repeated_lines(docs).collect()}
    assert got == {None: 1, 0: 1, 1: 1, 2: 1, 3: 0}


def bench_items(made):
    long = made[5][1].split()
    return [(1, " ".join(long[:20])), (2, " ".join(long[4:24]).upper()), (3, "changed"), (4, "tail two blanks"), (5, None), (6, "..."), (7, " ".join(long[:14]))]


@pytest.mark.parametrize("block_words", [200_000, 2])
def test_contamination(spark, table, made, block_words):
    items = bench_items(made)
    bench = spark.createDataFrame([*items, (None, "x"), items[0]], "item_id long, text string")
    found = decontaminate(table, bench, block_words=block_words)
    got = rows(found.withColumn("d", F.sha2(F.array_join("item_ids", ","), 256)), "doc_id", "n_words", "n_hit", "n_items", "d", "contaminated")
    want = sorted(plain.contamination(made, items), key=repr)
    assert got == want and any(w[5] for w in want)
    text = dict(made)
    for r in found.filter("n_hit = 0").collect():
        assert r["clean_text"] == text[r["doc_id"]]


def test_contamination_random():
    import random

    rng = random.Random(1)
    for _ in range(150):
        items = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 9))]) for k in range(rng.randint(1, 5))]
        doc = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(rng.randint(0, 40))]
        spans, found = SuffixAutomaton(items, 4).match(doc)
        hit = {k for a, b in spans for k in range(a, b)}
        want = plain.contamination([(0, b" ".join(doc).decode())], [(i, b" ".join(w).decode()) for i, w in items], 4)[0]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (len(hit), len(found), digest) == want[2:5]
    assert merged([(3, 5), (1, 3), (8, 9)]) == [(1, 5), (8, 9)]


def test_contamination_without_items(spark, table, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(table, none).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate(empty, none).count() == 0


def test_simhash(table, made, empty):
    got = near_duplicates(table)
    prints = {d: plain.simhash(t, xxhash) for d, t in made}
    roots = plain.components(prints)
    want = sorted([(d, prints[d] - (1 << 64) * (prints[d] >> 63), roots[d]) for d, _ in made], key=repr)
    assert rows(got, "doc_id", "fp", "component_id") == want
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [2, 8, 100_000])
def test_links_in_crowded_buckets(spark, bucket):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = set()
    while len(prints) < 400:
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x - (1 << 64) * (x >> 63))
    found = {r["node"]: r["root"] for r in components(links(spark.createDataFrame([(p,) for p in prints], "fp long"), bucket=bucket)).collect()}
    want = plain.components({p: p & (1 << 64) - 1 for p in prints})
    assert {p: found.get(p, p) for p in prints} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(50, 51), (60, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 51: 50}


def test_near_copies(spark, empty):
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(2000)]
    docs, group = [], {}
    for g in range(12):
        base = rng.choices(words, k=200)
        for k in range(6):
            text = list(base)
            if k:
                text[rng.randrange(200)] = f"new{g}x{k}"
            docs.append((g * 10 + k, " ".join(text)))
            group[g * 10 + k] = g
    docs += [(500, None), (501, ""), docs[0], (None, docs[0][1])]
    found = near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    kept = [r["doc_id"] for r in found if r["kept"]]
    assert {k for k in kept if k in group} == {g * 10 for g in range(12)}
    assert 500 in kept and 501 not in kept and None not in kept
    by = {}
    for r in found:
        if r["doc_id"] in group:
            by.setdefault(r["component"], set()).add(group[r["doc_id"]])
    assert all(len(v) == 1 for v in by.values())
    assert near_copies(empty).count() == 0


def shingle_groups(docs, similarity=0.8):
    """Group of each text by brute force over all pairs of sets of five-word shingles."""
    sets = {}
    for d, text in docs:
        w = text.split()
        sets[d] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for u in sets:
        for v in sets:
            shared = len(sets[u] & sets[v])
            if v < u and shared >= similarity * (len(sets[u]) + len(sets[v]) - shared) - 1e-9:
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def edited(rng, base, edits, name):
    """`base` with `edits` words changed, each in another stretch, so that each changes five shingles."""
    text = list(base)
    for at in rng.sample(range(2, len(base) // 5 - 1), edits):
        text[5 * at] = f"{name}e{at}"
    return text


def test_near_copies_amid_shared_passages(spark, monkeypatch):
    """Most texts hold one of two passages; their hashes go last, and the groups are those of brute force."""
    import random

    from tarnish.llm import simhash

    monkeypatch.setattr(simhash, "CROWD", 5)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(12)
    passages = [[f"p{k}w{j}" for j in range(40)] for k in range(2)]
    docs = []
    for g in range(40):
        base = rng.choices([f"w{k}" for k in range(3000)], k=rng.randint(20, 120))
        base = [*base, *passages[g % 2]] if g % 5 else base
        docs.append((g * 10, " ".join(base)))
        docs += [(g * 10 + k, " ".join(edited(rng, base, min(rng.randint(1, 5), len(base) // 5 - 3), f"g{g}k{k}"))) for k in range(1, rng.randint(2, 4)) if len(base) > 40]
    docs += [(1000 + k, " ".join(passages[0][: 36 + k])) for k in range(4)]
    want = shingle_groups(docs)
    found = near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found if r["kept"]) == sorted(set(want.values()))


@pytest.mark.parametrize("block", [8, 256])
def test_near_copies_of_one_base_are_all_found(spark, monkeypatch, block):
    """Each copy is near the base (at least 0.8) and, mostly, not near another copy."""
    import random

    from tarnish.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(9)
    docs = []
    for g, copies in enumerate((9, 14, 40)):
        base = rng.choices([f"w{k}" for k in range(3000)], k=200)
        docs += [(g * 100 + k, " ".join(edited(rng, base, 4, f"g{g}k{k}"))) for k in range(copies)] + [(g * 100 + 99, " ".join(base))]
    want = shingle_groups(docs)
    assert len(set(want.values())) == 3
    found = near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found if r["kept"]) == sorted(set(want.values()))


def test_near_copies_are_those_of_the_exact_similarity(spark):
    """Pairs on both sides of the threshold, and chains of them, as brute force has them."""
    import random

    rng = random.Random(10)
    docs = []
    for g in range(60):
        base = rng.choices([f"w{k}" for k in range(3000)], k=rng.randint(120, 260))
        docs += [(g * 10, " ".join(base))]
        docs += [(g * 10 + k, " ".join(edited(rng, base, rng.randint(3, 7), f"g{g}k{k}"))) for k in range(1, rng.randint(2, 5))]
    want = shingle_groups(docs)
    found = {r["doc_id"]: r for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d for d, r in found.items() if r["kept"]} == set(want.values())
    groups = {}
    for d, r in found.items():
        groups.setdefault(r["component"], set()).add(want[d])
    assert all(len(g) == 1 for g in groups.values())


def test_borderline_copies_and_a_common_passage_make_few_pairs(spark, monkeypatch):
    """300 copies of one text, no two of them near, and a passage in 300 other texts: hardly any pair is made, and no group is lost."""
    import random

    from tarnish.llm import simhash

    made, pairs = [], simhash._pairs

    def counted(*a):
        made.append(pairs(*a).count())
        return pairs(*a)

    monkeypatch.setattr(simhash, "_pairs", counted)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    base, passage = rng.choices(words, k=130), rng.choices(words, k=45)
    docs = [(k, " ".join(edited(rng, base, 6, f"k{k}"))) for k in range(300)]
    docs += [(1000 + k, " ".join(rng.choices(words, k=25) + passage)) for k in range(300)] + [(2000, " ".join(base))]
    want = shingle_groups(docs)
    found = near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"] for r in found if r["kept"]} == set(want.values())
    assert made[0] < 3000


def test_simhash_links_are_near_copies(spark, made):
    """With `max_bits`, every group of operator 8 stays in one group, beside the exact one."""
    docs = spark.createDataFrame(made, "doc_id long, text string")
    linked = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    want = shingle_groups([(d, (t or "").lower()) for d, t in made])
    exact = {r["doc_id"]: r["component"] for r in near_copies(docs).collect()}
    both = {r["doc_id"]: r["component"] for r in near_copies(docs, max_bits=2).collect()}
    assert all(both[d] == both[c] for d, c in linked.items())
    assert all(both[d] == both[e] for d in both for e in both if exact[d] == exact[e])
    assert len(set(both.values())) <= len(set(exact.values())) <= len(set(want.values())) + 1
    lone = [(1, "a b c " * 30 + "x1 x2"), (2, "a b c " * 30 + "y1 y2")]  # the same but for the end: a similarity below 0.8
    found = {m: near_copies(spark.createDataFrame(lone, "doc_id long, text string"), max_bits=m).filter("kept").count() for m in (None, 2)}
    assert found == {None: 2, 2: 1}


def token_ids(text):
    from tokenizers import Tokenizer as Reference

    reference = Reference.from_file(public.path("byte_bpe_50k.json"))
    return reference.encode(text or "", add_special_tokens=False).ids


def test_token_cache_is_exact(made):
    tokens = Tokenizer(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, special_tokens(public.path("byte_bpe_50k.json")))
    extra = [" lead", "trail ", "two  blanks", "a\n b", "a \nb", "a\n\nb c", "it's don't", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b <|endoftext|> ", "a\xa0b c", "\x1c a", "12 34,5"]
    for text in [t for _, t in made if t and len(t) < 5000] + extra:
        for _ in range(2):
            assert list(memoryview(tokens.ids(text)).cast("I")) == token_ids(text)


def test_a_text_is_encoded_in_one_call():
    tokens = Tokenizer(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    plain_encode, calls = tokens.encode, []
    tokens.encode = lambda text: calls.append(text) or plain_encode(text)
    text = " ".join(f"word{k}" for k in range(500))
    assert list(memoryview(tokens.ids(text)).cast("I")) == plain_encode(text)
    assert calls == [text] and not [v for v in vars(tokens).values() if isinstance(v, dict) and v]


@pytest.mark.parametrize("block_docs", [8192, 10])
def test_packing(table, made, block_docs):
    got = pack(table, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, with_ids=True, block_docs=block_docs).collect()
    ids = {d: token_ids(t) + [0] for d, t in made}
    pieces, sequences = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    twice = {made[-1][0]}
    for d, found in pieces.items():
        assert sum(n for _, n in found) == len(ids[d]) * (2 if d in twice else 1)
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 1024
    short = sum(sum(n for _, n in f) < 1024 for f in sequences.values())
    assert short <= 3 * (1 + len(made) // block_docs)


def test_deal_takes_the_cheapest_sequence_with_room():
    import numpy as np

    pieces = deal(np.array([6, 5, 4, 1]), 8, 1.0, 1.0)
    assert pieces == [(0, 0, 6, 0, 0), (1, 0, 5, 1, 0), (2, 0, 3, 1, 5), (2, 3, 1, 0, 6), (3, 0, 1, 0, 7)]
    assert deal(np.array([], int), 8, 1.0, 1.0) == []


def test_licenses(table, made, empty):
    texts = [(3001, "x\nReleased under the MIT License."), (3002, "Licensed under CC BY-NC 4.0. And the GNU General public-license; apache\nlicense"), (3003, None)]
    docs = table.sparkSession.createDataFrame(texts + made, "doc_id long, text string")
    found = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    for doc, text in texts + made:
        r = found[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain.license_base(text)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert found[3002]["labels"] == "apache,cc-by,cc-by-nc,gpl" and scan_licenses(empty).count() == 0
    assert {*scan_licenses(table).columns} >= {"score", "labels", "n_words", "blocks", "lang"}


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files"
    gpl = "This program is free software: you can redistribute it and/or\n * modify it under the terms of the GNU General\n * Public License as published by the Free Software Foundation"
    filler = "\n".join(f"word{k} and word{k + 1}" for k in range(40))
    texts = [(1, mit), (2, f"{filler}\n{mit}\n{filler}"), (3, gpl), (4, filler), (5, "head\nReleased under the MIT License\ntail"), (6, mit.replace("\n", " "))]
    found = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [found[k]["labels"] for k in range(1, 7)] == ["mit", "mit", "gpl", "", "mit", "mit"]
    assert all(b["line"] is None for k in (1, 2) for b in found[k]["blocks"]) and found[2]["score"] == 1.0
    assert {b["line"] for b in found[5]["blocks"]} == {1, None} and [b["line"] for b in found[6]["blocks"]] == [0]


def test_labels_are_told_apart(spark):
    notices = {
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "agpl": "Licensed under the GNU Affero General Public License, version 3.",
        "lgpl": "licensed under the GNU Lesser General Public License, version 2.1",
        "cc-by-nc": "licensed under CC BY-NC 4.0", "cc-by-sa": "Licensed under CC BY-SA 4.0.", "cc-by-nc-sa": "licensed under CC BY-NC-SA 4.0",
        "cc-by-nc-nd": "Licensed under CC-BY-NC-ND 4.0", "mit": "Released under the MIT License", "apache": "Licensed under the Apache License, Version 2.0",
        "": "Released under the license. You may use it under the terms of the public license, version 3.",
    }
    base = {"gpl": "gpl", "lgpl": "", "agpl": "", "mit": "mit", "apache": "apache"}
    docs = spark.createDataFrame([(k, f"Some words before.\n{t}\nand after") for k, t in enumerate(notices.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(docs).collect()}
    for k, label in enumerate(notices):
        phrase = base.get(label, "cc-by" if label.startswith("cc-by") else "")
        assert got[k] == ",".join(sorted({label, phrase} - {""})), label


def test_license_join_finds_every_block():
    import random

    from tarnish.llm.licenses import TemplateIndex

    rng = random.Random(4)
    letters = "abcdefghijkl"
    templates = [(str(k), " ".join(rng.choices(letters, k=rng.randint(1, 9)))) for k in range(20)]
    index = TemplateIndex(templates, {c.encode(): rng.randint(0, 50) for c in letters}, 0.8)
    for _ in range(300):
        block = [c.encode() for c in rng.choices(letters + "xyz", k=rng.randint(0, 14))]
        want = []
        for label, text in templates:
            words = {w.encode() for w in text.split()}
            if len(words & set(block)) >= 0.8 * len(words) - 1e-9:
                want.append((label, len(words & set(block)) / len(words)))
        assert sorted(index.search(block)) == sorted(want)


@pytest.mark.parametrize("start", [0, 1 << 21])
def test_rule_counts(made, start):
    """Also with word numbers of which three do not fit 64 bits."""
    for text in [t for _, t in made] + ["a b c a b c", "#x |y| <z>\n\n#x |y| <z>\n \n", "a a a a"]:
        data = (text or "").encode()
        number = {w: start + k for k, w in enumerate(dict.fromkeys(data.split()))}
        words = np.array([number[w] for w in data.split()], np.int64)
        assert (len(words), *base_counts(data, words)) == plain.rule_counts(text)


@tables
def test_queries_on_small_tables(spark):
    docs = known(spark)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op6_decontaminate"](spark, SF)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(plain.contamination(docs, items), key=repr)
    prints = {d: plain.simhash(t, xxhash) for d, t in docs}
    roots = plain.components(prints)
    got = queries.QUERIES["op8_simhash_dedup"](spark, SF)
    assert rows(got, "doc_id", "fingerprint", "component_id") == sorted([(d, f"{prints[d]:016x}", roots[d]) for d, _ in docs], key=repr)
    got = queries.QUERIES["op9_licenses"](spark, SF)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted([(d, *plain.license_base(t)) for d, t in docs], key=repr)
    got = queries.QUERIES["op4_tokenizer_rules"](spark, SF)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted([(d, *plain.rule_counts(t)) for d, t in docs], key=repr)
    got = queries.QUERIES["op10_line_dedup"](spark, SF)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(plain.line_dedup(docs), key=repr)


def test_parity_bits_never_outnumber_hashes_of_one_set():
    random = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 700, 3000):
        one = np.unique(random.integers(-(2**63), 2**63 - 1, n))
        other = np.unique(np.concatenate([one[: int(0.9 * n)], random.integers(-(2**63), 2**63 - 1, n // 9 + 1)]))
        a, b = simhash.parity(one).view(np.uint64), simhash.parity(other).view(np.uint64)
        least = min(len(a), len(b))
        a, b = (p if len(p) == least else p[:least] ^ p[least:] for p in (a, b))
        assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(one, other))
    assert not simhash.parity(np.zeros(0, np.int64)).any()
