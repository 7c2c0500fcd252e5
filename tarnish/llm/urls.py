"""Operator 7: URL filter by rules, host word segmentation and multinomial naive Bayes.

Rules decide the URLs they fit. For all URLs, names in the host and the path are split into words by
Viterbi search under a unigram model of the words that the pages themselves use. URLs with words of a
seed list are the block class of a naive Bayes model, all others the allow class; words that keep
company with seeds then block URLs without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.frequent import least_count
from tarnish.llm.text import map_rows, without
from tarnish.session import stage

# Rules (verdict, host and path), words of unwanted sites, and names that say nothing.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SEEDS = (
    "ad ads adult bet bets betting bonus casino cheap click crack download escort free gamble gambling hack hot jackpot "
    "keygen loan loans lottery nude pharma pharmacy pill pills poker porn prize replica sex sexy slots spam torrent track "
    "tracker tracking viagra warez win winner xxx"
).split()
SILENT = frozenset("www m blog com net org html htm php index example".split())
ADDED = ("host", "path", "rule", "verdict", "words", "log_odds")
LETTERS = re.compile(r"[^\W\d_]+")
TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
FLUSH = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    ordered = sorted((r for _, r in rules), key=lambda r: (-len(r), r))
    fits = []
    for rule in ordered:
        name, slash, rest = rule.partition("/")
        test = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(test, F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


class _WordCounts:
    """Words of pages with their counts; partial counts leave when there are many."""

    def __init__(self):
        self.counts: Counter[str] = Counter()

    def __call__(self, rows):
        for html in rows["html"]:
            if html:
                self.counts.update(LETTERS.findall(TAG.sub(" ", html).lower()))
        return self.flush() if len(self.counts) > FLUSH else None

    def flush(self):
        out = {"word": list(self.counts), "n": list(self.counts.values())}
        self.counts = Counter()
        return out


class Segmenter:
    """Most probable split of a name into words under a unigram model."""

    LONGEST = 24
    CACHE = 100_000

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.total = total
        self.logs = {w: math.log(n / total) for w, n in counts.items() if len(w) <= self.LONGEST}
        self.unknown = -math.log(total)
        self.cache: dict[str, list[str]] = {}

    def _log(self, word: str, rare: dict[str, int] | None = None) -> float:
        known = self.logs.get(word)
        if known is None:
            n = rare and rare.get(word)
            # An unknown word costs more with every letter, so known words win where they fit.
            known = math.log(n / self.total) if n else self.unknown - 2.5 * len(word)
        return known

    def __call__(self, name: str, rare: dict[str, int] | None = None) -> list[str]:
        """The words of `name`; `rare` are the counts of those of its stretches that the head does not hold."""
        found = self.cache.get(name)
        if found is None:
            best, back = [0.0], [0]
            for stop in range(1, len(name) + 1):
                score, start = max((best[k] + self._log(name[k:stop], rare), k) for k in range(max(0, stop - self.LONGEST), stop))
                best.append(score)
                back.append(start)
            found, stop = [], len(name)
            while stop:
                found.append(name[back[stop] : stop])
                stop = back[stop]
            found.reverse()
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[name] = found
        return found


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    seeds: Sequence[str] = tuple(SEEDS),
    max_words: int = 100_000,
    smoothing: float = 0.1,
    seed_share: float = 0.5,
) -> DataFrame:
    """`pages` without `html`, with `host`, `path`, `rule`, `verdict`, `words` and `log_odds`.

    `verdict` is the rule's where one fits, else `block` if naive Bayes gives the words of host and
    path positive log odds, else `allow`. The word model counts the words of all pages and class counts come
    from all URLs: those with a seed are the block class. The block class draws `seed_share` of its words
    evenly from the seeds, however many URLs and seeds there are, and the rest as its URLs do. The
    `max_words` most frequent words go to every task; what rarer words say is joined to the URLs that
    need it, so the result does not depend on `max_words`. A null url or one
    without `://` has an empty host and path, no words, and the verdict `allow`. Repeated rows are
    judged each for itself, an empty table gives an empty table, and columns named like the added
    ones are replaced.
    """
    rows = without(pages, (*ADDED, "_row", "_tail"))
    carried = [c for c in rows.columns if c.lower() != "html"]
    split = rows.select(*[F.col(f"`{c}`") for c in carried], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_row", F.monotonically_increasing_id())

    counted = map_rows(pages.select("html"), _WordCounts, "word string, n long", 200).groupBy("word").agg(F.sum("n").alias("n"))
    counted = stage(counted)
    total, different = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = least_count(counted, max_words)
    head = {r["word"]: r["n"] for r in counted.filter(F.col("n") >= least).collect()}
    typical = max(1, total // max(1, different))
    own = {r["word"]: r["n"] for r in counted.filter(F.col("word").isin(*seeds)).collect()} if seeds else {}
    head |= {seed: max(own.get(seed, 0), typical) for seed in seeds}
    tail = counted.filter((F.col("n") < least) & (~F.col("word").isin(*seeds) if seeds else F.lit(True)))
    split = stage(split)
    pairs = "array<struct<word:string,n:long>>"
    if tail.isEmpty():
        split = split.withColumn("_tail", F.lit(None).cast(pairs))
    else:
        # Every stretch of a name that is a rare word, by an equality join on the different names' substrings.
        named = stage(map_rows(split.select("_row", "host", "path"), _naming, "_row long, name string"))
        parts = map_rows(named.select("name").distinct(), _parts, "name string, word string")
        rare = parts.join(tail, "word").groupBy("name").agg(F.collect_set(F.struct("word", "n")).alias("words"))
        per_row = named.join(rare, "name").groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("_tail"))
        split = split.join(per_row, "_row", "left")
    split = split.withColumn("words", F.lit(None).cast("array<string>"))
    table = stage(map_rows(split, _segmenting(head, total + sum(head[s] - own.get(s, 0) for s in seeds)), split.schema)).drop("_tail")

    is_seeded = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds])) if seeds else F.lit(False)
    tokens = table.withColumn("bad", F.coalesce(is_seeded, F.lit(False)))
    totals = {r["bad"]: r["n"] for r in tokens.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_word = tokens.select("bad", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good")
    )
    by_word = stage(by_word.withColumn("n", F.col("bad") + F.col("good")))
    all_bad, all_good, size = by_word.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    size += len(seeds) + 1
    even = seed_share / len(seeds) if seeds else 0.0

    def odds(bad, good, seed, log):
        in_bad = (1 - seed_share) * (bad + smoothing) / (all_bad + smoothing * size) + seed * even
        return log(in_bad) - log((good + smoothing) / (all_good + smoothing * size))

    least = least_count(by_word, max_words)
    logs = {s: odds(0, 0, 1, math.log) for s in seeds}
    frequent = by_word.filter(F.col("n") >= least) if not seeds else by_word.filter((F.col("n") >= least) | F.col("word").isin(*seeds))
    logs |= {r["word"]: odds(r["bad"], r["good"], r["word"] in seeds, math.log) for r in frequent.collect()}
    prior = math.log((totals.get(True, 0) + 1) / (totals.get(False, 0) + 1))
    rare = by_word.filter((F.col("n") < least) & (~F.col("word").isin(*seeds) if seeds else F.lit(True)))
    rare_odds = rare.select("word", odds(F.col("bad"), F.col("good"), 0, F.log).alias("odds"))
    each = table.select("_row", F.explode("words").alias("word")).join(rare_odds, "word")
    table = table.join(each.groupBy("_row").agg(F.sum("odds").alias("_tail")), "_row", "left")

    def make():
        def work(columns):
            columns["log_odds"] = [
                prior + sum(logs.get(w, 0.0) for w in words or ()) + (rest or 0.0) for words, rest in zip(columns["words"], columns["_tail"], strict=True)
            ]
            return columns

        return work

    scored = table.withColumn("log_odds", F.lit(None).cast("double"))
    scored = map_rows(scored, make, scored.schema)
    verdict = F.when((F.col("log_odds") > 0) & (F.size("words") > 0), "block").otherwise("allow")
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]) if rules else None
    if rules:
        verdict = F.coalesce(F.try_element_at(verdicts, F.col("rule")), verdict)
    return scored.withColumn("verdict", verdict).select(*[F.col(f"`{c}`") for c in carried], *ADDED)


def _names(host: str, path: str) -> list[str]:
    return [name for name in LETTERS.findall(host.lower()) + LETTERS.findall(path.lower()) if name not in SILENT]


def _naming():
    def work(columns):
        found = [(row, name) for row, host, path in zip(columns["_row"], columns["host"], columns["path"], strict=True) for name in set(_names(host, path))]
        return {"_row": [r for r, _ in found], "name": [n for _, n in found]}

    return work


def _parts():
    def work(columns):
        found = [(name, part) for name in columns["name"] for part in {name[a:b] for a in range(len(name)) for b in range(a + 1, min(len(name), a + Segmenter.LONGEST) + 1)}]
        return {"name": [n for n, _ in found], "word": [w for _, w in found]}

    return work


def _segmenting(counts: dict[str, int], total: int):
    def make():
        segmenter = Segmenter(counts, total)

        def work(columns):
            for k, (host, path, tail) in enumerate(zip(columns["host"], columns["path"], columns["_tail"], strict=True)):
                rare = {t["word"]: t["n"] for t in tail or ()}
                columns["words"][k] = [w for name in _names(host, path) for w in segmenter(name, rare)]
            return columns

        return work

    return make
