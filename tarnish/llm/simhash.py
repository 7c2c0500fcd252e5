"""Operator 8: near-duplicates by SimHash with deletion-variant signatures.

A fingerprint of 64 bits is cut into `max_bits // 2 + 1` segments. Two fingerprints that differ in at
most `max_bits` bits then have a segment that differs in at most one bit, so they share a variant of
that segment with one bit taken out: an equality join on (segment, bit, rest) finds all pairs. Texts
with the same fingerprint are one entry of the index from the start.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.components import components
from tarnish.llm.frequent import least_count
from tarnish.llm.text import lower_spaced_words, map_rows
from tarnish.session import free, stage

SEED = 42


def fingerprint(words: list[bytes], width: int) -> int:
    """64-bit SimHash over shingles of `width` words; 0 without a word. Ties give a 0 bit."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*[words[k:] for k in range(width)], strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    """The signed number of the same 64 bits."""
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; A-Z count as lower case, words are split at ASCII white space."""

    def make():
        def work(rows):
            return {"doc_id": rows["doc_id"], "fp": [_signed(fingerprint(lower_spaced_words(t), width)) for t in rows["text"]]}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bit after the highest, mask) of each segment."""
    n = max_bits // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(low, high, ((1 << (high - low)) - 1) << low) for low, high in zip(cuts, cuts[1:], strict=False)]


def _masked(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _variants(fp: Column, max_bits: int) -> Column:
    """Every segment of a fingerprint with one bit taken out: (the bit, the rest of its segment)."""
    return F.array(
        *[
            F.struct(F.lit(bit).alias("bit"), _masked(fp, mask & ~(1 << bit)).alias("rest"))
            for low, high, mask in _segments(max_bits)
            for bit in range(low, high)
        ]
    )


def _members(entries: DataFrame, buckets: DataFrame, fp: str, max_bits: int) -> DataFrame:
    """Rows of `entries` in each of some `buckets` (bit, rest, ...), by whole segments.

    A bucket holds two values of its segment, one for either state of its bit. So the entries need one
    row for each segment, not one for each variant, to find the buckets that they are in.
    """
    segments = _segments(max_bits)
    whole = F.array(*[F.struct(F.lit(k).alias("segment"), _masked(F.col(fp), m).alias("value")) for k, (_, _, m) in enumerate(segments)])
    place = F.lit(0)
    for low, _, _ in segments[1:]:
        place = place + (F.col("bit") >= low).cast("int")
    set_bit = F.expr("shiftleft(1L, bit)")
    values = buckets.withColumn("segment", place).withColumn("value", F.explode(F.array("rest", F.col("rest").bitwiseOR(set_bit))))
    parts = entries.withColumn("_x", F.explode(whole)).select(*entries.columns, "_x.segment", "_x.value")
    return parts.join(values, ["segment", "value"]).drop("segment", "value")


def _flips(fp: Column, bits: int) -> Column:
    """Every number within `bits` bit flips of a fingerprint."""
    masks = {0}
    for _ in range(bits):
        masks |= {m ^ (1 << b) for m in masks for b in range(64)}
    return F.array(*[fp.bitwiseXOR(F.lit(m - (1 << 64) if m >> 63 else m)) for m in sorted(masks)])


def links(distinct: DataFrame, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """Edges (u, v) that connect the different fingerprints `fp` within `max_bits` (even) bits.

    Buckets of the index with at most `bucket` entries are joined with themselves and verified: at most
    `bucket` candidates an entry. The entries of larger buckets are linked without any pair: two
    numbers are within `max_bits` bits if and only if half as many flips of each lead to one number,
    so all that reach one number become a star around the smallest of them. Both ways are exact.
    """
    if max_bits % 2 or max_bits < 2:
        raise ValueError("max_bits must be even and positive")
    index = distinct.select("fp", F.explode(_variants(F.col("fp"), max_bits)).alias("x")).select("fp", "x.bit", "x.rest")
    buckets = stage(
        index.groupBy("bit", "rest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("v"), F.max("fp").alias("u"))
        .filter("n > 1")
    )
    crowd = _members(distinct.select("fp"), buckets.filter("n > 2").select("bit", "rest", "n"), "fp", max_bits)
    crowd = stage(crowd)
    some = crowd.filter(F.col("n") <= bucket)
    pairs = buckets.filter("n = 2").select("u", "v").unionByName(
        some.select("bit", "rest", F.col("fp").alias("u")).join(some.select("bit", "rest", F.col("fp").alias("v")), ["bit", "rest"]).filter("v < u").select("u", "v")
    )
    near = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    crowded = crowd.filter(F.col("n") > bucket).select("fp").distinct()
    reached = stage(crowded).select("fp", F.explode(_flips(F.col("fp"), max_bits // 2)).alias("x"))
    centres = reached.groupBy("x").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = reached.join(centres, "x").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most `max_bits` bits lead to.

    One row per row of `docs`; the fingerprint is over all shingles of `width` words, repeats included.
    Texts of fewer words are one shingle, null and wordless texts have fingerprint 0 and are linked
    like any other. Repeated rows and texts share a component. A null doc_id is never a component_id
    unless no other id is in reach. Other columns are not used. An empty table gives an empty table.
    """
    rows = stage(fingerprints(docs, width))
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stage(rooted.join(lowest, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


BLOCK = 256  # entries of a bucket that are compared in one task
CROWD, MOST_CROWDED = 200, 1 << 20
ROUNDS = 1  # of cutting prefixes anew; what is still crowded then is paired in parts
SAMPLE, SAMPLED = 8, 3  # one text of so many is asked which hashes are frequent: those that so many of them have


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the different shingles of `width` words (a shorter text is one), sorted; none without words."""
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    found = {b" ".join(s) for s in zip(*[words[k:] for k in range(width)], strict=False)} or {b" ".join(words)}
    return np.unique(np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found)).view(np.int64))


def _needed(n: Column, similarity: float) -> Column:
    """Least number of shared shingles of two sets with `n` shingles in all."""
    return F.ceil(n * (similarity / (1 + similarity)) - 1e-9)


def parity(found: np.ndarray) -> np.ndarray:
    """One bit for each hash of a set and more (a power of two): whether an odd number of hashes falls on it.

    Every bit that differs between two sets needs a hash that only one of them has, so differing bits never
    outnumber such hashes. Halves of a longer array XORed are the array of half the length.
    """
    bits = max(64, 1 << max(len(found) - 1, 0).bit_length())
    counts = np.bincount((found & (bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent hashes, sorted, and about how many texts have each, from a sample of the texts (by their hash).

    They only order the hashes, and near copies are found in any order: what the sample passes over costs time.
    """
    one = texts.filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).dropDuplicates(["text_hash"]).select("text")

    def make():
        return lambda r: {"x": np.concatenate([shingles(lower_spaced_words(t), width) for t in r["text"]])}

    counts = stage(map_rows(one, make, "x long").groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SAMPLED))
    found = counts.filter(F.col("n") >= least_count(counts, MOST_CROWDED)).orderBy("x").toArrow()
    free(counts)
    return found["x"].to_numpy(), found["n"].to_numpy() * SAMPLE


def _prefixes(texts: DataFrame, similarity: float, width: int, late, more: Sequence[str] = ()) -> DataFrame:
    """Every row with its set's hash and size and the prefix of the set: hashes in rising order, then those of `late`, the rarest first.

    `late` holds sorted hashes and a weight for each. `more` may name `parity`, the parity bits of the set, and `fp`, the SimHash of the text.
    """

    def make():
        last, weights = late.value

        def order(found):
            if not len(last):
                return found, np.zeros(len(found), np.int64)
            at = np.minimum(np.searchsorted(last, found), len(last) - 1)
            weight = np.where(last[at] == found, weights[at], 0)
            placed = np.argsort(weight, kind="stable")
            return found[placed], weight[placed]

        def work(r):
            out = {c: [] for c in ("entry", "size", "prefix", "end", *more)}
            for words in map(lower_spaced_words, r["text"]):
                found = shingles(words, width)
                entry = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                n = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1 if len(found) else 0
                placed, weight = order(found)
                out["entry"].append(_signed(entry))
                out["size"].append(len(found))
                out["prefix"].append(placed[:n])
                out["end"].append({"weight": int(weight[n - 1]), "x": int(placed[n - 1])} if n else None)
                if "parity" in more:
                    out["parity"].append(parity(found))
                if "fp" in more:
                    out["fp"].append(_signed(fingerprint(words, 3)))
            return {"doc_id": r["doc_id"], "text_hash": r["text_hash"]} | out

        return work

    schema = "doc_id long, text_hash long, entry long, size long, prefix array<long>, end struct<weight:long,x:long>"
    types = {"parity": "array<long>", "fp": "long"}
    return map_rows(texts, make, ", ".join([schema, *[f"{c} {types[c]}" for c in more]]))


def _index(rows: DataFrame) -> DataFrame:
    """(x, at, entry, size, end, n): the prefix hashes that at least two entries have, and their place in the prefix."""
    one = rows.select("entry", "size", "end", "prefix").dropDuplicates(["entry"])
    cells = one.select("entry", F.explode("prefix").alias("x"))
    # Staged, so that Spark knows how few hashes are shared and can send them to the cells.
    buckets = stage(cells.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    placed = rows.select("entry", "size", "end", F.posexplode("prefix").alias("at", "x"))
    index = stage(placed.join(buckets, "x").dropDuplicates(["entry", "x"]))
    free(buckets)
    return index


def _stars(index: DataFrame) -> DataFrame:
    """(u, v), once for each bucket they share: all entries of a bucket with its centre, the entry whose buckets are largest in all.

    Of many edited copies of one text, the text itself is in the largest buckets and nearest to all.
    """
    scored = index.join(index.groupBy("entry").agg(F.sum("n").alias("score")), "entry")
    centres = scored.groupBy("x").agg(F.max(F.struct("score", "entry", "size", "end")).alias("c"))
    centres = centres.select("x", F.struct("c.entry", "c.size", "c.end").alias("v"))
    return index.join(centres, "x").filter("entry <> v.entry").select(F.struct("entry", "size", "end").alias("u"), "v")


def _possible(shared: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of those pairs that may be similar, given one row (u, v: entry, size, end) for each shared prefix hash.

    Up to the earlier end of both prefixes, all that the sets share is in both prefixes and so was
    counted; beyond, no more can be shared than the set with the earlier end has left.
    """
    left = lambda side: F.ceil(F.col(f"{side}.size") * similarity - 1e-9) - 1
    rest = F.when(F.col("u.end") <= F.col("v.end"), left("u")).otherwise(left("v"))
    counted = shared.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
    possible = F.col("c") + rest >= _needed(F.col("u.size") + F.col("v.size"), similarity)
    return counted.filter(possible).select(F.col("u.entry").alias("u"), F.col("v.entry").alias("v"))


def _alike(pairs: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (u, v) whose parity bits differ in no more places than similar sets have hashes of their own."""
    side = lambda s: entries.select(F.col("entry").alias(s), F.struct("size", "parity").alias(f"_{s}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v")
    xor = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))

    def bits(one: str, other: str) -> Column:
        """The parity bits of `one`, folded to the length of the other's."""
        own, half = F.col(f"_{one}.parity"), F.size(f"_{other}.parity")
        return F.when(F.size(own) > half, xor(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half))).otherwise(own)

    total = F.col("_u.size") + F.col("_v.size")
    apart = F.aggregate(xor(bits("u", "v"), bits("v", "u")), F.lit(0), lambda n, x: n + F.bit_count(x))
    # No more can be shared than the smaller set has; of the others, lengths differ by half at most.
    lengths = F.least("_u.size", "_v.size") >= _needed(total, similarity)
    return met.filter(lengths & (apart <= total - 2 * _needed(total, similarity))).select("u", "v")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of all entries of `rows` (x, at, entry, size, end, n, root) in different groups that may have `x` as their first shared hash.

    From its first shared hash on, no more can be shared than is left of either set; similar sets have enough left there.
    Large buckets are cut into parts that meet two by two, so no task holds more than two of them.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("entry", "x"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("left", F.col("size") - F.col("at")).select(
        "x", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "part", "root", "size", "left", "entry"
    )
    side = lambda s: dealt.select("x", "a", "b", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "root", "size", "left", "entry")])
    met = side("u").join(side("v"), ["x", "a", "b"]).filter("entry_u > entry_v AND root_u <> root_v AND (a = b OR part_u <> part_v)")
    possible = F.least("left_u", "left_v") >= _needed(F.col("size_u") + F.col("size_v"), similarity)
    return met.filter(possible).select(F.col("entry_u").alias("u"), F.col("entry_v").alias("v")).distinct()


def _linked(rows: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): edges that connect the entries of texts whose fingerprints links of at most `max_bits` bits connect."""
    texts = stage(rows.groupBy("fp", "entry").agg(F.count(F.lit(1)).alias("n")).select("fp", "entry"))
    distinct = stage(texts.select("fp").distinct())
    roots = components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    rooted = texts.join(roots, "fp", "left").select("entry", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("entry").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rooted.join(lowest, "root").filter("entry <> v").select(F.col("entry").alias("u"), "v").distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, max_bits: int | None = None) -> DataFrame:
    """(doc_id, text_hash, component, kept) for every row of `docs`: groups of near copies.

    With `max_bits`, texts are near copies if SimHash links them: fingerprints of at most so many different
    bits, found as in `near_duplicates`. The exact check that follows finds what fingerprints pass over:
    texts are near copies, too, if their sets of hashed shingles of `width` words have a Jaccard similarity of
    at least `similarity`, counted exactly. A group is what such pairs connect.

    Two sets of that similarity share one of the first hashes of both in any order of all hashes (prefix
    filter), which is what entries are joined by. The order is by rising frequency, so buckets are small;
    frequencies come from a sample, as the result is the same in any order. First every bucket of a hash is
    checked against its centre, which finds most groups. Where a crowded bucket then still holds different
    groups and its hash is not among the frequent ones yet, prefixes are cut anew. Last, entries of different
    groups in one bucket are paired if enough is left of both sets from there on, and pairs that may be similar by
    the parity bits of their sets are decided over whole sets. `kept` marks the smallest doc_id of
    each group (of equal ids, the smallest text hash). Rows with equal sets are one entry. Null and wordless
    texts are copies of each other. A null doc_id is above all others. Repeated rows share their verdict.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    late, weights = _frequent(texts, width)
    more = ("parity",) if max_bits is None else ("parity", "fp")
    rows = stage(_prefixes(texts, similarity, width, spark.sparkContext.broadcast((late, weights)), more))
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    entries = stage(rows.groupBy("entry", "size").agg(first, F.any_value("parity").alias("parity")))
    index = _index(rows)
    # A pair of a star may share hashes of other buckets too, so this only finds promising pairs early.
    near = _counted(_possible(_stars(index), similarity), texts, entries, similarity, width)
    near = stage(near if max_bits is None else near.unionByName(_linked(rows, max_bits)))
    groups = stage(components(near).withColumnRenamed("node", "entry"))

    # There are at most MOST_CROWDED crowded hashes in a round, whatever the number of texts.
    crowd = max(CROWD, index.count() // MOST_CROWDED)
    for turn in range(ROUNDS + 1):
        open_ = index.join(groups, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
        mixed = stage(open_.groupBy("x", "n").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("x", "n"))
        if turn == ROUNDS:
            break
        crowded = mixed.filter(F.col("n") > crowd).select("x", "n").toArrow()
        new = ~np.isin(crowded["x"].to_numpy(), late)
        if not new.any():
            break
        late, weights = np.append(late, crowded["x"].to_numpy()[new]), np.append(weights, crowded["n"].to_numpy()[new])
        order = np.argsort(late)
        late, weights = late[order], weights[order]
        recut = stage(_prefixes(texts, similarity, width, spark.sparkContext.broadcast((late, weights))))
        free(index, mixed)
        index = _index(recut)
        free(recut)
    pairs = _pairs(open_.join(mixed.select("x"), "x"), similarity)
    found = stage(_counted(pairs, texts, entries, similarity, width))
    free(index, mixed)

    roots = components(near.unionByName(found)).withColumnRenamed("node", "entry")
    rooted = entries.select("entry", "first").join(roots, "entry", "left").withColumn("component", F.coalesce("root", "entry")).drop("root")
    best = rooted.groupBy("component").agg(F.min("first").alias("best"))
    verdicts = stage(rooted.join(best, "component").select("entry", "component", "best"))
    kept = (F.col("doc_id") == F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return rows.join(verdicts, "entry").select("doc_id", "text_hash", "component", kept.alias("kept"))


TEXTS_AT_ONCE = 512


def _counted(pairs: DataFrame, texts: DataFrame, entries: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of `pairs` (u, v) whose whole sets of shingles are similar, counted.

    Texts are sent, not sets, which are larger; each task cuts the texts of one `v` and of some of its `u`.
    """
    pairs = stage(_alike(pairs, entries, similarity))
    sizes = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    slots = F.ceil(F.col("n") / TEXTS_AT_ONCE).cast("int")
    dealt = stage(pairs.join(sizes, "v").select("u", "v", F.pmod(F.xxhash64("u"), slots).cast("int").alias("slot")))
    left = dealt.select(F.col("u").alias("entry"), "v", "slot")
    right = dealt.select(F.col("v").alias("entry"), F.col("v").alias("to"), F.col("slot").alias("for_slot")).distinct()
    first = entries.select("entry", "first.doc_id", "first.text_hash")
    # Staged, so that Spark knows the sizes and sends them to the texts while they are small.
    near = texts.join(stage(left.join(first, "entry")), ["doc_id", "text_hash"]).select("entry", "v", "slot", "text")
    far = texts.join(stage(right.join(first, "entry")), ["doc_id", "text_hash"]).select("to", "for_slot", F.col("text").alias("whole"))

    def compare(some, one):
        if not len(some) or not len(one):
            return type(some)({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        centre = shingles(lower_spaced_words(one["whole"].iloc[0]), width)
        kept = []
        for entry, text in zip(some["entry"], some["text"], strict=True):
            found = shingles(lower_spaced_words(text), width)
            shared = len(np.intersect1d(found, centre, assume_unique=True))
            if shared >= np.ceil((len(found) + len(centre)) * (similarity / (1 + similarity)) - 1e-9):
                kept.append(entry)
        return type(some)({"u": np.array(kept, np.int64), "v": np.full(len(kept), one["to"].iloc[0], np.int64)})

    met = near.groupBy("v", "slot").cogroup(far.groupBy("to", "for_slot"))
    return met.applyInPandas(compare, "u long, v long").distinct()


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, max_bits: int | None = None) -> DataFrame:
    """`docs` with one row of each group of near copies, see `near_copies`; columns stay as they are."""
    kept = near_copies(docs, similarity, width, max_bits).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "_hash": F.xxhash64("text")}
    return docs.withColumns(keys).join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).drop("_id", "_hash")
