"""Operator 12: sources mixed to target weights by a curriculum whose weights vary over the training.

DataFrame functions only. Each source gets its share of the demand, no more than a number of times its
size. Its documents, in a drawn order, lie on a line of words that is walked once or more until the share
is reached. The source's weight schedule, integrated, says which part of its words has been used by a
point of the training; inverted, it gives each document its position, and documents are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnish.functions.hashing import draw, encode
from tarnish.functions.ranking import ordered_total
from tarnish.llm.text import without
from tarnish.session import stage

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken", "position", "uses")
#: Weight over training time, as corners of a line from 0 to 1: falling, even and rising late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
BITS = 8  # of the draw, for each of two levels of running totals


def position(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which a source has used `share` (0 to 1) of its words, for a piecewise linear weight.

    The weight's integral is quadratic between two corners; each stretch is inverted in closed form.
    """
    corners = list(schedule)
    if [t for t, _ in corners] != sorted({t for t, _ in corners}) or corners[0][0] != 0 or corners[-1][0] != 1 or min(w for _, w in corners) < 0:
        raise ValueError("a schedule needs rising times from 0 to 1 and no weight below 0")
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(corners, corners[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    wanted = share * F.lit(whole)
    found, before = None, 0.0
    for (t0, a), (t1, b), area in zip(corners, corners[1:], areas, strict=False):
        inside = F.greatest(wanted - F.lit(before), F.lit(0.0))
        slope = (b - a) / (t1 - t0)
        root = F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * inside, F.lit(0.0)))
        time = F.when(inside > 0, F.lit(t0) + F.lit(2.0) * inside / root).otherwise(F.lit(t0))
        if area:
            time = F.least(time, F.lit(t1))
            found = F.when(wanted >= F.lit(before), time) if found is None else F.when(wanted >= F.lit(before), time).otherwise(found)
        before += area
    return found


def targets(sources: DataFrame, weights: Sequence[float], demand: float, most: int) -> DataFrame:
    """`sources` (name, source_size) with `no`, the place by name, and `target`.

    The sources share `demand` times all words by `weights`, repeated in order of names. A target stops at
    `most` times the source's size; the excess is shared again among the others, until none is above.
    Each round is one aggregate of the source table.
    """
    places = ordered_total(sources, [], "name", "no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("no", F.lit(len(weights))) + 1).cast("int"))
    table = stage(places.withColumns({"weight": weight, "most": F.col("source_size") * most}))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, full = demand * total, 0.0, -1
    taken, rest = 0, 0.0
    while True:
        stopped = (F.col("most") <= F.col("weight") * F.lit(level)) if full >= 0 else F.lit(False)
        n, held, left = table.agg(
            F.count_if(stopped), F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("weight")))
        ).first()
        if n == full:
            break
        full, taken, rest = n, int(held or 0), float(left or 0.0)
        if not rest:
            break
        level = (wanted - taken) / rest
    if not rest:
        return table.withColumn("target", F.col("most").cast("double"))
    share = F.col("weight") * F.lit(float(wanted - taken)) / F.lit(rest)
    capped = F.col("most") <= F.col("weight") * F.lit(level)
    return table.withColumn("target", F.when(capped, F.col("most").cast("double")).otherwise(share))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    demand: float = 1.5,
    most: int = 2,
    with_text: bool = True,
) -> DataFrame:
    """`docs` (doc_id, text, source) in training order, with what the mix takes of each row.

    Added: `size`, the words of the text (null: 0); `source_size`; `target`, the words that the mix takes
    of the source, see `targets`; `taken`, of this row, repeats counted; `position`, when the training first
    reads it, from 0 to 1 (null if never); `uses`, each reading as (position, words). The rows of a source lie
    one after the other in an order drawn from id and text; what lies before the target is taken, up to
    `most` times over, so the last row may be taken in part and a source's rows add up to its target rounded
    down. `schedules` repeat over the sources like `weights` do. Sources are in code point order; a null
    source is one of its own, the last. Rows that are never taken come last. Repeated rows get a place
    each; null ids are drawn by their texts. Without words all targets are 0. An empty table gives an
    empty table. Columns named like the added ones are replaced. Texts are not shuffled unless
    `with_text` asks for them. Two runs agree.
    """
    if min(weights) <= 0 or most < 1 or demand > most:
        raise ValueError("weights must be positive, and the demand no more than `most`")
    rows = without(docs, ADDED)
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns if with_text or c != "text"])
    digest = F.md5(F.coalesce("text", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    h = draw("mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)
    placed = rows.select(
        carried.alias("row"), encode(F.col("source")).alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        h.alias("h"), digest.alias("tie"),
    )
    placed = placed.withColumns({"b1": F.shiftright("h", 60 - BITS), "b2": F.shiftright("h", 60 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1))})
    placed = stage(placed)

    # Running totals of two levels, so that no source, however large, meets in one task.
    fine = placed.groupBy("name", "b1", "b2").agg(F.sum("size").alias("words"))
    fine = stage(fine)
    coarse = fine.groupBy("name", "b1").agg(F.sum("words").alias("words"))
    sources = targets(coarse.groupBy("name").agg(F.sum("words").alias("source_size")), weights, demand, most)
    before = F.coalesce(F.sum("words").over(W.partitionBy("name").orderBy("b1").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.withColumn("start", before).drop("words").join(sources.select("name", "no", "source_size", "target"), "name")
    before = F.coalesce(F.sum("words").over(W.partitionBy("name", "b1").orderBy("b2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fine = fine.withColumn("within", before).drop("words").join(coarse, ["name", "b1"])
    fine = fine.withColumn("start", F.col("start") + F.col("within")).drop("within")
    before = W.partitionBy("name", "b1", "b2").orderBy("h", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("in_cell", F.coalesce(F.sum("size").over(before), F.lit(0))).join(fine, ["name", "b1", "b2"])

    wanted = F.floor("target").cast("long")
    first = F.col("start") + F.col("in_cell")
    places = reduce(
        lambda rest, k: F.when(F.pmod("no", F.lit(len(schedules))) == k, _time(schedules[k])).otherwise(rest),
        range(len(schedules)), F.lit(None),
    )
    turns = F.array(*[
        F.struct(
            (first + F.lit(turn) * F.col("source_size")).alias("at"),
            F.least(F.greatest(wanted - first - F.lit(turn) * F.col("source_size"), F.lit(0)), F.col("size")).alias("words"),
        )
        for turn in range(most)
    ])
    placed = placed.withColumn("turns", F.filter(turns, lambda t: t["words"] > 0)).withColumn("times", places)
    uses = F.transform(F.arrays_zip("times", "turns"), lambda x: F.struct(x["times"].alias("position"), x["turns"]["words"].alias("words")))
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["words"])
    placed = placed.select(
        "row", "size", "source_size", "target", taken.alias("taken"), F.get("times", F.lit(0)).alias("position"), uses.alias("uses"),
        F.coalesce(F.get("times", F.lit(0)), F.lit(1.0) + F.col("h") / F.lit(float(1 << 60))).alias("order"), "tie",
    )
    # Staged first: a range partitioning samples its input.
    ordered = stage(placed).orderBy("order", "tie")
    return ordered.select("row.*", *ADDED)


def _time(schedule: Sequence[tuple[float, float]]) -> Column:
    return F.transform("turns", lambda t: position(t["at"] / F.col("target"), schedule))
