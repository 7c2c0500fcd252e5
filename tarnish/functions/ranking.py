"""Exact distributed ranks and k-selection without a global sort and without one task per group.

Rows are ordered by a uniform draw. The leading bits of the draw split every group, however large, into
up to 65,536 buckets: group totals per bucket are small, running totals over them give each bucket its
offset, and only rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnish.functions.hashing import bucket
from tarnish.session import stage


def join_nullable(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is a value like any other, with the columns of `other` besides its keys."""
    renamed = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"_other_{k}" for k in keys])


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, out: str, weight: Column | None = None, few: bool = False
) -> DataFrame:
    """Add `out`: the total weight (default 1) of the rows before this one, per key, by (order, tie).

    With `few` keys the offsets of the buckets are staged, so that Spark knows how small they are and rows
    need no second shuffle to meet them.
    """
    weight = F.lit(1) if weight is None else weight
    keys = list(keys)
    rows = df.withColumn("_w", weight.cast("bigint")).withColumn("_b", bucket(F.col(order)))
    per_bucket = rows.groupBy(*keys, "_b").agg(F.sum("_w").alias("_bw"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_b", F.coalesce(F.sum("_bw").over(before), F.lit(0)).alias("_off"))
    offsets = stage(offsets) if few else offsets
    inside = W.partitionBy(*keys, "_b").orderBy(order, tie).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return (
        join_nullable(placed, offsets, [*keys, "_b"])
        .withColumn(out, F.col("_off") + F.col("_in"))
        .drop("_w", "_b", "_off", "_in")
    )


def ordered_total(df: DataFrame, keys: Sequence[str], order: str, out: str, weight: Column | None = None) -> DataFrame:
    """Add `out`: the total weight (default 1) of the rows before this one, per key, by an order that is no draw."""
    return ordered_totals(df, keys, order, {out: F.lit(1) if weight is None else weight})


def ordered_totals(df: DataFrame, keys: Sequence[str], order: str, weights: dict[str, Column], kind: str = "bigint") -> DataFrame:
    """Add for each name the total of its weight over the rows before this one, per key, by an order that is no draw.

    Rows (distinct in keys and order) are range-partitioned, which balances by sampling, and written with
    the number of their range; totals per range then offset the running totals inside each range. Totals are
    of the type `kind`.
    """
    keys = list(keys)
    names = [(out, f"_w{i}", f"_p{i}", f"_off{i}") for i, out in enumerate(weights)]
    ranged = df.withColumns({w: weights[out].cast(kind) for out, w, _, _ in names}).repartitionByRange(*keys, order)
    rows = stage(ranged.withColumn("_p", F.spark_partition_id()))
    per_range = rows.groupBy(*keys, "_p").agg(*[F.sum(w).alias(p) for _, w, p, _ in names])
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(*keys, "_p", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(off) for _, _, p, off in names])
    inside = W.partitionBy(*keys, "_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = join_nullable(rows, offsets, [*keys, "_p"])
    totals = {out: F.col(off) + F.coalesce(F.sum(w).over(inside), F.lit(0)) for out, w, _, off in names}
    return placed.withColumns(totals).drop("_p", *[c for _, w, _, off in names for c in (w, off)])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or the first one with underscores added that is no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cutoffs(
    df: DataFrame, strata: Sequence[str], order: str, tie: str, quota: Callable[[Column, Column], Column], out: str = "_cutoff"
) -> DataFrame:
    """The last row that belongs to the `quota` smallest rows of each stratum, as (strata, out: struct(n, k, cut, cut_tie)).

    `quota(n, smallest)` gets the stratum size and the smallest stratum size and returns how many rows to
    take; it may use the strata. A NULL cut means the whole stratum (k >= n) or nothing (k = 0).
    """
    strata = list(strata)
    rows = df.select(*strata, F.col(order).alias("_h"), F.col(tie).alias("_t")).withColumn("_b", bucket(F.col("_h")))
    hist = stage(rows.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_bn")))
    sizes = hist.groupBy(*strata).agg(F.sum("_bn").alias("_n"))
    smallest = sizes.agg(F.min("_n")).scalar()
    upto = W.partitionBy(*strata).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*strata)
    marked = (
        hist.withColumn("_cum", F.sum("_bn").over(upto))
        .withColumn("_n", F.sum("_bn").over(whole))
        .withColumn("_k", quota(F.col("_n"), smallest).cast("bigint"))
    )
    edge = stage(
        marked.filter((F.col("_k") > 0) & (F.col("_k") < F.col("_n")))
        .filter((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_bn") < F.col("_k")))
        .select(*strata, "_b", (F.col("_k") - F.col("_cum") + F.col("_bn")).alias("_rest"))
    )
    inside = W.partitionBy(*strata, "_b").orderBy("_h", "_t")
    found = (
        join_nullable(rows, edge, [*strata, "_b"])
        .withColumn("_r", F.row_number().over(inside))
        .filter(F.col("_r") == F.col("_rest"))
        .select(*strata, F.col("_h").alias("_cut"), F.col("_t").alias("_cut_tie"))
    )
    quotas = marked.groupBy(*strata).agg(F.max("_n").alias("_n"), F.max("_k").alias("_k"))
    both = quotas.unionByName(found, allowMissingColumns=True)
    cutoff = F.struct(*[F.max(f"_{c}").alias(c) for c in ("n", "k", "cut", "cut_tie")])
    return stage(both.groupBy(*strata).agg(cutoff.alias(out)))


def within(order: Column, tie: Column, cutoff: str = "_cutoff") -> Column:
    """Whether a row lies within the cutoff joined to it."""
    k, n, cut, cut_tie = (F.col(cutoff).getField(c) for c in ("k", "n", "cut", "cut_tie"))
    inside = (order < cut) | ((order == cut) & (tie <= cut_tie))
    return F.coalesce(F.when(k >= n, F.lit(True)).when(k <= 0, F.lit(False)).otherwise(inside), F.lit(False))


def flag_smallest(
    df: DataFrame,
    strata: Sequence[str],
    order: str,
    tie: str,
    quota: Callable[[Column, Column], Column],
    out: str = "selected",
) -> DataFrame:
    """Add boolean `out`: the row is among the `quota` smallest of its stratum by (order, tie)."""
    name = free_name(df, "_cutoff")
    cuts = cutoffs(df, strata, order, tie, quota, name)
    if strata:
        return join_nullable(df, cuts, list(strata), "left").withColumn(out, within(F.col(order), F.col(tie), name)).drop(name)
    found = cuts.first()  # one row
    return df.withColumn(out, literal_within(F.col(order), F.col(tie), found and found[name]))


def literal_within(order: Column, tie: Column, cut) -> Column:
    """`within` for one cutoff already on the driver."""
    if cut is None or not cut["k"] or cut["k"] <= 0:
        return F.lit(False)
    if cut["k"] >= cut["n"]:
        return F.lit(True)
    return (order < F.lit(cut["cut"])) | ((order == F.lit(cut["cut"])) & (tie <= F.lit(cut["cut_tie"])))
