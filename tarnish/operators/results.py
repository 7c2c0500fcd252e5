"""Aggregations over experiment results: curves, pivots, losses, thresholds, checks, series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnish.functions.numeric import safe_ratio


def summarise(df: DataFrame, by: Sequence[str], metrics: Sequence[str], places: int | None = None) -> DataFrame:
    """Mean and sample standard deviation of every metric per group."""

    def shown(column):
        return column if places is None else F.round(column, places)

    return df.groupBy(*by).agg(
        *[shown(F.avg(m)).alias(f"{m}_mean") for m in metrics],
        *[shown(F.stddev_samp(m)).alias(f"{m}_sd") for m in metrics],
    )


def distinct_points(df: DataFrame, config: str, first, level: str = "level") -> DataFrame:
    """The baseline is the same in every configuration; keep it for the first one only."""
    return df.filter((F.col(level) != 0) | (F.col(config) == first))


def pivot_mean(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, metric: str) -> DataFrame:
    """Mean of a metric with one output column per listed value."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.avg(metric))


def decompose_loss(
    df: DataFrame, by: Sequence[str] = (), clean: str = "f1_clean", dirty: str = "f1_dirty", level: str = "level"
) -> DataFrame:
    """Loss against the baseline split into what was learnt badly and what comes from corrupted input."""
    by = list(by)
    curve = df.groupBy(*by, level).agg(F.avg(clean).alias("clean"), F.avg(dirty).alias("dirty"))
    base = curve.filter(F.col(level) == 0).select(*by, F.col("clean").alias("base"))
    joined = curve.join(base, by) if by else curve.withColumn("base", base.select("base").scalar())
    learning, total = F.col("base") - F.col("clean"), F.col("base") - F.col("dirty")
    return joined.select(
        *by, level, "clean", "dirty", learning.alias("learning_loss"),
        (F.col("clean") - F.col("dirty")).alias("input_loss"), total.alias("total_loss"),
        F.when(total > 0, 100 * learning / total).alias("learning_percent"),
    )


def drop_from_baseline(
    df: DataFrame, by: Sequence[str], model: str, models: Sequence[str], metric: str, level: str = "level"
) -> DataFrame:
    """Drop against level 0 per level, one column per model plus their mean."""
    by = list(by)
    curve = df.groupBy(*by, level, model).agg(F.avg(metric).alias("m"))
    base = curve.filter(F.col(level) == 0).select(*by, model, F.col("m").alias("base"))
    drops = curve.join(base, [*by, model]).withColumn("drop", F.col("base") - F.col("m"))
    wide = drops.groupBy(*by, level).pivot(model, list(models)).agg(F.avg("drop"))
    known = [F.col(f"`{m}`") for m in models]
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in known])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0e0)) for c in known])
    return wide.withColumn("mean", safe_ratio(total, present))


def tolerance_threshold(
    df: DataFrame, by: Sequence[str], metric: str, level: str = "level", limit: float = 0.01
) -> DataFrame:
    """The highest level up to which the mean drop stays below `limit` at every level; and the last drop."""
    by = list(by)
    curve = df.groupBy(*by, level).agg(F.avg(metric).alias("m"))
    base = curve.filter(F.col(level) == 0).select(*by, F.col("m").alias("base"))
    drops = curve.join(base, by).withColumn("drop", F.col("base") - F.col("m"))
    broken = drops.groupBy(*by).agg(
        F.min(F.when((F.col(level) > 0) & (F.col("drop") >= limit), F.col(level))).alias("first_broken"),
        F.max(F.struct(level, "drop")).getField("drop").alias("drop_at_top"),
    )
    kept = drops.join(broken, by).filter(F.col("first_broken").isNull() | (F.col(level) < F.col("first_broken")))
    return kept.groupBy(*by).agg(F.max(level).alias("threshold"), F.max("drop_at_top").alias("drop_at_top"))


def tolerance_thresholds(df: DataFrame, config: str, model: str, metric: str, level: str = "level") -> DataFrame:
    """Thresholds per configuration and model, and for the mean over the models."""
    single = df.select(config, F.col(model).alias("model"), level, metric)
    pooled = df.select(config, F.lit("all models").alias("model"), level, metric)
    return tolerance_threshold(single.unionByName(pooled), [config, "model"], metric, level)


def completeness(df: DataFrame, expected: int, metrics: Sequence[str]) -> DataFrame:
    """One row: rows found and expected, missing metric values."""
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(m).isNull()) for m in metrics])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(expected).alias("expected"), missing.alias("missing"),
        (F.count(F.lit(1)) == expected).alias("complete"),
    )


def monotone(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Per group: whether the mean of `value` never falls along `order` (checked on the aggregated curve)."""
    curve = df.groupBy(*by, order).agg(F.avg(value).alias("v"))
    previous = F.lag("v").over(W.partitionBy(*by).orderBy(order))
    steps = curve.withColumn("_rises", F.coalesce(F.col("v") >= previous, F.lit(True)))
    return steps.groupBy(*by).agg(F.bool_and("_rises").alias("monotone"), F.count(F.lit(1)).alias("n_levels"))


def baseline_varies(df: DataFrame, by: Sequence[str], metric: str, level: str = "level") -> DataFrame:
    """Per group: sample deviation of the baseline over replicas, and whether it is positive."""
    base = df.filter(F.col(level) == 0).groupBy(*by).agg(F.stddev_samp(metric).alias("sd"))
    return base.select(*by, "sd", F.coalesce(F.col("sd") > 0, F.lit(False)).alias("varies"))


def significant_counts(tests: DataFrame, by: Sequence[str], flag: str = "significant") -> DataFrame:
    """Per group: comparisons and how many are significant."""
    return tests.groupBy(*by).agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(F.col(flag)).alias("n_significant"))


def summary_table(
    df: DataFrame, config: str, configs: Sequence[str], measures: Sequence[str], metric: str, level: str = "level"
) -> DataFrame:
    """Per level: the metric, its drop and the measures, one column per configuration."""
    aggregates = [F.avg(metric).alias(metric), *[F.avg(m).alias(m) for m in measures]]
    curve = df.groupBy(config, level).agg(*aggregates)
    base = curve.filter(F.col(level) == 0).select(config, F.col(metric).alias("_base"))
    full = curve.join(base, config).withColumn("drop", F.col("_base") - F.col(metric))
    names = [metric, "drop", *measures]
    return full.groupBy(level).pivot(config, list(configs)).agg(*[F.max(c).alias(c) for c in names])


def ratio_range(df: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """One row: range of the ratio over rows where it exists."""
    ratio = safe_ratio(F.col(numerator), F.col(denominator))
    return df.agg(F.count(ratio).alias("n"), F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"))


def curve_band(df: DataFrame, by: Sequence[str], metric: str, level: str = "level", positive_only: bool = False) -> DataFrame:
    """Series of a curve with its band: mean, mean - sd, mean + sd per level; log scales need positive means."""
    series = df.groupBy(*by, level).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("_sd"))
    series = series.select(
        *by, level, "mean", (F.col("mean") - F.col("_sd")).alias("low"), (F.col("mean") + F.col("_sd")).alias("high")
    )
    return series.filter("mean > 0") if positive_only else series


def compare_experiments(first: DataFrame, second: DataFrame, names: Sequence[str], metric: str, level: str = "level") -> DataFrame:
    """The drop curves of two result sets side by side, with the source named."""
    cols = [level, metric]
    both = first.select(*cols, F.lit(names[0]).alias("source")).unionByName(second.select(*cols, F.lit(names[1]).alias("source")))
    curve = both.groupBy("source", level).agg(F.avg(metric).alias("mean"))
    base = curve.filter(F.col(level) == 0).select("source", F.col("mean").alias("_base"))
    return curve.join(base, "source").select("source", level, "mean", (F.col("_base") - F.col("mean")).alias("drop"))


def wins(df: DataFrame, pair_on: Sequence[str], metric: str, config: str, order: Sequence[str]) -> DataFrame:
    """Per neighbouring pair of configurations: in how many paired rows the later one is better or worse."""
    step = F
    for a, b in zip(order[:-1], order[1:]):
        step = step.when(F.col(config) == a, F.lit(b))
    low = df.withColumn("_next", step).filter("_next IS NOT NULL")
    low = low.select(*pair_on, F.col(config).alias("_low"), F.col("_next").alias(config), F.col(metric).alias("_a"))
    both = low.join(df.select(*pair_on, config, F.col(metric).alias("_b")), [*pair_on, config])
    return both.groupBy(F.concat_ws(" -> ", "_low", config).alias("comparison")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_b") > F.col("_a")).alias("better"),
        F.count_if(F.col("_b") < F.col("_a")).alias("worse"),
    )


def relevance(drops: DataFrame, config: str = "config") -> DataFrame:
    """Per configuration: mean, smallest and largest drop over the models, and significant models."""
    return drops.groupBy(config).agg(
        F.avg("drop").alias("drop_mean"), F.min("drop").alias("drop_min"), F.max("drop").alias("drop_max"),
        F.count_if("significant").alias("n_significant"),
    )


# ---- grids ---------------------------------------------------------------------------------------


def grid(spark, **axes: Sequence) -> DataFrame:
    """All combinations of the axis values as a table."""
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("_one")


def pending(cells: DataFrame, results: DataFrame, keys: Sequence[str], rows_per_cell: int = 4, each: str | None = None) -> DataFrame:
    """Grid cells without a complete result: exactly `rows_per_cell` rows count as done, if `each` is named with as many values of it."""
    n = F.count(F.lit(1)) == rows_per_cell
    whole = n if each is None else n & (F.count_distinct(each) == rows_per_cell)
    done = results.groupBy(*keys).agg(whole.alias("_whole")).filter("_whole")
    return cells.join(done.select(*keys), list(keys), "left_anti")


def share_baseline(results: DataFrame, config: str, configs: Sequence[str], level: str = "level") -> DataFrame:
    """The single baseline run recorded for every configuration; adds `shared`."""
    base = results.filter(F.col(level) == 0)
    spread = base.withColumn(config, F.explode(F.array(*[F.lit(c) for c in configs]))).withColumn("shared", F.lit(True))
    return results.filter(F.col(level) != 0).withColumn("shared", F.lit(False)).unionByName(spread.select(*results.columns, "shared"))


def alias_configuration(results: DataFrame, config: str, source: str, alias: str) -> DataFrame:
    """Rows of a configuration repeated under a second name."""
    copy = results.filter(F.col(config) == source).withColumn(config, F.lit(alias))
    return results.unionByName(copy)


def baseline_gates(results: DataFrame, clean: str, dirty: str, share: str, level: str = "level", chance: float = 0.5) -> DataFrame:
    """One row on the baseline: lowest model mean, largest clean/dirty gap, largest dirty share, all gates."""
    base = results.filter(F.col(level) == 0)
    lowest = base.groupBy("model").agg(F.avg(clean).alias("m")).agg(F.min("m")).scalar()
    out = base.agg(
        lowest.alias("lowest_mean"), F.max(F.abs(F.col(clean) - F.col(dirty))).alias("gap"),
        F.max(share).alias("dirty_share"),
    )
    passed = (F.col("lowest_mean") >= chance) & (F.col("gap") <= 1e-9) & (F.col("dirty_share") == 0)
    return out.withColumn("passed", passed)
