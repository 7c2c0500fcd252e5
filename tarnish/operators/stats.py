"""Statistical tests and models on experiment results; p-values come from SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions import ranking
from tarnish.functions.joins import attach
from tarnish.functions.numeric import safe_ratio, t_two_sided
from tarnish.session import stage

ALPHA = 0.05


def _significant(p: str = "p_value") -> Column:
    return F.coalesce(F.col(p) < ALPHA, F.lit(False))


def _moments(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.var_samp(metric).alias("var")
    )


def welch(df: DataFrame, by: Sequence[str], metric: str, level: str = "level", baseline: int = 0) -> DataFrame:
    """Welch two-sample t-test of every level against the baseline level, per group."""
    moments = _moments(df, [*by, level], metric)
    base = moments.filter(F.col(level) == baseline).select(
        *by, F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("var").alias("var0")
    )
    joined = moments.filter(F.col(level) != baseline).join(base, list(by))
    return _welch_columns(joined).select(
        *by, level, F.col("mean0").alias("baseline_mean"), F.sqrt("var0").alias("baseline_sd"), "mean",
        F.sqrt("var").alias("sd"), (F.col("mean0") - F.col("mean")).alias("drop"), "t", "p_value",
        _significant().alias("significant"),
    )


def _welch_columns(joined: DataFrame) -> DataFrame:
    a, b = F.col("var") / F.col("n"), F.col("var0") / F.col("n0")
    return (
        joined.withColumn("_se2", a + b)
        .withColumn("t", safe_ratio(F.col("mean") - F.col("mean0"), F.sqrt("_se2")))
        .withColumn("df", safe_ratio(F.col("_se2") ** 2, a ** 2 / (F.col("n") - 1) + b ** 2 / (F.col("n0") - 1)))
        .withColumn("p_value", t_two_sided("t", "df"))
    )


def _one_sample(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    """t and p from n, mean and var of differences; no variance or a single value gives NULL."""
    return grouped.withColumn(
        "t", F.when(F.col("var") > 0, F.col("mean") / F.sqrt(F.col("var") / F.col("n")))
    ).withColumn("p_value", t_two_sided("t", "(n - 1e0)"))


def paired(
    df: DataFrame, by: Sequence[str], pair_on: Sequence[str], metric: str, config: str, order: Sequence[str]
) -> DataFrame:
    """Paired t-test between neighbouring configurations, rows paired by `pair_on` within `by`.

    `order` lists the configurations; each is compared with the next one. Leave a column out of `by` and
    keep it in `pair_on` to pool over it.
    """
    following = {a: b for a, b in zip(order[:-1], order[1:])}
    keys = list(dict.fromkeys([*by, *pair_on]))
    step = F
    for a, b in following.items():
        step = step.when(F.col(config) == a, F.lit(b))
    low = df.withColumn("_next", step).filter("_next IS NOT NULL")
    low = low.select(*keys, F.col(config).alias("_low"), F.col("_next").alias(config), F.col(metric).alias("_a"))
    both = low.join(df.select(*keys, config, F.col(metric).alias("_b")), [*keys, config])
    named = both.withColumn("comparison", F.concat_ws(" -> ", F.col("_low").cast("string"), F.col(config).cast("string")))
    grouped = named.groupBy(*by, "comparison").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_a").alias("mean_fewer"), F.avg("_b").alias("mean_more"),
        F.avg(F.col("_b") - F.col("_a")).alias("mean"), F.var_samp(F.col("_b") - F.col("_a")).alias("var"),
    )
    return _one_sample(grouped, by).select(
        *by, "comparison", "n", "mean_fewer", "mean_more", F.col("mean").alias("delta"), "t", "p_value",
        _significant().alias("significant"),
    )


def one_sample(df: DataFrame, by: Sequence[str], metric: str, level: str = "level", baseline: int = 0) -> DataFrame:
    """One-sample t-test of every level against the baseline mean taken as a constant."""
    base_keys = list(by)
    base = df.filter(F.col(level) == baseline).groupBy(*base_keys).agg(F.avg(metric).alias("baseline"))
    moments = _moments(df.filter(F.col(level) != baseline), [*by, level], metric).join(base, base_keys)
    shifted = moments.withColumn("level_mean", F.col("mean")).withColumn("mean", F.col("mean") - F.col("baseline"))
    return _one_sample(shifted, by).select(
        *by, level, "baseline", F.col("level_mean").alias("mean"), (-F.col("mean")).alias("drop"), "t", "p_value",
        _significant().alias("significant"),
    )


# ---- correlation ---------------------------------------------------------------------------------


def _r_columns(r: str, n: str) -> tuple[Column, Column]:
    """t and p of a correlation coefficient; |r| = 1 has p = 0."""
    t = f"({r} * sqrt(({n} - 2e0) / (1e0 - {r} * {r})))"
    exact = f"abs({r}) >= 1e0"
    p = F.when(F.expr(f"{n} < 3"), F.lit(None)).when(F.expr(exact), F.lit(0.0)).otherwise(
        t_two_sided(f"(CASE WHEN {exact} THEN NULL ELSE {t} END)", f"({n} - 2e0)")
    )
    return F.expr(f"CASE WHEN {n} >= 3 AND NOT {exact} THEN {t} END"), p


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the rank of `value` within the group, ties sharing their mean rank.

    Ranks are made on the distinct values with their counts, so ties, however many, weigh one row.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranking.ordered_total(counts, by, value, "_before", F.col("_n"))
    ranks = placed.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out), "_n")
    return attach(df, ranks, [*by, value], [out], "_n", counts.agg(F.sum("_n")).scalar())


def correlations(df: DataFrame, by: Sequence[str], measures: Sequence[str], metric: str) -> DataFrame:
    """Pearson r and Spearman rho with p-values of every measure against the metric, per group.

    A measure with fewer than two distinct values in a group has no row.
    """
    by = list(by)
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])
    long = df.select(*by, F.col(metric).cast("double").alias("y"), F.explode(cells).alias("cell")).select(*by, "y", "cell.*")
    long = stage(long)
    keys = [*by, "measure"]
    ranked = average_ranks(average_ranks(long, keys, "x", "rx"), keys, "y", "ry")
    grouped = (
        ranked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_points"), F.min("x").alias("_lo"), F.max("x").alias("_hi"),
            F.corr("x", "y").alias("pearson_r"), F.corr("rx", "ry").alias("spearman_rho"),
        )
        .filter("_lo < _hi")
    )
    _, pearson_p = _r_columns("pearson_r", "n_points")
    _, spearman_p = _r_columns("spearman_rho", "n_points")
    return grouped.select(
        *keys, "n_points", "pearson_r", pearson_p.alias("pearson_p"), "spearman_rho", spearman_p.alias("spearman_p")
    )


def correlations_by_scope(
    df: DataFrame, model: str, config: str, measures: Sequence[str], metric: str, distinct_points: DataFrame
) -> DataFrame:
    """Correlations over all configurations (shared baseline counted once) and within each configuration."""
    pooled = distinct_points.withColumn("scope", F.lit("all"))
    single = df.withColumn("scope", F.col(config).cast("string"))
    return correlations(pooled.unionByName(single), [model, "scope"], measures, metric)


# ---- regression ----------------------------------------------------------------------------------


def ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares of y on an intercept and xs, per group: one row per term with se, t and p, plus R2.

    One aggregation gives counts, means and covariances; only these few numbers per group reach the
    solver, never the rows. A group with too few points or dependent xs keeps its terms, without values.
    """
    by, xs = list(by), list(xs)
    names = [*xs, y]
    products = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"c{i}_{j}") for i, j in products],
    )
    size = len(xs)

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n, free = int(row["n"]), int(row["n"]) - size - 1
                cov = np.empty((size + 1, size + 1))
                for i, j in products:
                    cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] * n
                mean = np.array([row[f"m{i}"] for i in range(size)])
                if free <= 0 or np.linalg.matrix_rank(cov[:size, :size]) < size:
                    out += [{**{k: row[k] for k in by}, "term": t, "n_points": n, "coef": None, "se": None, "r2": None} for t in ["intercept", *xs]]
                    continue
                inverse = np.linalg.inv(cov[:size, :size])
                slope = inverse @ cov[:size, size]
                rss = cov[size, size] - slope @ cov[:size, size]
                spread = rss / free
                beta = np.concatenate([[row[f"m{size}"] - slope @ mean], slope])
                variance = np.concatenate([[1 / n + mean @ inverse @ mean], np.diag(inverse)]) * spread
                for term, b, v in zip(["intercept", *xs], beta, variance):
                    out.append({**{k: row[k] for k in by}, "term": term, "n_points": n, "coef": float(b),
                                "se": float(max(v, 0.0) ** 0.5), "r2": float(1 - rss / cov[size, size])})
            yield pd.DataFrame(out, columns=[*by, "term", "n_points", "coef", "se", "r2"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in by)
    solved = moments.mapInPandas(solve, f"{fields}, term string, n_points long, coef double, se double, r2 double")
    tested = solved.withColumn("t", safe_ratio(F.col("coef"), F.col("se"))).withColumn(
        "p_value", t_two_sided("t", f"(n_points - {size + 1}e0)")
    )
    return tested.withColumn("significant", _significant())


def common_share_limit(df: DataFrame, config: str = "n_fd", share: str = "share", slack: float = 0.01) -> DataFrame:
    """One row: the share of dirty rows that every configuration reaches, plus a little slack."""
    return df.groupBy(config).agg(F.max(share).alias("top")).agg((F.min("top") + slack).alias("limit"))


def share_regression(df: DataFrame, model: str, y: str, share: str = "share", config: str = "n_fd") -> DataFrame:
    """y ~ share + share^2 + number of dependencies per model, on all points and on the common share range."""
    points = df.withColumn("share2", F.col(share) * F.col(share)).withColumn("scope", F.lit("all"))
    limit = common_share_limit(df, config, share).scalar()
    common = points.filter(F.col(share) <= limit).withColumn("scope", F.lit("common"))
    return ols(points.unionByName(common), [model, "scope"], y, [share, "share2", config])


def comparable_points(
    df: DataFrame, metric: str, model: str = "model", share: str = "share", config: str = "n_fd",
    level: str = "level", tolerance: float = 0.035,
) -> DataFrame:
    """Pairs of (configuration, level) points with a similar dirty share but different dependency counts.

    The band condition becomes an equality on share buckets of the width of the tolerance, where a point
    also enters the neighbouring buckets on one side of the join.
    """
    positive = df.filter(F.col(level) > 0)
    points = positive.groupBy(config, level).agg(F.avg(share).alias("share"), F.avg(metric).alias("score"))
    slot = F.floor(F.col("share") / tolerance).cast("bigint")
    low = points.select(
        F.col(config).alias("n_fewer"), F.col(level).alias("level_fewer"), F.col("share").alias("share_fewer"),
        F.col("score").alias("score_fewer"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"),
    )
    high = points.select(
        F.col(config).alias("n_more"), F.col(level).alias("level_more"), F.col("share").alias("share_more"),
        F.col("score").alias("score_more"), slot.alias("slot"),
    )
    matched = low.join(high, "slot").filter(
        (F.col("n_more") > F.col("n_fewer")) & (F.abs(F.col("share_more") - F.col("share_fewer")) <= tolerance)
    )
    per_model = positive.groupBy(config, level, model).agg(F.avg(metric).alias("m"))
    fewer = per_model.select(F.col(config).alias("n_fewer"), F.col(level).alias("level_fewer"), model, F.col("m").alias("m_fewer"))
    more = per_model.select(F.col(config).alias("n_more"), F.col(level).alias("level_more"), model, F.col("m").alias("m_more"))
    keys = ["n_fewer", "level_fewer", "n_more", "level_more"]
    votes = (
        matched.select(*keys).join(fewer, ["n_fewer", "level_fewer"]).join(more, ["n_more", "level_more", model])
        .groupBy(*keys)
        .agg(F.count_if(F.col("m_more") > F.col("m_fewer")).alias("models_better"), F.count(F.lit(1)).alias("models"))
    )
    return matched.join(votes, keys).select(
        *keys, "share_fewer", "share_more", "score_fewer", "score_more",
        (F.col("share_more") - F.col("share_fewer")).alias("delta_share"),
        (F.col("score_more") - F.col("score_fewer")).alias("delta_score"), "models_better", "models",
    )
