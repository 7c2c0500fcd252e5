"""Controlled corruption: an exact share of the rows gets values that break the dependencies.

Which rows are hit and which value replaces a cell are keyed draws, so a run can be repeated on any
cluster, and many versions (levels, replicas, folds) are made in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions import ranking
from tarnish.functions.hashing import draw, fingerprint
from tarnish.model import FD, corrupted_columns
from tarnish.operators import profile
from tarnish.session import stage

SMALL_DOMAIN = 5000


class Domains:
    """The values a column takes in a table, in a fixed order, so that an index names a value.

    A column with few distinct values (counted before) becomes one sorted array, read as a scalar. The
    values of any other column stay a table of (index, value) for a join on the index, whose draws are
    uniform, so no value can make that join skewed.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], small: int = SMALL_DOMAIN):
        self.columns = list(columns)
        estimate = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
        few = [c for c in columns if estimate[c] <= small]
        self.arrays, self.tables, self.sizes = None, {}, {}
        if few:
            ordered = {c: F.sort_array(F.transform(F.collect_set(c), self._entry)) for c in few}
            self.arrays = stage(df.agg(*[ordered[c].alias(c) for c in few]))
            counted = self.arrays.select(*[F.size(c).alias(c) for c in few]).first()
            self.sizes |= {c: counted[c] for c in few}
        for c in columns:
            if c not in few:
                values = df.select(F.col(c).alias("v")).filter("v IS NOT NULL").distinct()
                keyed = values.select(draw(F.col("v")).alias("h"), "v", F.col("v").cast("string").alias("t"))
                self.tables[c] = stage(ranking.running_total(keyed, [], "h", "t", "at").select("at", "v"))
                self.sizes[c] = self.tables[c].count()

    @staticmethod
    def _entry(value: Column) -> Column:
        return F.struct(draw(value).alias("h"), value.alias("v"))

    def pick(self, df: DataFrame, column: str, hit: str, key: Column, out: str) -> DataFrame:
        """Add `out`: on hit rows a value other than the current one, uniform over the others.

        With d values, index draw mod (d - 1) names a value other than the last; if that is the current
        one, the last value takes its place. So the index of the current value is never needed.
        """
        d = self.sizes[column]
        if d < 2:
            return df.withColumn(out, F.col(column))
        at = F.pmod(key, F.lit(d - 1))
        if column not in self.tables:
            values = self.arrays.select(column).scalar()
            drawn = values[at.cast("int")]["v"]
            other = F.when(drawn.eqNullSafe(F.col(column)), values[d - 1]["v"]).otherwise(drawn)
            return df.withColumn(out, F.when(F.col(hit), other).otherwise(F.col(column)))
        table = self.tables[column]
        last = table.filter(F.col("at") == d - 1).select("v").scalar()
        drawn = df.filter(F.col(hit)).withColumn("_at", at).join(table.withColumnRenamed("at", "_at"), "_at")
        other = F.when(F.col("v").eqNullSafe(F.col(column)), last).otherwise(F.col("v"))
        hits = drawn.withColumn(out, other).select(*df.columns, out)
        return hits.unionByName(df.filter(~F.col(hit)).withColumn(out, F.col(column)))


def _as_column(seed) -> Column:
    return seed if isinstance(seed, Column) else F.lit(str(seed))


def percent_of(level) -> object:
    """Quota of a whole-percent level: floor(n * level / 100)."""
    return lambda n, _: F.floor(n * level / 100)


def _require_percent(level) -> None:
    if not isinstance(level, int) or not 0 <= level <= 100:
        raise ValueError("a noise level is a whole percentage")


def inject_shared(
    df: DataFrame, columns: Sequence[str], level: int, seed, key: str = "row_id", domains: Domains | None = None
) -> DataFrame:
    """Corrupt the same rows in all columns; adds boolean `hit`.

    Values are drawn per (seed, column, row), so a configuration with more columns has exactly the
    values of a smaller one in the columns they share.
    """
    _require_percent(level)
    if level == 0 or not columns:
        return df.withColumn("hit", F.lit(False))
    domains = domains or Domains(df, columns)
    single = [c for c in columns if domains.sizes[c] < 2]
    if single:
        raise ValueError(f"columns with a single value cannot be corrupted: {single}")
    ordered = df.withColumn("_order", draw(seed, F.col(key)))
    out = ranking.flag_smallest(ordered, [], "_order", key, percent_of(level), "hit").drop("_order")
    return _replace(out, domains, columns, "hit", _as_column(seed), key, list(df.columns) + ["hit"])


def _replace(df, domains: Domains, columns, hit: str, seed: Column, key: str, result: Sequence[str]) -> DataFrame:
    out = df
    for c in columns:
        out = domains.pick(out, c, hit, draw(seed, F.lit(c), F.col(key)), f"_new_{c}")
    changed = set(columns)
    return out.select(*[F.col(f"_new_{c}").alias(c) if c in changed else F.col(c) for c in result])


def inject_independent(
    df: DataFrame,
    fds: Sequence[FD],
    level: int,
    seed,
    key: str = "row_id",
    corrupt_lhs: bool = True,
    domains: Domains | None = None,
    cuts: dict | None = None,
) -> DataFrame:
    """Corrupt rows chosen anew for each dependency, in its left, right and redundant columns.

    Values come from the clean table and differ from the current cell, which an earlier dependency may
    have changed already: a cell hit twice can return to its first value. `cuts` are those of
    `independent_cutoffs`, where they are known.
    """
    _require_percent(level)
    if level == 0:
        return df
    columns = corrupted_columns(fds, corrupt_lhs)
    domains = domains or Domains(df, columns)
    cuts = cuts or independent_cutoffs(df, len(fds), [level], seed, key)
    out = df
    for i, fd in enumerate(fds, 1):
        # The draw is a column of its own, as the test reads it twice.
        out = out.withColumn("_drawn", draw(seed, i, F.col(key)))
        out = out.withColumn("_hit", ranking.literal_within(F.col("_drawn"), F.col(key), cuts.get((level, i)))).drop("_drawn")
        part = corrupted_columns([fd], corrupt_lhs)
        out = _replace(out, domains, part, "_hit", F.concat(_as_column(seed), F.lit(f"|{i}")), key, df.columns)
    return out


def independent_cutoffs(df: DataFrame, n_fds: int, levels: Sequence[int], seed, key: str = "row_id") -> dict:
    """By (level, number of the dependency) the last row that is hit, for all of them from the same two passes."""
    draws = F.array(*[F.struct(F.lit(i).alias("fd"), draw(seed, i, F.col(key)).alias("h")) for i in range(1, n_fds + 1)])
    long = df.select(key, F.explode(draws).alias("d")).select(key, "d.fd", "d.h")
    long = long.withColumn("level", F.explode(F.array(*[F.lit(level) for level in levels])))
    cuts = ranking.cutoffs(long, ["fd", "level"], "h", key, lambda n, _: F.floor(n * F.col("level") / 100))
    return {(r["level"], r["fd"]): r["_cutoff"] for r in cuts.collect()}  # one for each


def inject_grid(
    df: DataFrame,
    columns: Sequence[str],
    levels: Sequence[int],
    replicas: Sequence[int],
    base_seed: int = 100,
    key: str = "row_id",
    domains: Domains | None = None,
) -> DataFrame:
    """All level x replica versions of the table in one plan; adds `level`, `replica` and `hit`.

    The seed of a version is base_seed + replica, so the rows hit at a level are also hit at every
    higher level of the same replica.
    """
    for level in levels:
        _require_percent(level)
    domains = domains or Domains(df, columns)
    seeds = F.array(
        *[F.struct(F.lit(r).alias("replica"), draw(base_seed + r, F.col(key)).alias("_order")) for r in replicas]
    )
    per_replica = df.withColumn("_v", F.explode(seeds)).select(*df.columns, "_v.replica", "_v._order")
    wanted = F.array(*[F.lit(level) for level in levels])
    long = per_replica.select(key, "replica", "_order").withColumn("level", F.explode(wanted))
    name = ranking.free_name(df, "_cutoff")
    cuts = ranking.cutoffs(long, ["replica", "level"], "_order", key, lambda n, _: F.floor(n * F.col("level") / 100), name)
    versions = per_replica.withColumn("level", F.explode(wanted)).join(cuts, ["replica", "level"])
    flagged = versions.withColumn("hit", ranking.within(F.col("_order"), F.col(key), name))
    seed = (F.lit(base_seed) + F.col("replica")).cast("string")
    return _replace(flagged, domains, columns, "hit", seed, key, [*df.columns, "level", "replica", "hit"])


def inject_per_fold(
    df: DataFrame, columns: Sequence[str], levels: Sequence[int], folds: int, base_seed: int = 1000,
    key: str = "row_id", fold: str = "fold",
) -> DataFrame:
    """Corrupted training sets of every fold and level; adds `train_fold`, `level` and `hit`.

    The seed is base_seed + 100 * fold + level and does not depend on the configuration.
    """
    domains = Domains(df, columns)
    train_fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    versions = (
        df.withColumn("train_fold", train_fold)
        .filter(F.col("train_fold") != F.col(fold))
        .withColumn("level", F.explode(F.array(*[F.lit(level) for level in levels])))
        .withColumn("_seed", (F.lit(base_seed) + F.col("train_fold") * 100 + F.col("level")).cast("string"))
        .withColumn("_order", draw(F.col("_seed"), F.col(key)))
    )
    strata = ["train_fold", "level"]
    name = ranking.free_name(df, "_cutoff")
    cuts = ranking.cutoffs(versions, strata, "_order", key, lambda n, _: F.floor(n * F.col("level") / 100), name)
    flagged = versions.join(cuts, strata).withColumn("hit", ranking.within(F.col("_order"), F.col(key), name))
    return _replace(flagged, domains, columns, "hit", F.col("_seed"), key, [*df.columns, *strata, "hit"])


# ---- measuring corruption ------------------------------------------------------------------------


def cells_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of the cells of some columns and of which of them are missing."""
    return F.xxhash64(*columns, F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]))


def changed_rows(clean: DataFrame, dirty: DataFrame, columns: Sequence[str], key: str = "row_id") -> DataFrame:
    """Per row id: `dirty`, whether any of the columns differs (two missing values are equal).

    Several columns are compared by a 64-bit hash of their cells, so rows meet with few bytes.
    """
    cells = cells_hash(columns) if len(columns) > 1 else F.col(columns[0])
    before = clean.select(key, cells.alias("_was"))
    now = dirty.select(key, cells.alias("_now"))
    return now.join(before, key).select(key, (~F.col("_now").eqNullSafe(F.col("_was"))).alias("dirty"))


def dirty_share(clean: DataFrame, dirty: DataFrame, columns: Sequence[str], key: str = "row_id") -> DataFrame:
    """One row: rows, rows that differ from the clean table, and their share."""
    marked = changed_rows(clean, dirty, columns, key)
    return marked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("dirty").alias("dirty_rows"),
        (F.count_if("dirty") / F.count(F.lit(1))).alias("dirty_share"),
    )


def independent_shares(
    clean: DataFrame, versions: Sequence[tuple[Sequence[FD], int]], seed, key: str = "row_id", domains: Domains | None = None
) -> DataFrame:
    """(n_fd, level, share): the `dirty_share` of each version (dependencies, level) of `inject_independent`.

    Only rows that corruption changed meet the clean table, as 64-bit hashes and those of all versions in one
    join; any other row differs from rows of its id just as the clean row does, which is counted once.
    """
    columns = corrupted_columns([fd for fds, _ in versions for fd in fds])
    domains = domains or Domains(clean, columns)
    cuts = independent_cutoffs(clean, max(len(fds) for fds, _ in versions), sorted({level for _, level in versions}), seed, key)
    sets = list(dict.fromkeys(tuple(corrupted_columns(fds)) for fds, _ in versions))
    hashes = clean.select(key, F.array(*[cells_hash(own) for own in sets]).alias("_cells"))
    changed = []
    for i, (fds, level) in enumerate(versions):
        own = corrupted_columns(fds)
        dirty = inject_independent(clean.select(key, *own, cells_hash(own).alias("_was")), fds, level, seed, key, domains=domains, cuts=cuts)
        now = dirty.select(key, F.lit(i).alias("_version"), F.lit(sets.index(tuple(own))).alias("_set"), cells_hash(own).alias("_now"), "_was", F.spark_partition_id().alias("_task"))
        # No filter moves below the number of the task: there it would work out the whole corruption once more.
        changed.append(now.filter("_now <> _was"))
    differs = lambda one, other: (F.col(one) != other).cast("bigint")
    cell = F.col("_cells")[F.col("_set")]
    met = reduce(DataFrame.unionByName, changed).join(hashes, key)
    more = met.groupBy("_version", "_task").agg(F.sum(differs("_now", cell) - differs("_was", cell)).alias("_more"))
    more = more.groupBy("_version").agg(F.sum("_more").alias("_more"))
    before = hashes.join(hashes.withColumnRenamed("_cells", "_other"), key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_cells")[k] != F.col("_other")[k]).alias(f"_{k}") for k in range(len(sets))])
    parts = [(i, len(fds), level, sets.index(tuple(corrupted_columns(fds)))) for i, (fds, level) in enumerate(versions)]
    rows = F.array(*[F.struct(F.lit(i).alias("_version"), F.lit(n).alias("n_fd"), F.lit(level).alias("level"), F.col(f"_{k}").alias("_before")) for i, n, level, k in parts])
    wide = before.select("_n", F.explode(rows).alias("row")).select("_n", "row.*")
    share = (F.col("_before") + F.coalesce("_more", F.lit(0))) / F.col("_n")
    return wide.join(F.broadcast(more), "_version", "left").select("n_fd", "level", share.alias("share"))


def modified_rows(
    clean: DataFrame, dirty: DataFrame, columns: Sequence[str], key: str = "row_id", by: Sequence[str] = ()
) -> DataFrame:
    """One row for each `by` of `dirty`: how many rows have another fingerprint than in the clean table."""
    names = sorted(columns)
    mark = F.unhex(fingerprint(*names))  # half as long as its text
    was = clean.select(key, mark.alias("_was"))
    now = dirty.select(key, *by, mark.alias("_now"))
    return now.join(was, key).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_now") != F.col("_was")).alias("modified")
    )


def guarantees(
    train: DataFrame, dirty_train: DataFrame, clean: DataFrame, test: DataFrame, level: int,
    columns: Sequence[str], fds: Sequence[FD], key: str = "row_id",
) -> DataFrame:
    """Expected and measured modified training rows, modified test rows, violations in the test rows.

    Training and test rows meet the clean ones in one join.
    """
    expected = train.agg(F.floor(F.count(F.lit(1)) * level / 100).cast("bigint").alias("v"))
    sides = dirty_train.select(key, *columns, F.lit("train").alias("_side")).unionByName(test.select(key, *columns, F.lit("test").alias("_side")))
    modified = stage(modified_rows(clean, sides, columns, key, ["_side"]))
    measured, touched = (modified.filter(F.col("_side") == side).agg(F.coalesce(F.sum("modified"), F.lit(0)).alias("v")) for side in ("train", "test"))
    violations = profile.violating_groups(test, fds).agg(F.sum("violations").alias("v"))
    parts = [
        p.select(F.lit(name).alias("measure"), F.col("v").cast("bigint").alias("value"))
        for name, p in (
            ("expected_modified_train", expected), ("modified_train", measured),
            ("modified_test", touched), ("violations_test", violations),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


def require_guarantees(report: DataFrame) -> None:
    """Stop unless exactly the expected training rows and no test row were modified."""
    got = {r["measure"]: r["value"] for r in report.collect()}  # four rows
    if got["modified_train"] != got["expected_modified_train"] or got["modified_test"] or got["violations_test"]:
        raise AssertionError(f"corruption guarantees broken: {got}")


def nested_check(smaller: DataFrame, larger: DataFrame, columns: Sequence[str], key: str = "row_id") -> DataFrame:
    """Rows in which a larger configuration differs from a smaller one on the columns of the smaller."""
    marked = changed_rows(smaller, larger, columns, key)
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("dirty").alias("different"))


def column_check(clean: DataFrame, dirty: DataFrame, columns: Sequence[str], level: int, key: str = "row_id") -> DataFrame:
    """Per column: changed cells, expected cells, and whether they agree within two points of the rows."""
    parts = []
    for c in columns:
        share = dirty_share(clean, dirty, [c], key)
        parts.append(share.select(F.lit(c).alias("column"), F.col("dirty_rows").alias("changed"),
                                  F.floor(F.col("n_rows") * level / 100).cast("bigint").alias("expected"),
                                  (F.abs(F.col("dirty_share") - level / 100) <= 0.02).alias("as_expected")))
    return reduce(DataFrame.unionByName, parts)


def expected_share_check(measured: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Measured dirty share of (n_fd, level) against 1 - (1 - level)^n_fd; adds the deviation and a verdict."""
    expected = 1 - F.pow(1 - F.col("level") / 100, F.col("n_fd"))
    deviation = F.abs(F.col("share") - expected)
    return measured.select("n_fd", "level", "share", expected.alias("expected"), deviation.alias("deviation"),
                           (deviation <= tolerance).alias("within"))
