"""Inconsistency indices from grouped counts; the conflict graph itself is never built.

Two rows conflict when they agree on the left side of some dependency and differ on its right side.
IM counts conflicting pairs, IP rows in at least one conflict, IH the rows to change to repair the data.
Everything starts from the distinct combinations of the dependency columns with their row counts, a
partial aggregation that takes the weight out of hot groups before any shuffle. `by` columns (fold,
level, replica ...) measure many versions of a table in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions import ranking
from tarnish.functions.hashing import draw, encode
from tarnish.functions.joins import attach
from tarnish.functions.numeric import pairs, safe_ratio
from tarnish.model import FD, fd_columns
from tarnish.operators import prep, profile
from tarnish.session import stage
from tarnish.sources.tables import nan_to_null

COUNT = "decimal(38,0)"
SETS_AT_ONCE = 128  # column sets for which the counts are expanded in one pass


def require_complete(df: DataFrame, fds: Sequence[FD]) -> None:
    """Stop when a dependency column has missing values: comparing groups would not match comparing pairs."""
    gaps = prep.missing_counts(df, fd_columns(fds)).first().asDict()
    missing = [c for c, n in gaps.items() if n]
    if missing:
        raise ValueError(f"missing values in {missing}")


def combinations_of(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct combinations of the columns with their row count `n`."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*columns).agg(n.alias("n"))


def equal_pairs(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of rows that agree on all the columns."""
    groups = combinations_of(df, [*by, *columns])
    return groups.groupBy(*by).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).cast(COUNT).alias("equal_pairs"))


# ---- one dependency ------------------------------------------------------------------------------


def _classes(combos: DataFrame, fd: FD, by: Sequence[str], weight: str | None = "n") -> DataFrame:
    known = combos.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fd.lhs]))
    return combinations_of(known, [*by, *fd.columns], weight)


def _groups(combos: DataFrame, fd: FD, by: Sequence[str], keep: bool = False, weight: str | None = "n") -> DataFrame:
    """Per left side: rows, largest class, number of classes, pairs within classes [, kept value].

    The kept value is the most frequent right side, the smallest one on ties.
    """
    kept = [F.min(F.struct((-F.col("n")).alias("rank"), F.col(fd.rhs).alias("value"))).alias("best")] if keep else []
    return (
        _classes(combos, fd, by, weight)
        .groupBy(*by, *fd.lhs)
        .agg(
            F.sum("n").alias("g_n"),
            F.max("n").alias("g_max"),
            F.count(F.lit(1)).alias("g_classes"),
            F.sum(pairs(F.col("n"))).alias("g_same"),
            *kept,
        )
    )


def _counts(df: DataFrame, fds: Sequence[FD], by: Sequence[str]) -> DataFrame:
    return combinations_of(nan_to_null(df), [*by, *[c for c in fd_columns(fds) if c not in by]])


def im_single(df: DataFrame, fd: FD, by: Sequence[str] = ()) -> DataFrame:
    """Conflicting pairs of one dependency: pairs equal on the left minus pairs equal on both sides."""
    groups = _groups(_counts(df, [fd], by), fd, by)
    total = F.sum(pairs(F.col("g_n")) - F.col("g_same"))
    return groups.groupBy(*by).agg(F.coalesce(total, F.lit(0)).cast(COUNT).alias("im"))


def ih_single(df: DataFrame, fd: FD, by: Sequence[str] = ()) -> DataFrame:
    """Exact minimum repair of one dependency: in each group all rows but the largest class."""
    groups = _groups(_counts(df, [fd], by), fd, by)
    return groups.groupBy(*by).agg(F.coalesce(F.sum(F.col("g_n") - F.col("g_max")), F.lit(0)).alias("ih"))


def conflict_blocks(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = ()) -> DataFrame:
    """The conflict graph in linear size: one row per right-side class of a violating group.

    All `n` rows of a class conflict with all `later` rows of the classes after it (and with `others`
    rows in total). The sum of n * later is the number of edges, with no pair ever emitted.
    """
    # Each dependency counts its own columns: their combinations are few where those of all columns are nearly the rows.
    rows = nan_to_null(df)
    parts = []
    for i, fd in enumerate(fds, 1):
        classes = stage(_classes(rows, fd, by, None))
        groups = classes.groupBy(*by, *fd.lhs).agg(F.sum("n").alias("g_n"), F.count(F.lit(1)).alias("g_classes"))
        violating = groups.filter("g_classes > 1")
        total = groups.agg(F.sum("g_classes")).scalar()
        hit = attach_groups(classes, violating, [*by, *fd.lhs], ["g_n"], "g_classes", total)
        ordered = hit.withColumn("_o", draw(encode(F.col(fd.rhs)))).withColumn("_t", F.col(fd.rhs).cast("string"))
        summed = ranking.running_total(ordered, [*by, *fd.lhs], "_o", "_t", "_before", F.col("n"))
        parts.append(
            summed.select(
                *by,
                F.lit(i).alias("fd_no"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in fd.lhs]).alias("group_key"),
                F.col("_t").alias("value"),
                "n",
                (F.col("g_n") - F.col("_before") - F.col("n")).alias("later"),
                (F.col("g_n") - F.col("n")).alias("others"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def attach_groups(rows: DataFrame, groups: DataFrame, keys, values, size, total) -> DataFrame:
    """Rows of the given groups only, with the group values."""
    return attach(rows, groups, keys, values, size, total).filter(F.col(values[0]).isNotNull())


# ---- several dependencies ------------------------------------------------------------------------


def im_terms(fds: Sequence[FD]) -> dict[frozenset[str], int]:
    """Column sets and integer coefficients whose weighted equal-pair counts give IM.

    A pair is free of conflict when for every dependency it differs on the left or agrees on both sides:
    the product of (1 - [L] + [LR]), where [S] says that the pair agrees on S and [S][S'] = [S u S'].
    Multiplying out and merging equal column sets leaves few terms; those that cancel need no work.
    """
    product = {frozenset(): 1}
    for fd in fds:
        left, both = frozenset(fd.lhs), frozenset(fd.columns)
        grown: dict[frozenset[str], int] = {}
        for columns, factor in product.items():
            for extra, sign in ((frozenset(), 1), (left, -1), (both, 1)):
                grown[columns | extra] = grown.get(columns | extra, 0) + sign * factor
        product = {columns: factor for columns, factor in grown.items() if factor}
    return {columns: -factor for columns, factor in product.items() if columns}


def _im(combos: DataFrame, fds: Sequence[FD], by: Sequence[str], each: bool = False) -> DataFrame:
    """IM of all dependencies (and of `each` one alone as im_k): one pass of grouping sets over the counts."""
    factors = {"im": im_terms(fds)}
    if each:
        factors |= {f"im_{i}": im_terms([fd]) for i, fd in enumerate(fds, 1)}
    terms = list(dict.fromkeys(t for f in factors.values() for t in f))
    order = [*by, *[c for c in fd_columns(fds) if c not in by]]
    sets = [[c for c in order if c in by or c in t] for t in terms]
    code = {
        t: sum(1 << (len(order) - 1 - i) for i, c in enumerate(order) if c not in by and c not in t) for t in terms
    }
    batches = [sets[at : at + SETS_AT_ONCE] for at in range(0, len(sets), SETS_AT_ONCE)]
    grouped = [combos.groupingSets(some, *order).agg(F.grouping_id().alias("_set"), F.sum("n").alias("_n")) for some in batches]
    summed = [g.groupBy(*by, "_set").agg(F.sum(pairs(F.col("_n"))).alias("_pairs")) for g in grouped]
    per_set = reduce(DataFrame.unionByName, summed)

    def weighted(factor: dict[frozenset[str], int]) -> Column:
        chain = reduce(lambda acc, t: acc.when(F.col("_set") == code[t], F.lit(factor[t])), factor, F)
        return F.coalesce(F.sum(F.col("_pairs") * chain), F.lit(0)).cast(COUNT)

    return per_set.groupBy(*by).agg(*[weighted(factor).alias(name) for name, factor in factors.items()])


def im(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = ()) -> DataFrame:
    """Exact number of conflicting pairs over all dependencies, a pair counted once."""
    return _im(_counts(df, fds, by), fds, by)


def annotate(rows: DataFrame, fds: Sequence[FD], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Add, per dependency k, `conflict_k` (in a conflict) and `cover_k` (in its minimum cover)."""
    combos = stage(_counts(rows, fds, by)) if weight is None else rows
    total = combos.agg(F.sum("n")).scalar()
    out = rows
    for i, fd in enumerate(fds, 1):
        violating = (
            _groups(combos, fd, by, keep=True)
            .filter("g_classes > 1")
            .select(*by, *fd.lhs, "g_n", F.col("best.value").alias("_kept"))
        )
        out = attach(out, violating, [*by, *fd.lhs], ["_kept"], "g_n", total)
        out = (
            out.withColumn(f"conflict_{i}", F.col("_kept").isNotNull())
            .withColumn(f"cover_{i}", F.coalesce(F.col(fd.rhs) != F.col("_kept"), F.lit(False)))
            .drop("_kept")
        )
    return out


def _any(prefix: str, count: int) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"{prefix}_{i}") for i in range(1, count + 1)])


def conflict_mask(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = ()) -> DataFrame:
    """Rows with `in_conflict`: the row is in at least one conflict."""
    marked = annotate(df, fds, by)
    return marked.withColumn("in_conflict", _any("conflict", len(fds))).select(*df.columns, "in_conflict")


def cover_mask(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = ()) -> DataFrame:
    """Rows with `in_cover`: the union of the minimum covers of the single dependencies."""
    marked = annotate(df, fds, by)
    return marked.withColumn("in_cover", _any("cover", len(fds))).select(*df.columns, "in_cover")


def remove_cover(df: DataFrame, fds: Sequence[FD]) -> DataFrame:
    """The rows outside the cover; no violation remains among them."""
    return cover_mask(df, fds).filter(~F.col("in_cover")).drop("in_cover")


def _marked_sums(combos: DataFrame, fds: Sequence[FD], by: Sequence[str]) -> DataFrame:
    """IP, the cover of all dependencies, and per dependency the rows in conflict and in its cover."""
    marked = annotate(combos, fds, by, weight="n")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    k = len(fds)
    return marked.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        rows_where(_any("conflict", k)).alias("ip"),
        rows_where(_any("cover", k)).alias("ih"),
        *[rows_where(F.col(f"conflict_{i}")).alias(f"ip_{i}") for i in range(1, k + 1)],
        *[rows_where(F.col(f"cover_{i}")).alias(f"ih_{i}") for i in range(1, k + 1)],
    )


def ip(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = ()) -> DataFrame:
    """Rows in at least one conflict."""
    return _marked_sums(stage(_counts(df, fds, by)), fds, by).select(*by, "ip")


def ih_bounds(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = ()) -> DataFrame:
    """Lower bound (largest single-dependency cover) and upper bound (their union) of the minimum repair."""
    sums = _marked_sums(stage(_counts(df, fds, by)), fds, by)
    lower = F.greatest(*[F.col(f"ih_{i}") for i in range(1, len(fds) + 1)]) if len(fds) > 1 else F.col("ih_1")
    return sums.select(*by, lower.alias("ih_min"), F.col("ih"))


def indices(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = (), validate: bool = True) -> DataFrame:
    """IM, IP, IH, the lower bound of IH and IM per dependency, in one plan over one pre-aggregation.

    The pre-aggregation is written once: the table itself, often a costly plan, is read a single time.
    """
    combos = stage(_counts(df, fds, by))
    if validate:
        require_complete(combos, fds)
    counted = _im(combos, fds, by, each=True)
    k = range(1, len(fds) + 1)
    sums = _marked_sums(combos, fds, by)
    both = counted.unionByName(sums, allowMissingColumns=True).groupBy(*by)
    wide = both.agg(*[F.max(c).alias(c) for c in dict.fromkeys([*counted.columns, *sums.columns]) if c not in by])
    lower = F.greatest(*[F.col(f"ih_{i}") for i in k]) if len(fds) > 1 else F.col("ih_1")
    return wide.select(
        *by, "n_rows", "ip", "ih", lower.alias("ih_min"), "im", *[f"im_{i}" for i in k]
    )


def indices_by_fold(df: DataFrame, fds: Sequence[FD], folds: int, by: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """Indices on the training rows of every fold, then mean and sample deviation over the folds."""
    per_fold = indices(prep.training_rows_per_fold(df, folds, fold), fds, [*by, "train_fold"], validate=False)
    measures = ("im", "ip", "ih", "ih_min")
    return per_fold.groupBy(*by).agg(
        F.floor(F.avg("n_rows")).cast("bigint").alias("n_rows"),
        *[F.avg(F.col(m).cast("double")).alias(f"{m}_mean") for m in measures],
        *[F.stddev_samp(F.col(m).cast("double")).alias(f"{m}_sd") for m in measures],
    )


def mechanism(df: DataFrame, fds: Sequence[FD], by: Sequence[str] = ()) -> DataFrame:
    """How the indices come about, per dependency: groups and their sizes, pairs, conflicts, rows involved."""
    rows = nan_to_null(df)  # each dependency counts its own columns, see `conflict_blocks`
    parts = []
    for i, fd in enumerate(fds, 1):
        same_lhs = F.coalesce(F.sum(pairs(F.col("g_n"))), F.lit(0)).cast(COUNT)
        conflicts = F.coalesce(F.sum(pairs(F.col("g_n")) - F.col("g_same")), F.lit(0)).cast(COUNT)
        parts.append(
            _groups(rows, fd, by, weight=None)
            .groupBy(*by)
            .agg(
                F.lit(i).alias("fd_no"),
                F.lit(fd.name).alias("fd"),
                F.count(F.lit(1)).alias("n_groups"),
                (F.sum("g_n") / F.count(F.lit(1))).alias("mean_size"),
                F.max("g_n").alias("max_size"),
                same_lhs.alias("same_lhs_pairs"),
                conflicts.alias("conflicts"),
                F.coalesce(safe_ratio(conflicts, same_lhs), F.lit(0e0)).alias("conflict_share"),
                F.coalesce(F.sum(F.when(F.col("g_classes") > 1, F.col("g_n"))), F.lit(0)).alias("rows_involved"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def mechanism_faithful(table: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """With one dependency its conflicts are IM: whether both measurements agree, per `by`."""
    if not by:
        table, totals, by = table.withColumn("_all", F.lit(1)), totals.withColumn("_all", F.lit(1)), ["_all"]
    both = table.select(*by, "conflicts").join(totals.select(*by, "im"), list(by))
    return both.select(*by, "conflicts", "im", (F.col("conflicts") == F.col("im")).alias("faithful")).drop("_all")


def require_clean(df: DataFrame, fds: Sequence[FD]) -> None:
    """Pre-flight gate: the reference data must have no violation and no conflicting pair."""
    if profile.count_violations(df, fds):
        raise ValueError("the reference data violates its dependencies")
    if im(df, fds).first()["im"]:
        raise ValueError("the reference data has conflicting pairs")
