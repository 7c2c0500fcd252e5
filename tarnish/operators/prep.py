"""Dataset preparation: binning, sampling, balancing, folds, imputation, scaling, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish.functions import ranking
from tarnish.functions.hashing import draw
from tarnish.session import stage
from tarnish.sources.tables import nan_to_null

# ---- binning -------------------------------------------------------------------------------------


def bucketize_right(
    value: Column, edges: Sequence[float | None], labels: Sequence, include_lowest: bool = False
) -> Column:
    """Label of the interval (lower, upper] that holds the value; a None edge is unbounded, outside is NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one label per interval")
    out = F
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        inside = F.lit(True)
        if low is not None:
            inside = (value >= low) if include_lowest and i == 0 else (value > low)
        if high is not None:
            inside = inside & (value <= high)
        out = out.when(value.isNotNull() & inside, F.lit(label))
    return out


SKETCH_SIZE = 2048  # of a quantile sketch; ranks are off by under 0.2 % of the rows
MARGIN = 0.005  # of the rows, on either side of a sketched quantile
FEW_ROWS = 10_000


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of any number of expressions, with linear interpolation; None for one without a value.

    One pass makes a mergeable sketch of each, which brackets every wanted rank. A second pass counts what
    lies below each bracket and the values inside, under a hundredth of the rows. The rank is then found
    in the sorted counts. A sketch that is off, which shows in the counts, costs that rank another pass
    over its whole range, so the result never depends on sketches.
    """
    names = list(columns)
    value = [columns[c].cast("double") for c in names]
    cells = df.select(*[F.when(~F.isnan(v), v).alias(f"x{i}") for i, v in enumerate(value)])
    sketch = [F.kll_sketch_agg_double(f"x{i}", SKETCH_SIZE) for i in range(len(names))]
    near = [[max(0.0, p - MARGIN), min(1.0, p + MARGIN)] for p in probabilities]
    ends = [
        F.when(F.count(f"x{i}") > 0, F.array(*[F.kll_sketch_get_quantile_double(sketch[i], F.lit(q)) for pair in near for q in pair])).alias(f"ends{i}")
        for i in range(len(names))
    ]
    facts = [f(f"x{i}").alias(f"{name}{i}") for i in range(len(names)) for name, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    row = cells.agg(*facts, *ends).first()
    ranks, brackets, places = {}, {}, {}
    for i in range(len(names)):
        n, low, high = row[f"n{i}"], row[f"low{i}"], row[f"high{i}"]
        for j, p in enumerate(probabilities if n else []):
            place = p * (n - 1)
            places[i, j] = place - int(place)
            for k, rank in enumerate((int(place), min(int(place) + 1, n - 1))):
                ranks[i, j, k] = rank
                brackets[i, j, k] = (low, high) if n <= FEW_ROWS else tuple(row[f"ends{i}"][2 * j : 2 * j + 2])
    found = _values_at(cells, ranks, brackets)
    lost = {key: rank for key, rank in ranks.items() if key not in found}
    if lost:
        found |= _values_at(cells, lost, {key: (row[f"low{key[0]}"], row[f"high{key[0]}"]) for key in lost})
    at = lambda i, j: found[i, j, 0] + (found[i, j, 1] - found[i, j, 0]) * places[i, j]
    return {c: [at(i, j) for j in range(len(probabilities))] if row[f"n{i}"] else None for i, c in enumerate(names)}


def _values_at(cells: DataFrame, ranks: dict[tuple, int], brackets: dict[tuple, tuple[float, float]]) -> dict[tuple, float]:
    """The value at each 0-based rank of an expression (first part of the key), if it lies in the bracket."""
    if not ranks:
        return {}
    wanted = sorted({(key[0], *brackets[key]) for key in ranks})
    cell = [
        F.when(F.col(f"x{i}") <= high, F.struct(F.lit(no).alias("no"), F.when(F.col(f"x{i}") >= low, F.col(f"x{i}")).alias("value")))
        for no, (i, low, high) in enumerate(wanted)
    ]
    inside = cells.select(F.explode(F.filter(F.array(*cell), lambda c: c.isNotNull())).alias("c"))
    counts = stage(inside.groupBy("c.no", "c.value").agg(F.count(F.lit(1)).alias("n")))
    below = counts.groupBy("no").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"))
    placed = ranking.ordered_total(counts.filter("value IS NOT NULL"), ["no"], "value", "before", F.col("n")).join(below, "no")
    number = {w: no for no, w in enumerate(wanted)}
    asked: dict[int, set[int]] = {}
    for key, rank in ranks.items():
        asked.setdefault(number[(key[0], *brackets[key])], set()).add(rank)
    rank_map = F.create_map(*[x for no, some in asked.items() for x in (F.lit(no), F.array(*[F.lit(r).cast("long") for r in sorted(some)]))])
    first = F.col("below") + F.col("before")
    hit = placed.withColumn("rank", F.explode(F.element_at(rank_map, F.col("no")))).filter((F.col("rank") >= first) & (F.col("rank") < first + F.col("n")))
    values = {(r["no"], r["rank"]): r["value"] for r in hit.select("no", "rank", "value").collect()}  # one row for each rank
    return {key: values[at] for key, rank in ranks.items() if (at := (number[(key[0], *brackets[key])], rank)) in values}


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Exact quantiles of one column with linear interpolation between the two neighbouring values."""
    found = quantiles(df, {column: F.col(column)}, probabilities)[column]
    if found is None:
        raise ValueError(f"{column} has no values")
    return found


def quantile_bins(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """Bins of equal row counts, numbered from 0; repeated edges are dropped, the lowest value is included."""
    edges = list(dict.fromkeys(exact_quantiles(df, column, [i / bins for i in range(bins + 1)])))
    if len(edges) == 1:
        return df.withColumn(out, F.when(F.col(column).isNotNull(), 0))
    return df.withColumn(out, bucketize_right(F.col(column), edges, range(len(edges) - 1), include_lowest=True))


# ---- columns and target --------------------------------------------------------------------------


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all (one pass)."""
    filled = nan_to_null(df).agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if not filled[c]])


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of missing values in each of the columns."""
    clean = nan_to_null(df.select(*columns))
    return clean.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def binarise_target(df: DataFrame, target: str, threshold: float = 15, max_classes: int = 10) -> DataFrame:
    """A numeric target with more than `max_classes` values becomes 1 above the threshold, else 0."""
    if not isinstance(df.schema[target].dataType, T.NumericType):
        return df
    if df.select(target).filter(F.col(target).isNotNull()).distinct().limit(max_classes + 1).count() <= max_classes:
        return df
    return df.withColumn(target, (F.col(target) > threshold).cast("int"))


def encode_labels(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Classes numbered 0..k-1 in sorted order; the numbering is made on the distinct classes only."""
    classes = df.select(target).filter(F.col(target).isNotNull()).distinct()
    numbered = stage(ranking.ordered_total(classes, [], target, out))
    return df.join(numbered, target, "left")


def feature_roles(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names by type; other types are no features."""
    numeric = (T.LongType, T.IntegerType, T.DoubleType)
    fields = [f for f in df.schema.fields if f.name not in exclude]
    return (
        [f.name for f in fields if isinstance(f.dataType, numeric)],
        [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))],
    )


# ---- sampling, balancing, folds ------------------------------------------------------------------


def _choose(df: DataFrame, strata: Sequence[str], quota, seed, key: str) -> DataFrame:
    ordered = df.withColumn("_order", draw(seed, F.col(key)))
    chosen = ranking.flag_smallest(ordered, strata, "_order", key, quota, "_chosen")
    return chosen.filter("_chosen").select(*df.columns)


def sample_rows(df: DataFrame, n: int, seed, key: str = "row_id") -> DataFrame:
    """Exactly n rows (all if there are fewer), chosen by the seed alone."""
    return _choose(df, [], lambda size, _: F.least(size, F.lit(n)), seed, key)


def stratified_sample(df: DataFrame, target: str, percent: int, seed, key: str = "row_id") -> DataFrame:
    """`percent` of the rows of every class, rounded half up per class."""
    return _choose(df, [target], lambda size, _: F.floor((size * percent * 2 + 100) / 200), seed, key)


def balance(df: DataFrame, target: str, seed, key: str = "row_id", cap: int | None = None) -> DataFrame:
    """Undersample every class to the size of the smallest one, and to `cap` if that is lower."""

    def quota(size, smallest):
        return smallest if cap is None else F.least(smallest, F.lit(cap))

    return _choose(df.filter(F.col(target).isNotNull()), [target], quota, seed, key)


def assign_folds(df: DataFrame, target: str, folds: int, seed, key: str = "row_id", out: str = "fold") -> DataFrame:
    """Stratified folds: class sizes per fold differ by at most one; a missing class is a class of its own."""
    ordered = df.withColumn("_order", draw(seed, F.col(key)))
    ranked = ranking.running_total(ordered, [target], "_order", key, "_rank", few=True)
    return ranked.withColumn(out, (F.col("_rank") % folds).cast("int")).drop("_order", "_rank")


def split_fold(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    return df.filter(F.col(column) != fold), df.filter(F.col(column) == fold)


def training_rows_per_fold(df: DataFrame, folds: int, column: str = "fold", out: str = "train_fold") -> DataFrame:
    """Every row once for each fold that trains on it."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter(F.col(out) != F.col(column))


def partition_check(train: DataFrame, test: DataFrame, whole: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: shared ids between train and test, and whether both together are the whole set."""
    sides = (
        train.select(key, F.lit(1).alias("tr"), F.lit(0).alias("te"), F.lit(0).alias("wh"))
        .unionByName(test.select(key, F.lit(0).alias("tr"), F.lit(1).alias("te"), F.lit(0).alias("wh")))
        .unionByName(whole.select(key, F.lit(0).alias("tr"), F.lit(0).alias("te"), F.lit(1).alias("wh")))
    )
    per_id = sides.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tr", "te", "wh")])
    return per_id.agg(
        F.count_if((F.col("tr") > 0) & (F.col("te") > 0)).alias("shared"),
        F.coalesce(F.bool_and(F.col("tr") + F.col("te") == F.col("wh")), F.lit(True)).alias("complete"),
    )


# ---- imputation and scaling ----------------------------------------------------------------------


def fit_means(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) of each numeric column after mean imputation; one pass."""
    clean = nan_to_null(train.select(*columns))
    row = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.var_pop(c).alias(f"v_{c}") for c in columns],
    ).first()
    # Imputed cells sit at the mean, so they add nothing to the sum of squares.
    return {
        c: (row[f"m_{c}"], ((row[f"v_{c}"] or 0.0) * row[f"n_{c}"] / row["n"]) ** 0.5) for c in columns
    }


def fit_modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each column, the smallest one on ties, as text; one shuffle for all columns."""
    cells = train.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("cell")
    )
    counted = cells.select("cell.*").filter("value IS NOT NULL").groupBy("name", "value").count()
    top = counted.groupBy("name").agg(F.min(F.struct((-F.col("count")).alias("rank"), "value")).alias("top"))
    return {r["name"]: r["top"]["value"] for r in top.collect()}  # one row per column


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of each column, all in the same two passes."""
    found = quantiles(nan_to_null(train.select(*columns)), {c: F.col(c) for c in columns}, [0.5])
    empty = [c for c in columns if found[c] is None]
    if empty:
        raise ValueError(f"{', '.join(empty)} has no values")
    return {c: found[c][0] for c in columns}


def impute(df: DataFrame, values: dict) -> DataFrame:
    """Replace missing cells by the fitted value of their column."""
    clean = nan_to_null(df)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    fill = {
        c: F.coalesce(F.col(c).cast("double") if isinstance(v, float) else F.col(c),
                      F.lit(v) if isinstance(v, float) else F.lit(v).cast(types[c]))
        for c, v in values.items()
    }
    return clean.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in df.columns])


def standardise(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean imputation and scaling by the population standard deviation; a constant column is only centred."""
    clean = nan_to_null(df)
    scaled = {
        c: (F.coalesce(F.col(c).cast("double"), F.lit(mean)) - F.lit(mean)) / F.lit(sd if sd > 0 else 1.0)
        for c, (mean, sd) in moments.items()
    }
    return clean.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])
