"""Training on corrupted rows and scoring on clean and corrupted ones; metrics from confusion counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnish.functions import forest, joins, ranking
from tarnish.functions.hashing import encode
from tarnish.model import FD
from tarnish.operators import noise, prep
from tarnish.session import stage
from tarnish.sources.tables import nan_to_null

METRICS = ("accuracy", "precision", "recall", "f1", "f1_macro")

# ---- metrics -------------------------------------------------------------------------------------


def confusion(predictions: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts of (label, prediction) per group."""
    return predictions.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def metrics(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, weighted precision / recall / F1 and macro F1; a class never predicted has precision 0."""
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = (
        matrix.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "cls")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    zero = F.lit(0e0)
    scored = per_class.withColumn(
        "p", F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(zero)
    ).withColumn("r", F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(zero)).withColumn(
        "f", 2 * F.col("hits") / (F.col("support") + F.col("predicted"))
    )
    total = F.sum("support")

    def weighted(c: str):
        return F.sum(F.col(c) * F.col("support")) / total

    return scored.groupBy(*by).agg(
        total.alias("n_rows"), (F.sum("hits") / total).alias("accuracy"), weighted("p").alias("precision"),
        weighted("r").alias("recall"), weighted("f").alias("f1"), F.avg("f").alias("f1_macro"),
    )


def weighted_macro_gap(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The largest difference between weighted and macro F1: small when classes are balanced."""
    return scores.groupBy(*by).agg(F.max(F.abs(F.col("f1") - F.col("f1_macro"))).alias("max_gap"))


def fold_summary(scores: DataFrame, by: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample deviation over folds; a failed fold (NULL) makes the mean NULL, as it is no result."""
    whole = F.count(F.lit(1))
    return scores.groupBy(*by).agg(
        whole.alias("folds"),
        *[F.when(F.count(m) == whole, F.avg(m)).alias(f"{m}_mean") for m in names],
        *[F.when(F.count(m) == whole, F.stddev_samp(m)).alias(f"{m}_sd") for m in names],
    )


# ---- one column alone ----------------------------------------------------------------------------


def univariate_confusion(
    df: DataFrame, columns: Sequence[str], target: str, folds: int, fold: str = "fold", leaf: int = 1
) -> DataFrame:
    """Out-of-fold predictions of each categorical column alone, as confusion counts per (column, fold).

    A fully grown tree on one category predicts the majority class of the value, so counts suffice: the
    training count of a fold is the total minus the fold's own count. Ties go to the smallest class; a
    value unseen in training gets the majority class of the training rows.

    Each cut takes one value from the rest. With a smallest `leaf`, values of fewer training rows cannot be
    cut off and stay together as the rest, and if the rest alone is too small, so does the value whose cut
    lowers the Gini impurity of all rows least (the largest one of equals). The rest has one majority
    class, which unseen values get too.
    """
    names = F.array(*[F.lit(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(i).alias("at"), encode(F.col(c)).alias("value")) for i, c in enumerate(columns)])
    long = df.select(F.col(target).alias("label"), F.col(fold).alias("_f"), F.explode(cells).alias("cell"))
    own = [F.count_if(F.col("_f") == f).alias(f"_n{f}") for f in range(folds)]
    counts = long.groupBy("cell.at", "cell.value", "label").agg(F.count(F.lit(1)).alias("_all"), *own)
    # One row for each value with the counts of its classes, written once: all that follows is small sums over it.
    classes = F.collect_list(F.struct("label", "_all", *[f"_n{f}" for f in range(folds)])).alias("classes")
    values = stage(counts.groupBy("at", "value").agg(classes))

    def votes(f: int) -> Column:
        return F.transform("classes", lambda c: F.struct(c["label"].alias("label"), c[f"_n{f}"].alias("n"), (c["_all"] - c[f"_n{f}"]).alias("train")))

    spread = values.select("at", "value", F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), votes(f).alias("votes")) for f in range(folds)])))
    fallback = (
        spread.filter("at = 0").select("fold", F.inline("votes")).groupBy("fold", "label").agg((-F.sum("train")).alias("rank"))
        .groupBy("fold").agg(F.min(F.struct("rank", "label")).getField("label").alias("_default"))
    )
    ranked = F.transform(F.filter("votes", lambda v: v["train"] > 0), lambda v: F.struct((-v["train"]).alias("rank"), v["label"].alias("label")))
    voted = spread.withColumn("_best", F.array_min(ranked))
    if leaf > 1:
        marked, pool = _rest(spread, leaf)
        alone = F.struct(F.lit(0).cast("long").alias("rank"), F.col("_pool").alias("label"))
        voted = (
            marked.withColumn("_best", F.array_min(ranked)).join(F.broadcast(pool), ["at", "fold"], "left")
            .withColumn("_best", F.when(F.col("_pooled") | (F.col("rows") == 0), F.when(F.col("_pool").isNotNull(), alone)).otherwise(F.col("_best")))
        )
    choice = F.coalesce(F.col("_best.label"), F.col("_default"))
    predicted = voted.join(F.broadcast(fallback), "fold").select("at", "fold", choice.alias("prediction"), F.inline("votes")).filter("n > 0")
    summed = predicted.groupBy("at", "fold", "label", "prediction").agg(F.sum("n").alias("n"))
    return summed.select(F.get(names, F.col("at")).alias("column"), "fold", "label", "prediction", "n")


def _rest(spread: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """The values of each (column, fold) that no cut can take off, see `univariate_confusion`.

    Returns `spread` with `rows` and `_pooled`, and per (at, fold) the majority class `_pool` of the pooled values.
    What is joined has a row for each column and fold.
    """
    keys = ["at", "fold"]
    total = lambda term, zero: F.aggregate("votes", zero, lambda n, v: n + term(v))
    per_class = spread.select(*keys, F.inline("votes")).groupBy(*keys, "label").agg(F.sum("train").alias("all"))
    whole = stage(per_class.groupBy(*keys).agg(
        F.sum("all").alias("_n"), F.sum((F.col("all") * F.col("all")).cast("double")).alias("_squares"), F.collect_list(F.struct("label", "all")).alias("_classes")
    ))
    of_all = lambda v: F.coalesce(F.get(F.filter("_classes", lambda c: c["label"] == v["label"]), F.lit(0))["all"], F.lit(0))
    # What a cut leaves: the squares of the other rows' class counts, from sums of products.
    counted = spread.withColumn("rows", total(lambda v: v["train"], F.lit(0).cast("long"))).join(F.broadcast(whole), keys)
    own = total(lambda v: (v["train"] * v["train"]).cast("double"), F.lit(0e0))
    both = total(lambda v: v["train"] * of_all(v).cast("double"), F.lit(0e0))
    left = (F.col("_squares") - 2 * both + own) / F.nullif(F.col("_n") - F.col("rows"), F.lit(0))
    gained = counted.withColumn("gain", F.when(F.col("rows") > 0, own / F.nullif("rows", F.lit(0)) + left)).select(*keys, "value", "votes", "rows", "gain")
    # Missing classes weigh in nothing, and a value without any other takes no part.
    seen = (F.col("rows") > 0) & F.exists("votes", lambda v: v["label"].isNotNull())
    cuttable = F.col("rows") >= leaf
    small = gained.filter(seen).groupBy(*keys).agg(
        F.sum(F.when(~cuttable, F.col("rows"))).alias("_small"), F.min(F.when(cuttable, F.col("gain"))).alias("_least"),
    )
    small = stage(small)
    near = gained.join(F.broadcast(small), keys, "left")
    last = stage(near.filter((F.col("_small") < leaf) & seen & cuttable & (F.col("gain") == F.col("_least"))).groupBy(*keys).agg(F.max("value").alias("_last")))
    pooled = seen & (~cuttable | F.coalesce(F.col("value") == F.col("_last"), F.lit(False)))
    marked = gained.join(F.broadcast(last), keys, "left").select(*keys, "value", "votes", "rows", pooled.alias("_pooled"))
    votes = marked.filter("_pooled").select(*keys, F.inline("votes")).groupBy(*keys, "label").agg(F.sum("train").alias("votes")).filter("votes > 0")
    return marked, stage(votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("rank"), "label")).getField("label").alias("_pool")))


def univariate_power(
    df: DataFrame, columns: Sequence[str], target: str, folds: int, fold: str = "fold", leaf: int = 1
) -> DataFrame:
    """Weighted F1 of each categorical column alone: mean and population deviation over folds."""
    scores = metrics(univariate_confusion(df, columns, target, folds, fold, leaf), ["column", "fold"])
    return scores.groupBy("column").agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_sd"))


def nearest_seen(values: DataFrame, keys: Sequence[str], order: str, seen: Column) -> DataFrame:
    """Add `below` and `above`: the nearest values of `order` that are `seen`, the own one included, per key.

    Rows (distinct in keys and order) are range-partitioned; inside a range a running maximum gives the
    nearest, and the ends of all ranges, one row for each, carry over where a range has none.
    """
    keys = list(keys)
    ranged = stage(values.withColumn("_v", F.when(seen, F.col(order))).repartitionByRange(*keys, order).withColumn("_p", F.spark_partition_id()))
    up = W.partitionBy(*keys, "_p").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(*keys, "_p").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)
    ends = ranged.groupBy(*keys, "_p").agg(F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    ends = ends.select(*keys, "_p", F.max("_hi").over(before).alias("_from"), F.min("_lo").over(after).alias("_to"))
    inside = ranged.withColumn("_b", F.max("_v").over(up)).withColumn("_a", F.min("_v").over(down))
    return (
        inside.join(ends, [*keys, "_p"])
        .withColumn("below", F.coalesce("_b", "_from"))
        .withColumn("above", F.coalesce("_a", "_to"))
        .drop("_v", "_p", "_b", "_a", "_from", "_to")
    )


def leaf_choices(values: DataFrame, keys: Sequence[str], order: str, votes: str, leaf: int) -> DataFrame:
    """(keys, order, choice): the place of the majority class in the leaf that each value of one number falls in.

    `values` are distinct in keys and order and hold an array of rows by class. The tree is fully grown: a
    node is cut between two values where the Gini impurity falls most (the lowest cut of equals), as long
    as both sides have at least `leaf` rows. A node is a stretch of the sorted values, so running totals,
    made once, give the class counts on both sides of every cut: a level of the tree is one pass of
    grouped maxima over all its nodes, for all keys at once. Ties go to the first class.
    """
    keys = list(keys)
    width = values.select(F.max(F.size(votes))).first()[0] or 1
    spread = values.select(*keys, order, *[F.get(votes, F.lit(k)).alias(f"_c{k}") for k in range(width)])
    run = ranking.ordered_totals(spread, keys, order, {f"_b{k}": F.col(f"_c{k}") for k in range(width)})
    array = lambda f: F.array(*[f(k) for k in range(width)])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x)
    squares = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x * x)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    # `upto`: class counts up to this value; a node is (rows before it, class counts before it and up to its end).
    run = run.select(*keys, order, array(lambda k: F.col(f"_b{k}") + F.col(f"_c{k}")).alias("upto"))
    ends = run.groupBy(*keys).agg(F.max_by("upto", order).alias("end"))
    open_ = run.join(ends, keys).withColumn("start", array(lambda k: F.lit(0).cast("long")))
    done = []
    while True:
        whole = minus(F.col("end"), F.col("start"))
        inside = total(whole)
        mixed = (F.array_max(whole) < inside) & (inside >= 2 * leaf)
        left, right = minus(F.col("upto"), F.col("start")), minus(F.col("end"), F.col("upto"))
        n_left, n_right = total(left), total(right)
        gain = F.when(mixed & (n_left >= leaf) & (n_right >= leaf), squares(left) / n_left + squares(right) / n_right)
        open_ = stage(open_.withColumn("node", total(F.col("start"))).withColumn("gain", gain))
        cut = F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col(order)).alias("low"), "upto"))).alias("cut")
        cuts = open_.groupBy(*keys, "node").agg(cut)
        joined = open_.drop("gain").join(cuts, [*keys, "node"]).drop("node")
        best = F.transform(whole, lambda x: -x)
        done.append(joined.filter("cut IS NULL").select(*keys, order, (F.array_position(best, F.array_min(best)) - 1).cast("int").alias("choice")))
        lower = F.col(order) <= -F.col("cut.low")
        split = joined.filter("cut IS NOT NULL").select(
            *keys, order, "upto", F.when(lower, F.col("start")).otherwise(F.col("cut.upto")).alias("start"),
            F.when(lower, F.col("cut.upto")).otherwise(F.col("end")).alias("end"),
        )
        open_ = stage(split)
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def numeric_confusion(df: DataFrame, column: str, target: str, folds: int, fold: str = "fold", leaf: int = 1) -> DataFrame:
    """Out-of-fold predictions of one numeric column alone, as confusion counts per fold.

    A fully grown tree on one number predicts the majority class of the value, the smallest class on
    ties; a value that training has not seen gets the class of the nearest one, the lower one if two
    are as near, because cuts lie in the middle. Missing values, in training and test, are the median of
    the fold's training rows. Counts of values suffice, so neither depth nor number of cuts is limited.
    With a smallest `leaf` the tree is grown level by level, see `leaf_choices`; all classes are counted side
    by side then, so their number has to be small.
    """
    rows = nan_to_null(df.select(F.col(column).cast("double").alias("x"), F.col(target).alias("label"), F.col(fold).alias("_f")))
    medians = [None] * folds
    if not rows.filter("x IS NULL").isEmpty():
        medians = [m and m[0] for m in prep.quantiles(rows, {str(f): F.when(F.col("_f") != f, F.col("x")) for f in range(folds)}, [0.5]).values()]
    own = [F.count_if(F.col("_f") == f).alias(f"_n{f}") for f in range(folds)]
    counts = rows.groupBy("x", "label").agg(F.count(F.lit(1)).alias("_all"), *own)
    per_fold = F.array(
        *[F.struct(F.lit(f).alias("fold"), F.coalesce("x", F.lit(medians[f]).cast("double")).alias("x"), F.col(f"_n{f}").alias("n")) for f in range(folds)]
    )
    cells = counts.withColumn("_x", F.explode(per_fold)).groupBy("_x.fold", "_x.x", "label").agg(
        F.sum("_x.n").alias("n"), F.sum(F.col("_all") - F.col("_x.n")).alias("train")
    )
    cells = stage(cells)
    vote = F.when(F.col("train") > 0, F.struct((-F.col("train")).alias("rank"), "label"))
    values = cells.groupBy("fold", "x").agg(F.min(vote).getField("label").alias("choice"))
    if leaf > 1:
        classes = [r[0] for r in cells.select("label").distinct().orderBy("label").collect()]  # the classes of the target
        count = lambda c: F.coalesce(F.sum(F.when(F.col("label") == c, F.col("train"))), F.lit(0)).cast("long")
        seen = cells.filter("train > 0").groupBy("fold", "x").agg(F.array(*[count(c) for c in classes]).alias("votes"))
        leaves = leaf_choices(seen, ["fold"], "x", "votes", leaf)
        label = F.get(F.array(*[F.lit(c) for c in classes]), F.col("choice")).alias("choice")
        values = values.drop("choice").join(leaves.select("fold", "x", label), ["fold", "x"], "left")
    near = nearest_seen(values, ["fold"], "x", F.col("choice").isNotNull())
    closer = F.when(F.col("above").isNull() | (F.col("x") - F.col("below") <= F.col("above") - F.col("x")), F.col("below")).otherwise(F.col("above"))
    seen = near.filter("choice IS NOT NULL").select("fold", F.col("x").alias("_like"), F.col("choice").alias("prediction"))
    chosen = near.select("fold", "x", closer.alias("_like")).join(seen, ["fold", "_like"])
    return cells.filter("n > 0").join(chosen, ["fold", "x"]).groupBy("fold", "label", "prediction").agg(F.sum("n").alias("n"))


def numeric_power(df: DataFrame, column: str, target: str, folds: int, fold: str = "fold", leaf: int = 1) -> DataFrame:
    """Weighted F1 of one numeric column alone: mean and population deviation over folds."""
    scores = metrics(numeric_confusion(df, column, target, folds, fold, leaf), ["fold"])
    return scores.agg(F.lit(column).alias("column"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_sd"))


def screen_targets(
    df: DataFrame, targets: dict[str, str | tuple[str, int]], columns: Sequence[str], folds: int, seed, cap: int | None = None,
    key: str = "row_id", leaf: int = 1,
) -> DataFrame:
    """Candidate targets x columns: classes, rows, chance level and F1 of each column alone.

    `targets` maps a display name to a target column, or to a numeric one and a number of quantile bins that
    make its classes. Classes are balanced (and, if the caller says so, capped); numbers are ranked next to
    categories; a column that occurs in the name of the target is skipped. `leaf` is the smallest leaf.
    """
    sources = [t if isinstance(t, str) else t[0] for t in targets.values()]
    wanted = [key, *dict.fromkeys([*sources, *columns])]
    whole = stage(df.select(*wanted))
    parts = []
    for name, target in targets.items():
        rows = whole
        if not isinstance(target, str):
            source, bins = target
            target = ranking.free_name(whole, "target")
            rows = prep.quantile_bins(whole, source, bins, target)
        usable = [c for c in columns if c not in name and c != target]
        balanced = stage(prep.balance(rows.select(key, *dict.fromkeys([target, *usable])), target, seed, key, cap))
        folded = prep.assign_folds(balanced, target, folds, seed, key)
        size = balanced.agg(F.count_distinct(target).alias("classes"), F.count(F.lit(1)).alias("n_rows"))
        facts = size.select(F.lit(name).alias("target"), "classes", "n_rows", (1 / F.col("classes")).alias("chance")).first()
        numeric, categorical = prep.feature_roles(folded.select(*usable), [])
        powers = [univariate_power(folded, categorical, target, folds, leaf=leaf)] if categorical else []
        power = reduce(DataFrame.unionByName, [*powers, *[numeric_power(folded, c, target, folds, leaf=leaf) for c in numeric]])
        parts.append(
            power.select(
                F.lit(name).alias("target"), F.lit(facts["classes"]).alias("classes"), F.lit(facts["n_rows"]).alias("n_rows"),
                F.lit(facts["chance"]).alias("chance"), "column", "f1_mean",
            )
        )
    return reduce(DataFrame.unionByName, parts)


# ---- models --------------------------------------------------------------------------------------


def default_models(n_rows: int, n_features: int, n_classes: int) -> dict[str, Estimator]:
    """The four classifiers with plain settings and a fixed seed."""
    return {
        "logistic regression": LogisticRegression(
            maxIter=1000, regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False
        ),
        "random forest": RandomForestClassifier(
            numTrees=100, maxDepth=30, seed=42
        ),
        "decision tree": DecisionTreeClassifier(maxDepth=30, seed=42),
        "neural network": MultilayerPerceptronClassifier(
            layers=[n_features, 100, n_classes], maxIter=1000, seed=42
        ),
    }


class CategoryCodes:
    """Numbers 0, 1, ... for the values of text columns, in their order; the driver holds only how many there are.

    The dictionary is a staged table (column, value, code, n) made by one grouping of all columns together and
    a ranked range sort. Rows get their codes by joins: broadcast for up to a thousand values, else with hot
    values apart. Missing values and values that the dictionary lacks get the number of values, one above all codes.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        cells = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(columns)])
        self.sizes: dict[str, int] = {}
        if not columns:
            return
        values = df.select(F.explode(cells).alias("x")).filter("x.value IS NOT NULL").groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
        self.table = stage(ranking.ordered_total(values, ["column"], "value", "code"))
        found = self.table.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).collect()  # a row for each column
        facts = {r["column"]: r for r in found}
        self.places = {c: k for k, c in enumerate(columns) if k in facts}
        self.sizes = {c: facts[k]["values"] for c, k in self.places.items()}
        self.rows = {c: facts[k]["rows"] for c, k in self.places.items()}

    def attach(self, df: DataFrame) -> DataFrame:
        """`df` with `_i_<column>` as a double for each column that has values."""
        for c, size in self.sizes.items():
            code = f"_i_{c}"
            known = self.table.filter(F.col("column") == self.places[c]).select(F.col("value").alias(c), F.col("code").alias(code), F.col("n").alias("_n"))
            if size <= joins.HOT_KEYS:
                df = df.join(F.broadcast(known.drop("_n")), c, "left")
            else:
                df = joins.attach(df, known, [c], [code], "_n", self.rows[c])
            df = df.withColumn(code, F.coalesce(F.col(code), F.lit(size)).cast("double"))
        return df

    def encoder(self, spark: SparkSession):
        """One-hot vectors `_h_<column>` of the codes; all zeros for the number above them."""
        coded = [f"_i_{c}" for c in self.sizes]
        largest = spark.createDataFrame([tuple(float(n - 1) for n in self.sizes.values())], coded)
        # The slot kept for unknown categories comes last and is the one dropped: unknown means all zeros.
        hot = OneHotEncoder(inputCols=coded, outputCols=[f"_h_{c}" for c in self.sizes], handleInvalid="keep", dropLast=True)
        return hot.fit(largest)


class Features:
    """Preprocessing fitted on training rows only: imputation, population scaling, one-hot of known categories."""

    def __init__(self, train: DataFrame, target: str, ignore: Sequence[str] = ()):
        self.numeric, self.categorical = prep.feature_roles(train, [target, *ignore])
        self.target = target
        self.moments = prep.fit_means(train, self.numeric) if self.numeric else {}
        self.modes = prep.fit_modes(train, self.categorical) if self.categorical else {}
        ready = self._clean(train)
        self.labels = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(ready)
        self.codes = CategoryCodes(ready, self.categorical)
        self.onehot = None
        if self.codes.sizes:
            self.onehot = self.codes.encoder(train.sparkSession)
        hot = [f"_h_{c}" for c in self.codes.sizes]
        self.assembler = VectorAssembler(inputCols=[*self.numeric, *hot], outputCol="features")

    def _clean(self, df: DataFrame) -> DataFrame:
        scaled = prep.standardise(df, self.moments)
        texts = scaled.select(*[F.col(c).cast("string").alias(c) if c in self.categorical else F.col(c) for c in df.columns])
        return prep.impute(texts, self.modes)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = self.codes.attach(self.labels.transform(self._clean(df)))
        if self.onehot:
            out = self.onehot.transform(out)
        return self.assembler.transform(out).select(*keep, "label", "features")


ROWS_A_TASK = 20_000
FITS_AT_ONCE = 12  # fits on a bounded sample, each of which is one small task after the other


def _ready(train: DataFrame, target: str, ignore: Sequence[str], fit_rows: int | None, key: str) -> tuple[Features, DataFrame]:
    """The features fitted on the training rows, or on a bounded sample of them, and these rows as vectors, kept in memory."""
    if fit_rows is not None:
        train = stage(prep.sample_rows(train, fit_rows, "fit", key))
    features = Features(train, target, ignore)
    # Fits pass over the rows many times; a bounded sample is spread over no more tasks than it can fill.
    ready = features.transform(train)
    return features, (ready if fit_rows is None else ready.coalesce(-(-fit_rows // ROWS_A_TASK))).persist()


def _fit(ready: DataFrame, name: str, n_classes: int) -> Model:
    n_rows, width = ready.count(), len(ready.first()["features"])
    return default_models(n_rows, width, n_classes)[name].fit(ready)


def predictions(features: Features, fitted: dict[str, Model], tests: dict[str, DataFrame]) -> DataFrame:
    """Confusion counts per (model, test set): one pass over all test rows, in which every model predicts."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_test", F.lit(kind)) for kind, df in tests.items()])
    said = features.transform(rows, ["_test"])
    for i, model in enumerate(fitted.values()):
        said = forest.predict(model, said, f"_p{i}")
    said = said.groupBy("_test", "label", *[f"_p{i}" for i in range(len(fitted))]).agg(F.count(F.lit(1)).alias("n"))
    votes = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, name in enumerate(fitted)])
    spread = said.select(F.explode(votes).alias("v"), F.col("_test").alias("test"), "label", "n")
    return spread.groupBy("v.model", "test", "label", "v.prediction").agg(F.sum("n").alias("n"))


def _fit_and_score(
    cases: Sequence[tuple[DataFrame, dict[str, DataFrame]]], target: str, ignore: Sequence[str], models, fit_rows, key
) -> list[DataFrame]:
    """Confusion counts per (model, test set) of each case (training rows, test sets by name); all test rows are scored.

    Fits on a bounded sample are short tasks one after the other, so those of all cases and models run side by side.
    """
    spark = cases[0][0].sparkSession
    names = list(models or default_models(1, 1, 2))
    at_once = 1 if fit_rows is None else FITS_AT_ONCE

    def run(pool, work, items):
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)

    out = []
    with ThreadPool(at_once) as pool:
        for some in [cases[i : i + at_once] for i in range(0, len(cases), at_once)]:
            prepared = run(pool, lambda case: _ready(case[0], target, ignore, fit_rows, key), some)
            jobs = [(ready, name, len(features.labels.labels)) for features, ready in prepared for name in names]
            fitted = iter(run(pool, lambda job: _fit(*job), jobs))
            for (features, ready), (_, tests) in zip(prepared, some):
                out.append(predictions(features, {name: next(fitted) for name in names}, tests))
                ready.unpersist()
    return out


def require_aligned(dirty: DataFrame, clean: DataFrame, target: str, key: str = "row_id") -> None:
    """Both tables must hold the same rows with the same labels; the target is never corrupted."""
    a = dirty.select(key, F.col(target).alias("_a"))
    b = clean.select(key, F.col(target).alias("_b"))
    bad = a.join(b, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_a").isNull()).limit(1).count()
    if bad:
        raise ValueError("training and evaluation rows or labels do not match")


def hold_out(
    clean: DataFrame, target: str, fold: int, corrupt: Callable[[DataFrame], DataFrame] | None = None,
    ignore: Sequence[str] = (), models: Sequence[str] | None = None, fit_rows: int | None = None, key: str = "row_id",
) -> DataFrame:
    """Train on the corrupted training rows of a fold, score its clean test rows: metrics per model.

    `fit_rows` bounds the rows that a classifier is fitted on (a sample by key); all test rows are scored.
    """
    train, test = prep.split_fold(clean, fold)
    dirty = corrupt(train) if corrupt else train
    matrix = _fit_and_score([(dirty.select(*clean.columns), {"clean": test})], target, ignore, models, fit_rows, key)[0]
    return metrics(matrix, ["model", "test"])


def dual_cv(
    clean: DataFrame, dirty: DataFrame, target: str, folds: int, ignore: Sequence[str] = (),
    models: Sequence[str] | None = None, fit_rows: int | None = None, key: str = "row_id", fold: str = "fold",
) -> DataFrame:
    """Cross-validation on dirty rows; every fold scores the same test rows twice, dirty and clean.

    `dirty_share` is the share of the fold's training rows that differ from the clean ones in any column.
    """
    require_aligned(dirty, clean, target, key)
    compared = [c for c in clean.columns if c not in (key, fold, target)]
    changed = stage(noise.changed_rows(clean, dirty, compared, key))
    cases, shares = [], []
    for f in range(folds):
        train, dirty_test = prep.split_fold(dirty, f, fold)
        _, clean_test = prep.split_fold(clean, f, fold)
        # Where no row was corrupted, both test sets are the same one, which is scored once.
        tests = {"clean": clean_test} if dirty is clean else {"dirty": dirty_test, "clean": clean_test}
        cases.append((train, {kind: test.select(*train.columns) for kind, test in tests.items()}))
        shares.append(train.select(key).join(changed, key).agg(F.avg(F.col("dirty").cast("double"))).first()[0])
    parts = []
    for f, matrix in enumerate(_fit_and_score(cases, target, ignore, models, fit_rows, key)):
        if dirty is clean:
            matrix = matrix.withColumn("test", F.explode(F.array(F.lit("dirty"), F.lit("clean"))))
        scored = metrics(matrix, ["model", "test"]).withColumn("fold", F.lit(f))
        parts.append(scored.withColumn("dirty_share", F.lit(shares[f]).cast("double")))
    return reduce(DataFrame.unionByName, parts)


def relevance_runs(
    clean: DataFrame, configurations: dict[str, Sequence[FD]], target: str, folds: int, replicas: Sequence[int],
    level: int = 40, base_seed: int = 100, ignore: Sequence[str] = (), models: Sequence[str] | None = None,
    fit_rows: int | None = None,
) -> DataFrame:
    """F1 on clean test rows when one configuration at a time is corrupted; the baseline is level 0."""
    parts = []
    for replica in replicas:
        seed = base_seed + replica
        folded = stage(prep.assign_folds(prep.balance(clean, target, seed), target, folds, seed))
        for name, fds in {"baseline": [], **configurations}.items():
            dirty = stage(noise.inject_independent(folded, fds, level, seed)) if fds else folded
            scores = dual_cv(folded, dirty, target, folds, [*ignore, "row_id", "fold"], models, fit_rows)
            mean = scores.filter("test = 'clean'").groupBy("model").agg(F.avg("f1").alias("f1_clean"))
            parts.append(stage(mean.select(F.lit(name).alias("config"), F.lit(replica).alias("replica"), "model", "f1_clean")))
    return reduce(DataFrame.unionByName, parts)
