import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tarnish.functions import forest
from tarnish.model import FD
from tarnish.operators import evalm, noise, prep
from tarnish.plans import evaluate_queries, experiment
from tarnish.sources import views


def test_metrics_of_a_small_matrix(spark):
    df = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("c", "a", 2)], "label string, prediction string, n int")
    got = evalm.metrics(df).first()
    assert got["accuracy"] == pytest.approx(5 / 8)
    assert got["precision"] == pytest.approx((4 * 3 / 5 + 2 * 2 / 3 + 0) / 8)
    assert got["recall"] == pytest.approx((4 * 3 / 4 + 2 * 1 + 0) / 8)
    assert got["f1_macro"] == pytest.approx((6 / 9 + 4 / 5 + 0) / 3)


def test_one_column_predicts_by_majority(spark):
    rows = [("u", "x", 0), ("u", "x", 1), ("u", "y", 1), ("v", "y", 0), ("w", "x", 1)]
    df = spark.createDataFrame(rows, "col string, y string, fold int")
    got = {(r["fold"], r["label"], r["prediction"]): r["n"] for r in evalm.univariate_confusion(df, ["col"], "y", 2).collect()}
    # fold 0 trains on u: x, y (tie: x) and w: x; v is unseen and gets x. fold 1 trains on u: x and v: y; w unseen: x.
    assert got == {(0, "x", "x"): 1, (0, "y", "x"): 1, (1, "x", "x"): 2, (1, "y", "x"): 1}


@pytest.fixture(scope="module")
def data(spark):
    rows = [(f"r{i}", f"k{i % 6}", (i % 6) * 10, float(i % 7), "low" if i % 6 < 3 else "high") for i in range(240)]
    df = spark.createDataFrame(rows, "row_id string, k string, d int, v double, y string")
    return prep.assign_folds(df, "y", 2, 1).cache()


def test_unknown_category_is_all_zeros(data):
    features = evalm.Features(data.filter("k <> 'k5'").select("k", "y"), "y")
    out = features.transform(data, ["k"]).select("k", vector_to_array("features").alias("f")).distinct()
    sums = {r["k"]: sum(r["f"]) for r in out.collect()}
    assert sums == {"k0": 1.0, "k1": 1.0, "k2": 1.0, "k3": 1.0, "k4": 1.0, "k5": 0.0}


@pytest.mark.parametrize("hot_keys", [2, 1000])
def test_codes_are_places_in_the_order_of_values(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(evalm.joins, "HOT_KEYS", hot_keys)
    seen = [("b", "x", None), ("a", "x", None), ("b", None, None), ("c", "x", None)] + [("b", "y", None)] * 20
    known = spark.createDataFrame(seen, "p string, n string, gone string")
    codes = evalm.CategoryCodes(known, ["p", "n", "gone"])
    assert codes.sizes == {"p": 3, "n": 2} and codes.rows == {"p": 24, "n": 23}
    asked = spark.createDataFrame([("a", "y", "q"), ("b", "x", None), ("c", None, None), ("d", "x", None), (None, "z", "q")], known.schema)
    coded = codes.attach(asked)
    got = sorted(((r["p"] or "", r["_i_p"], r["_i_n"]) for r in coded.collect()))
    assert got == [("", 3.0, 2.0), ("a", 0.0, 1.0), ("b", 1.0, 0.0), ("c", 2.0, 2.0), ("d", 3.0, 0.0)]
    hot = codes.encoder(spark).transform(coded).select("p", vector_to_array("_h_p").alias("h"))
    assert {r["p"]: r["h"] for r in hot.collect()} == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], "d": [0, 0, 0], None: [0, 0, 0]}


def test_codes_without_columns_or_rows(spark, data):
    assert evalm.CategoryCodes(data, []).attach(data).columns == data.columns
    assert evalm.CategoryCodes(data.limit(0), ["k"]).sizes == {}


def test_dual_evaluation_agrees_on_clean_data(data):
    scores = evalm.dual_cv(data, data, "y", 2, ["row_id", "fold"], ["decision tree"], 60).collect()
    by_fold = {}
    for r in scores:
        by_fold.setdefault(r["fold"], set()).add(r["f1"])
    assert all(len(v) == 1 for v in by_fold.values()) and len(by_fold) == 2
    with pytest.raises(ValueError, match="do not match"):
        evalm.require_aligned(data, data.withColumn("y", F.lit("low")), "y")
    dirty = noise.inject_shared(data, ["k", "d"], 50, 3)
    evalm.require_aligned(dirty, data, "y")


def test_experiment_resumes(spark, data, tmp_path):
    path = str(tmp_path / "grid")
    configs = {"C1": [FD(("k",), "d")], "C2": [FD(("k",), "d", ()), FD(("d",), "k")]}
    args = dict(target="y", folds=2, path=path, ignore=["row_id", "fold"], models=["decision tree"], fit_rows=100)
    first = experiment.run_grid(data, {"C1": configs["C1"]}, levels=[0], **args)
    assert first.count() == 2
    full = experiment.run_grid(data, configs, levels=[0, 20], **args)
    assert full.count() == 2 + 2 * 2
    assert full.filter("level = 0 AND (im > 0 OR ip > 0)").count() == 0
    assert full.filter("level = 20 AND im = 0").count() == 0
    cells = ["config", "level", "fold"]
    before = {tuple(r[c] for c in cells): r["f1"] for r in full.collect()}
    full.filter("config = 'C1' AND fold = 1").write.mode("append").partitionBy(*cells).parquet(path)  # a surplus row
    full = experiment.run_grid(data, configs, levels=[0, 20], **args)
    assert full.count() == len(before) and {tuple(r[c] for c in cells): r["f1"] for r in full.collect()} == before
    assert set(experiment.analyse(full, ["C1", "C2"])) == {"summary", "degradation", "configurations", "correlations", "thresholds"}
    assert experiment.analyse(full, ["C1", "C2"])["summary"].count() == 4


def numeric_reference(rows, folds):
    """(fold, label, prediction) counts of the nearest training value's majority, missing values at the median."""
    from collections import Counter
    from statistics import median

    out = Counter()
    for f in range(folds):
        mid = median(x for x, _, g in rows if g != f and x is not None)
        train = [(mid if x is None else x, y) for x, y, g in rows if g != f]
        for x, y, g in rows:
            if g == f:
                x = mid if x is None else x
                near = min({v for v, _ in train}, key=lambda v: (abs(v - x), v))
                votes = Counter(label for v, label in train if v == near)
                out[f, y, min(votes, key=lambda c: (-votes[c], c))] += 1
    return out


def test_numeric_column_alone(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice([None, float("nan"), *map(float, range(0, 40, 3))]), rng.choice("abc"), rng.randrange(3)) for _ in range(300)]
    rows += [(100.0 + k, "a", k % 3) for k in range(9)]
    df = spark.createDataFrame(rows, "v double, y string, fold int").repartition(5)
    plain = [(None if x is None or x != x else x, y, g) for x, y, g in rows]
    got = {(r["fold"], r["label"], r["prediction"]): r["n"] for r in evalm.numeric_confusion(df, "v", "y", 3).collect()}
    assert got == numeric_reference(plain, 3) and sum(got.values()) == len(rows)


def test_screening_ranks_numbers_too(spark, data):
    rows = data.drop("fold").withColumnRenamed("k", "kind")
    got = {(r["target"], r["column"]): r["f1_mean"] for r in evalm.screen_targets(rows, {"y": "y"}, ["kind", "d", "v"], 2, 1).collect()}
    assert got["y", "kind"] == got["y", "d"] == 1.0 and 0 < got["y", "v"] < 1


def test_replicas_resume(spark, data, tmp_path):
    clean = data.select("row_id", "k", "d", "y")
    args = dict(target="y", levels=[0, 30], replicas=[0], folds=2, path=str(tmp_path / "replicas"), models=["decision tree"], fit_rows=60)
    found = experiment.run_replicas(clean, {"C1": [FD(("k",), "d")]}, **args)
    rows = {(r["config"], r["level"]): r for r in found.collect()}
    assert set(rows) == {("baseline", 0), ("C1", 30)}
    assert rows["baseline", 0]["share"] == 0 and rows["baseline", 0]["im"] == 0 and rows["baseline", 0]["ih_approx"] == 0
    dirty = rows["C1", 30]
    assert 0 < dirty["share"] <= 0.3 and dirty["ih"] <= dirty["ih_approx"] <= 2 * dirty["ih"] and dirty["f1_clean"] >= dirty["f1_dirty"] - 0.2
    assert experiment.run_replicas(clean, {"C1": [FD(("k",), "d")]}, **args).count() == 2


def grown(values, leaf):
    """Class of every value by the tree's definition: [(x, votes)] in order of x."""
    total = [sum(v[k] for _, v in values) for k in range(len(values[0][1]))]
    cuts = []
    for i in range(1, len(values)):
        left = [sum(v[k] for _, v in values[:i]) for k in range(len(total))]
        right = [t - x for t, x in zip(total, left, strict=True)]
        if min(sum(left), sum(right)) >= leaf:
            cuts.append((sum(x * x for x in left) / sum(left) + sum(x * x for x in right) / sum(right), -i))
    if max(total) == sum(total) or not cuts:
        return {x: total.index(max(total)) for x, _ in values}
    i = -max(cuts)[1]
    return grown(values[:i], leaf) | grown(values[i:], leaf)


@pytest.mark.parametrize("leaf", [2, 5])
def test_leaves_of_a_tree_on_one_number(spark, leaf):
    rng = random.Random(leaf)
    values = {g: [(float(x), [rng.randint(0, 3) for _ in range(3)]) for x in sorted(rng.sample(range(100), n))] for g, n in ((0, 40), (1, 1), (2, 7))}
    values = {g: [(x, v) for x, v in rows if sum(v)] or [(1.0, [0, 2, 0])] for g, rows in values.items()}
    rows = [(g, x, v) for g, some in values.items() for x, v in some]
    df = spark.createDataFrame(rows, "g int, x double, votes array<long>")
    got = {(r["g"], r["x"]): r["choice"] for r in evalm.leaf_choices(df, ["g"], "x", "votes", leaf).collect()}
    assert got == {(g, x): c for g, some in values.items() for x, c in grown(some, leaf).items()}


def test_small_values_stay_together(spark):
    """Values of under five rows share a class; alone they are too few, so the least telling value joins them."""
    rows = [("big", "u", 8), ("big", "v", 2), ("flat", "u", 5), ("flat", "v", 5), ("rare", "v", 2), ("odd", "v", 1), ("new", "u", 0)]
    train = [(v, label, 1) for v, label, n in rows for _ in range(n)]
    test = [(v, "u", 0) for v in ("big", "flat", "rare", "odd", "new")]
    df = spark.createDataFrame(train + test, "v string, y string, fold int")
    pooled = {r["prediction"]: r["n"] for r in evalm.univariate_confusion(df, ["v"], "y", 2, leaf=5).filter("fold = 0").collect()}
    assert pooled == {"u": 1, "v": 4}  # big alone; flat, rare and odd hold 5 u and 8 v, and so does what is new
    alone = {r["prediction"]: r["n"] for r in evalm.univariate_confusion(df, ["v"], "y", 2, leaf=1).filter("fold = 0").collect()}
    assert alone == {"u": 3, "v": 2}
    again = evalm.univariate_confusion(df, ["v"], "y", 2).exceptAll(evalm.univariate_confusion(df, ["v"], "y", 2, leaf=1))
    assert again.isEmpty()


def test_counts_of_values_are_shuffled_once(spark):
    rows = [(f"v{i % 40}", "xyz"[i % 3], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "v string, y string, fold int")
    plan = evalm.univariate_confusion(df, ["v"], "y", 3, leaf=5)._jdf.queryExecution().executedPlan().toString()
    assert "Existing" not in plan  # the rows themselves are read before, for the staged counts
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_forest_predicts_as_its_model_does(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdefg"), rng.choice(["x", "y", None]), rng.gauss(0, 1), rng.choice([1.0, 2.0, None]), rng.choice("pqr")) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, m string, v double, w double, y string").repartition(3)
    features = evalm.Features(df, "y")
    ready = features.transform(df).coalesce(1)
    model = evalm.default_models(600, 11, 3)["random forest"].setNumTrees(20).fit(ready)
    trees = forest.Trees(forest.nodes_of(spark, model))
    assert trees.words > 1 and len(trees.features) > 5
    both = forest.predict(model, model.transform(features.transform(df)), "_p")
    assert both.count() == 600 and both.filter("_p IS DISTINCT FROM prediction").isEmpty()
    constant = spark.createDataFrame([(1.0, "p"), (1.0, "q"), (1.0, "q")], "v double, y string")
    flat = evalm.Features(constant, "y").transform(constant).coalesce(1)
    stump = evalm.default_models(3, 1, 2)["random forest"].setNumTrees(3).fit(flat)
    both = forest.predict(stump, stump.transform(flat), "_p")
    assert both.filter("_p IS DISTINCT FROM prediction").isEmpty()


def test_models_of_all_folds_score_in_one_pass_each(spark, data, monkeypatch):
    dirty = noise.inject_shared(data, ["k", "d"], 50, 3).drop("hit")
    at_once, passes = [], []
    pool, whole = evalm.ThreadPool, evalm.predictions
    monkeypatch.setattr(evalm, "ThreadPool", lambda n: at_once.append(n) or pool(n))
    monkeypatch.setattr(evalm, "predictions", lambda *a: passes.append(sorted(a[2])) or whole(*a))
    names = ["random forest", "decision tree"]
    scores = {(r["model"], r["test"], r["fold"]): r for r in evalm.dual_cv(data, dirty, "y", 2, ["row_id", "fold"], names, 60).collect()}
    assert len(scores) == 8 and passes == [["clean", "dirty"]] * 2 and at_once == [evalm.FITS_AT_ONCE]
    assert sum(r["n_rows"] for r in scores.values()) == 4 * 240
    passes.clear()
    same = evalm.dual_cv(data, data, "y", 2, ["row_id", "fold"], names, 60).collect()
    assert len(same) == 8 and passes == [["clean"]] * 2


@pytest.mark.parametrize("name, cases, train, out", [
    ("M4_dual_evaluation", 3, 2004, 24), ("M10_relevance_experiment", 6, 1503, 12), ("M16_replicated_experiment", 4, 1503, 8),
])
def test_models_of_queries_fit_all_training_rows(spark, monkeypatch, name, cases, train, out):
    """3,006 balanced rows in folds: every fit sees all rows of the other folds, not a sample of 1,000."""
    labels = views.DURATION_LABELS[:3]
    lane = "50 * (id % 8) + 50"
    rows = spark.range(3006).selectExpr(
        "md5(cast(id as string)) as row_id", f"element_at(array('{labels[0]}', '{labels[1]}', '{labels[2]}'), cast(id % 3 + 1 as int)) as duration_bucket",
        *[f"cast(id % {n} as int) as {c}" for c, n in (("s_nationkey", 4), ("c_nationkey", 8), ("c_regionkey", 8))],
        *[f"concat('n', id % {n}) as {c}" for c, n in (("s_nation", 4), ("c_nation", 8), ("c_region", 8), ("p_brand", 5))],
        f"cast({lane} as int) as lane_distance", f"cast(({lane}) div 250 + 1 as int) as lane_group", "cast(id % 50 as double) as l_quantity",
        "cast(id % 9 as double) / 100 as l_discount", "concat('2020-0', id % 9) as ship_month", "concat('2020-0', id % 9, '-01') as ship_day",
    )
    monkeypatch.setattr(views, "shipments", lambda spark, sf: rows)
    monkeypatch.setattr(evalm, "default_models", lambda *a: {m: DecisionTreeClassifier(maxDepth=2) for m in experiment.MODELS})
    seen, fit = [], evalm._fit
    monkeypatch.setattr(evalm, "_fit", lambda ready, *a: seen.append(ready.count()) or fit(ready, *a))
    found = getattr(evaluate_queries, name.split("_", 1)[1])(spark, "none")
    assert found.count() == out and seen == [train] * 4 * cases
