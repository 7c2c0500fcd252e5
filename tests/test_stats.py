import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.functions.numeric import g6, t_two_sided
from tarnish.operators import results, stats

# Two-sided p-values of Student's t: (t, degrees of freedom, p).
KNOWN_P = [
    (2.7764451051977987, 4, 0.05), (12.706204736432095, 1, 0.05), (-3.246611592964167, 4, 0.03147641310667106),
    (-4.318440535137849, 4, 0.012462727987205163), (0.0, 3.5, 1.0), (1.959963986120195, 1e6, 0.05), (2.0422724563012373, 30, 0.05),
]


def test_t_tail(spark):
    df = spark.createDataFrame([(float(t), float(d), p) for t, d, p in KNOWN_P], "t double, d double, p double")
    for row in df.withColumn("got", t_two_sided("t", "d")).collect():
        assert row["got"] == pytest.approx(row["p"], rel=1e-5)
    empty = spark.createDataFrame([(None, 3.0), (1.0, None)], "t double, d double")
    assert [r[0] for r in empty.select(t_two_sided("t", "d")).collect()] == [None, None]


def test_g_format(spark):
    values = [1.0, 0.05, 123456.789, 1234567.0, 1.36356e-07, -0.00012345678, 100000.0, 0.1 + 0.2, 999999.6, 1e22, 0.0, -7.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(g6("v")).collect()] == [f"{v:g}" for v in values]


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(3)
    rows = [
        (c, n, m, lv, r, 0.9 - lv / 200 - n / 100 + rng.gauss(0, 0.01), round(1 - (1 - lv / 100) ** n + rng.random() / 100, 4), lv * n + rng.randrange(3))
        for c, n in (("C1", 1), ("C2", 2), ("C3", 4)) for m in ("tree", "net") for lv in (0, 10, 20, 40) for r in range(5)
    ]
    return spark.createDataFrame(rows, "config string, n_fd int, model string, level int, replica int, f1 double, share double, im int").cache()


def test_welch(scores):
    data = scores.toPandas()
    row = next(r for r in stats.welch(scores, ["config", "model"], "f1").collect() if (r["config"], r["model"], r["level"]) == ("C2", "net", 20))
    pick = data[(data.config == "C2") & (data.model == "net")]
    a, b = pick[pick.level == 20].f1.to_numpy(), pick[pick.level == 0].f1.to_numpy()
    se = math.sqrt(a.var(ddof=1) / 5 + b.var(ddof=1) / 5)
    assert row["t"] == pytest.approx((a.mean() - b.mean()) / se)
    assert row["drop"] == pytest.approx(b.mean() - a.mean())
    assert row["significant"] == (row["p_value"] < 0.05)


def test_paired_and_pooled(scores):
    data = scores.toPandas().pivot_table(index=["level", "model", "replica"], columns="config", values="f1").reset_index()
    diff = data[(data.level == 40) & (data.model == "tree")].eval("C2 - C1").to_numpy()
    row = next(r for r in stats.paired(scores, ["level", "model"], ["replica"], "f1", "config", ["C1", "C2", "C3"]).collect()
               if (r["level"], r["model"], r["comparison"]) == (40, "tree", "C1 -> C2"))
    assert row["t"] == pytest.approx(diff.mean() / (diff.std(ddof=1) / math.sqrt(5)))
    pooled = {(r["level"], r["comparison"]): r["n"] for r in stats.paired(scores, ["level"], ["model", "replica"], "f1", "config", ["C1", "C2", "C3"]).collect()}
    assert set(pooled.values()) == {10}
    same = stats.paired(scores.withColumn("f1", F.lit(0.5)), ["level", "model"], ["replica"], "f1", "config", ["C1", "C2"]).first()
    assert same["t"] is None and same["p_value"] is None and same["significant"] is False


def test_correlations_with_ties(scores):
    data = scores.toPandas()
    got = {r["model"]: r for r in stats.correlations(scores, ["model"], ["im"], "f1").collect()}
    for model, part in data.groupby("model"):
        assert got[model]["pearson_r"] == pytest.approx(np.corrcoef(part.im, part.f1)[0, 1])
        assert got[model]["spearman_rho"] == pytest.approx(np.corrcoef(part.im.rank(), part.f1.rank())[0, 1])
    flat = stats.correlations(scores.withColumn("im", F.lit(1)), ["model"], ["im"], "f1")
    assert flat.count() == 0


def test_regression(scores):
    data = scores.toPandas()
    got = {(r["model"], r["term"]): r for r in stats.ols(scores.withColumn("share2", F.col("share") ** 2), ["model"], "f1", ["share", "share2", "n_fd"]).collect()}
    for model, part in data.groupby("model"):
        x = np.column_stack([np.ones(len(part)), part.share, part.share**2, part.n_fd])
        beta, *_ = np.linalg.lstsq(x, part.f1, rcond=None)
        rest = part.f1 - x @ beta
        error = np.sqrt(np.diag(rest @ rest / (len(part) - 4) * np.linalg.inv(x.T @ x)))
        for term, b, e in zip(["intercept", "share", "share2", "n_fd"], beta, error):
            assert got[model, term]["coef"] == pytest.approx(b, rel=1e-6)
            assert got[model, term]["se"] == pytest.approx(e, rel=1e-6)


def test_thresholds_and_losses(spark):
    rows = [("x", 0, 0.9, 0.9), ("x", 10, 0.895, 0.85), ("x", 20, 0.88, 0.8), ("x", 30, 0.899, 0.7)]
    df = spark.createDataFrame(rows, "config string, level int, f1_clean double, f1_dirty double")
    assert results.tolerance_threshold(df, ["config"], "f1_clean").first()["threshold"] == 10
    loss = {r["level"]: r for r in results.decompose_loss(df, ["config"]).collect()}
    assert loss[0]["learning_percent"] is None
    assert loss[20]["learning_percent"] == pytest.approx(20.0)
    assert math.isclose(loss[20]["input_loss"], 0.08, abs_tol=1e-12)


def test_pending_cells(spark):
    done = spark.createDataFrame([("C1", 0)] * 4 + [("C1", 5)] * 3, "config string, level int")
    cells = results.grid(spark, config=["C1"], level=[0, 5, 10])
    assert {r["level"] for r in results.pending(cells, done, ["config", "level"]).collect()} == {5, 10}
    rows = [("C1", 0, m) for m in "abcd"] + [("C1", 5, m) for m in "abca"] + [("C1", 10, m) for m in "abcda"]
    done = spark.createDataFrame(rows, "config string, level int, model string")
    assert {r["level"] for r in results.pending(cells, done, ["config", "level"], each="model").collect()} == {5, 10}


def test_regression_keeps_groups_without_a_solution(spark):
    rows = [("few", 1.0, 1.0, 2.0)] * 2 + [("same", float(k), float(k), 2.0 * k) for k in range(20)]
    got = stats.ols(spark.createDataFrame(rows, "g string, y double, a double, b double"), ["g"], "y", ["a", "b"]).collect()
    assert len(got) == 6 and all(r["coef"] is None and r["p_value"] is None for r in got)
    assert {(r["g"], r["n_points"]) for r in got} == {("few", 2), ("same", 20)}
