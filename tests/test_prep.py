import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnish.functions import ranking
from tarnish.functions.hashing import draw
from tarnish.operators import prep
from tarnish.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(f"r{i}", rng.choice("aaab") if i % 3 else "hot", round(rng.expovariate(0.01), 2)) for i in range(500)]
    return spark.createDataFrame(data, "row_id string, cls string, v double").cache()


def test_bins_are_closed_on_the_right(spark):
    values = [-1.0, 0.0, 0.1, 90.0, 90.5, 300.0, 301.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    edges, labels = (0, 90, 300, None), ("low", "mid", "high")
    got = [r[0] for r in df.select(prep.bucketize_right(F.col("v"), edges, labels)).collect()]
    cut = pd.cut(pd.Series(values), [0, 90, 300, np.inf], labels=labels)
    assert got == [None if pd.isna(x) else x for x in cut]


def test_quantiles_are_exact(spark, rows):
    values = np.array([r["v"] for r in rows.collect()])
    wanted = [0, 0.1, 1 / 3, 0.5, 0.99, 1]
    assert prep.exact_quantiles(rows, "v", wanted) == pytest.approx(list(np.quantile(values, wanted)))
    tied = spark.createDataFrame([(5.0,)] * 90 + [(1e9,), (-3.0,)], "v double")
    assert prep.exact_quantiles(tied, "v", [0.5, 1]) == [5.0, 1e9]


def test_quantiles_of_many_columns_in_two_passes(spark, monkeypatch):
    """Beyond the exact small case: ties, gaps, NaN, an empty column, and brackets that miss."""
    rng = random.Random(6)
    data = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None if rng.random() < 0.5 else rng.random(), None, float("nan") if rng.random() < 0.2 else 7.0) for _ in range(3000)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double").repartition(3)
    wanted = [0, 0.25, 0.5, 0.9, 1]
    columns = {c: F.col(c) for c in df.columns}
    want = {c: [v for v in (row[i] for row in data) if v is not None and v == v] for i, c in enumerate("abcde")}
    for few, margin in ((10_000, 0.005), (0, 0.005), (0, 0.0)):
        monkeypatch.setattr(prep, "FEW_ROWS", few)
        monkeypatch.setattr(prep, "MARGIN", margin)
        got = prep.quantiles(df, columns, wanted)
        assert got["d"] is None
        assert all(got[c] == pytest.approx(list(np.quantile(want[c], wanted))) for c in "abce")
    with pytest.raises(ValueError, match="d has no values"):
        prep.fit_medians(df, ["a", "d"])


def test_choice_does_not_depend_on_partitions(rows):
    first = {r["row_id"] for r in prep.sample_rows(rows, 77, 1).collect()}
    again = {r["row_id"] for r in prep.sample_rows(rows.repartition(7, "v"), 77, 1).collect()}
    assert len(first) == 77 and first == again
    assert prep.sample_rows(rows, 10_000, 1).count() == 500


def test_balance_and_stratified_sample(rows):
    sizes = {r["cls"]: r["count"] for r in rows.groupBy("cls").count().collect()}
    balanced = {r["cls"]: r["count"] for r in prep.balance(rows, "cls", 1).groupBy("cls").count().collect()}
    assert set(balanced.values()) == {min(sizes.values())}
    capped = {r["cls"]: r["count"] for r in prep.balance(rows, "cls", 1, cap=9).groupBy("cls").count().collect()}
    assert set(capped.values()) == {9}
    sample = {r["cls"]: r["count"] for r in prep.stratified_sample(rows, "cls", 45, 1).groupBy("cls").count().collect()}
    assert sample == {c: (n * 90 + 100) // 200 for c, n in sizes.items()}


def test_folds_are_even_in_every_class(rows):
    counts = prep.assign_folds(rows, "cls", 5, 2).groupBy("cls", "fold").count().toPandas()
    spread = counts.groupby("cls")["count"].agg(["min", "max", "size"])
    assert (spread["max"] - spread["min"] <= 1).all() and (spread["size"] == 5).all()
    folded = prep.assign_folds(rows, "cls", 3, 2)
    check = prep.partition_check(*prep.split_fold(folded, 0), rows).first()
    assert (check["shared"], check["complete"]) == (0, True)


def test_running_totals(rows):
    ordered = rows.withColumn("h", draw(1, F.col("row_id")))
    got = ranking.running_total(ordered, ["cls"], "h", "row_id", "at").toPandas().sort_values(["cls", "h"])
    assert got.groupby("cls")["at"].apply(lambda s: list(s) == list(range(len(s)))).all()
    by_value = ranking.ordered_total(rows.groupBy("cls", "v").count(), ["cls"], "v", "before", F.col("count")).toPandas()
    by_value = by_value.sort_values(["cls", "v"])
    want = by_value.groupby("cls")["count"].cumsum() - by_value["count"]
    assert (by_value["before"] == want).all()


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame(
        [(1.0, "b", 5.0), (float("nan"), "b", 5.0), (4.0, "a", None), (None, "a", 5.0), (1.0, None, 5.0)], "x double, s string, k double"
    )
    moments = prep.fit_means(df, ["x", "k"])
    filled = np.array([1, 2, 4, 2, 1.0])
    assert moments["x"] == pytest.approx((2.0, filled.std()))
    got = [r["x"] for r in prep.standardise(df, moments).collect()]
    assert got == pytest.approx(list((filled - 2) / filled.std()))
    assert [r["k"] for r in prep.standardise(df, moments).collect()] == [0.0] * 5
    assert prep.fit_modes(df, ["s"]) == {"s": "a"}  # the smaller value wins a tie
    assert [r["s"] for r in prep.impute(df, {"s": "a"}).collect()] == ["b", "b", "a", "a", "a"]
    assert prep.fit_medians(df, ["x"]) == {"x": 1.0}
    assert prep.missing_counts(df, ["x", "s", "k"]).first().asDict() == {"x": 2, "s": 1, "k": 1}


def test_columns_and_targets(spark):
    df = spark.createDataFrame([(i, None, float(i), "c" if i % 2 else "a") for i in range(30)], "i long, e double, v double, s string")
    assert prep.drop_empty_columns(df).columns == ["i", "v", "s"]
    assert {r["v"] for r in prep.binarise_target(df, "v").collect()} == {0, 1}
    assert prep.binarise_target(df, "s").columns == df.columns
    assert {(r["s"], r["label"]) for r in prep.encode_labels(df, "s").collect()} == {("a", 0), ("c", 1)}
    assert prep.feature_roles(df, ["i"]) == (["e", "v"], ["s"])


def test_a_missing_class_is_a_class(spark):
    rows = [(f"r{i}", None if i % 10 == 0 else "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id string, y string")
    folded = prep.assign_folds(df, "y", 5, 1)
    assert folded.count() == 100 and {r["n"] for r in folded.filter("y IS NULL").groupBy("fold").count().withColumnRenamed("count", "n").collect()} == {2}
    assert prep.stratified_sample(df, "y", 50, 1).filter("y IS NULL").count() == 5


def _file(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_delimited_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    schema = "id bigint, name string, x double, n int"
    path = _file(
        tmp_path, "a.csv", "id,name,x,n", '1,"a, b",1.5,3', "2,short", "3,c,not a number,4", "4,d,,5", "5,e,2.5,six", "6,f,NaN,7", "7,g,1.0,8,9", '8,"",0.5,'
    )
    rows, bad = tables.load_delimited(spark, path, schema)
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, "a, b", 1.5, 3), (4, "d", None, 5), (6, "f", None, 7), (8, None, 0.5, None)]
    assert sorted(r["record"] for r in bad.collect()) == ["2,short", "3,c,not a number,4", "5,e,2.5,six", "7,g,1.0,8,9"]
    # `n` is not kept, so row 5 fits.
    rows, bad = tables.load_delimited(spark, path, schema, keep=["id", "x"])
    assert rows.columns == ["id", "x"] and sorted(r["id"] for r in rows.collect()) == [1, 4, 5, 6, 8] and bad.count() == 3
    with pytest.raises(ValueError):
        tables.load_delimited(spark, path, schema, keep=["z"])


def test_delimited_headers_and_clashing_names(spark, tmp_path):
    swapped = _file(tmp_path, "b.csv", "name,id", "a,1")
    with pytest.raises(Exception, match="header"):
        tables.load_delimited(spark, swapped, "id bigint, name string")
    with pytest.raises(Exception, match="header"):
        tables.load(spark, swapped, "id bigint, name string").collect()
    path = _file(tmp_path, "c.csv", "record;id", "r;1", "s;x")
    rows, bad = tables.load_delimited(spark, path, "record string, id int", separator=";")
    assert [tuple(r) for r in rows.collect()] == [("r", 1)] and [r["record"] for r in bad.collect()] == ["s;x"]
    empty, none = tables.load_delimited(spark, _file(tmp_path, "d.csv", "id,name"), "id bigint, name string")
    assert empty.count() == 0 and none.count() == 0
    broken = _file(tmp_path, "e.csv", "id,name", "x,a")
    with pytest.raises(Exception, match="MALFORMED"):
        tables.load(spark, broken, "id bigint, name string").collect()
