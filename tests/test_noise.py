import random

import pytest
from pyspark.sql import functions as F

from tarnish.model import FD, corrupted_columns
from tarnish.operators import noise

FDS = [FD(("a",), "b", ("c",)), FD(("b",), "d")]
COLUMNS = corrupted_columns(FDS)


@pytest.fixture(scope="module")
def clean(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.randrange(5), rng.choice("uvwxyz"), rng.randrange(300), rng.random() < 0.3) for i in range(333)]
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], int(r[4])) for r in rows], "row_id string, a int, b string, c int, d int").cache()


def cells(df, columns):
    return {r["row_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("level", [0, 7, 40, 100])
def test_exact_share_and_different_cells(clean, level):
    dirty = noise.inject_shared(clean, COLUMNS, level, 3)
    before, after = cells(clean, COLUMNS), cells(dirty, COLUMNS)
    hits = {r["row_id"] for r in dirty.filter("hit").collect()}
    assert len(hits) == 333 * level // 100
    for key, old in before.items():
        if key in hits:
            assert all(x != y for x, y in zip(old, after[key]))
        else:
            assert old == after[key]


def test_domain_size_does_not_change_the_draws(clean):
    small = noise.inject_shared(clean, COLUMNS, 30, 5)
    large = noise.inject_shared(clean, COLUMNS, 30, 5, domains=noise.Domains(clean, COLUMNS, small=0))
    assert cells(small, COLUMNS) == cells(large, COLUMNS)


def test_replacement_is_spread_over_all_other_values(clean):
    dirty = noise.inject_shared(clean, ["b"], 100, 9)
    pairs = dirty.select("row_id", F.col("b").alias("new")).join(clean, "row_id").groupBy("b", "new").count().count()
    assert pairs == 6 * 5


def test_larger_configuration_contains_the_smaller(clean):
    small = noise.inject_shared(clean, COLUMNS[:3], 20, 5)
    large = noise.inject_shared(clean, COLUMNS, 20, 5)
    assert noise.nested_check(small, large, COLUMNS[:3]).first()["different"] == 0


def test_independent_rows_per_dependency(clean):
    dirty = noise.inject_independent(clean, FDS, 20, 5)
    k = 333 * 20 // 100
    share = noise.dirty_share(clean, dirty, ["a"]).first()
    assert share["dirty_rows"] == k
    assert noise.dirty_share(clean, dirty, ["d"]).first()["dirty_rows"] == k
    assert k < noise.dirty_share(clean, dirty, COLUMNS).first()["dirty_rows"] <= 2 * k
    kept = noise.inject_independent(clean, FDS[:1], 20, 5, corrupt_lhs=False)
    assert noise.dirty_share(clean, kept, ["a"]).first()["dirty_rows"] == 0


def test_grid_levels_are_nested_per_replica(clean):
    grid = noise.inject_grid(clean, ["a"], [0, 10, 30], [0, 1])
    hits = {}
    for r in grid.filter("hit").collect():
        hits.setdefault((r["replica"], r["level"]), set()).add(r["row_id"])
    assert {k: len(v) for k, v in hits.items()} == {(0, 10): 33, (0, 30): 99, (1, 10): 33, (1, 30): 99}
    assert hits[0, 10] <= hits[0, 30] and hits[0, 10] != hits[1, 10]


def test_guards(clean):
    with pytest.raises(ValueError, match="single value"):
        noise.inject_shared(clean.withColumn("k", F.lit(1)), ["k"], 10, 1)
    with pytest.raises(ValueError, match="percentage"):
        noise.inject_shared(clean, ["a"], 0.1, 1)
    broken = noise.guarantees(clean, clean, clean, clean.limit(5), 10, ["a"], [FD(("row_id",), "a")])
    with pytest.raises(AssertionError):
        noise.require_guarantees(broken)


def test_columns_may_have_any_name(spark):
    """Names that the rank and join helpers use themselves, on every operator that goes through them."""
    from pyspark.sql import functions as F

    from tarnish.functions.joins import attach
    from tarnish.operators import prep

    names = ["n", "k", "cut", "cut_tie", "_cutoff", "_hot", "_slot", "_cold"]
    rows = [(f"r{i}", "ab"[i % 3 == 0], f"v{i % 5}", i % 2, *range(len(names))) for i in range(60)]
    df = spark.createDataFrame(rows, f"row_id string, cls string, a string, fold int, {', '.join(f'{x} int' for x in names)}")
    assert prep.sample_rows(df, 7, 1).count() == 7
    assert prep.stratified_sample(df, "cls", 50, 1).count() == 30
    assert prep.balance(df, "cls", 1).count() == 40 and prep.balance(df, "cls", 1, cap=3).count() == 6
    assert noise.inject_shared(df, ["a"], 10, 1).filter("hit").count() == 6
    grid = noise.inject_grid(df, ["a"], [10, 20], [0, 1])
    assert grid.filter("hit").count() == 36 and set(df.columns) <= set(grid.columns)
    assert noise.inject_per_fold(df, ["a"], [50], 2).filter("hit").count() == 30
    groups = df.groupBy("cls").agg(F.count(F.lit(1)).alias("size"), F.max("k").alias("top"))
    got = attach(df, groups, ["cls"], ["size", "top"], "size", 60)
    assert got.columns == [*df.columns, "size", "top"] and {(r["cls"], r["size"]) for r in got.collect()} == {("a", 40), ("b", 20)}
    for name in names:  # also as the stratum
        sample = prep.stratified_sample(df.withColumn(name, F.col("cls")), name, 50, 1)
        assert sample.count() == 30


def test_modified_rows_by_part_count_repeated_and_missing_keys_as_a_join_does(spark):
    clean = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 3)], "row_id string, v int")
    dirty = spark.createDataFrame([("a", 1, "x"), ("b", None, "x"), ("b", 7, "y"), (None, 4, "y")], "row_id string, v int, part string")
    got = {r["part"]: (r["n_rows"], r["modified"]) for r in noise.modified_rows(clean, dirty, ["v"], by=["part"]).collect()}
    assert got == {"x": (3, 1), "y": (1, 1)}


def test_guarantees_join_the_clean_rows_once(spark, clean):
    columns = ["a", "b"] if {"a", "b"} <= set(clean.columns) else [c for c in clean.columns if c != "row_id"][:2]
    report = noise.guarantees(clean, clean, clean, clean, 0, columns, [FD((columns[0],), columns[1])])
    assert report._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_shares_of_all_versions_at_once(spark):
    """Side by side they are the shares of single versions, also where ids repeat with other cells or are missing."""
    rows = [(str(i % 90) if i % 31 else None, i % 5, i % 7 if i % 11 else None, i % 3) for i in range(120)]
    clean = spark.createDataFrame(rows, "row_id string, a int, b int, c int")
    pool = [FD(("a",), "b"), FD(("b",), "c")]
    versions = [(pool[:n], level) for n in (1, 2) for level in (0, 10, 40)]
    found = {(r["n_fd"], r["level"]): r["share"] for r in noise.independent_shares(clean, versions, 5).collect()}
    domains = noise.Domains(clean, ["a", "b", "c"])
    for fds, level in versions:
        columns = corrupted_columns(fds)
        dirty = noise.inject_independent(clean.select("row_id", "a", "b", "c"), fds, level, 5, domains=domains)
        now, was = ([tuple(r) for r in t.select("row_id", *columns).collect() if r["row_id"] is not None] for t in (dirty, clean))
        pairs = [a != b for a in now for b in was if a[0] == b[0]]
        assert found[len(fds), level] == pytest.approx(sum(pairs) / len(pairs))
