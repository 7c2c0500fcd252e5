import random

import pytest
from pyspark.sql import functions as F

from tarnish.model import FD, configurations, corrupted_columns, redundancy_dependencies
from tarnish.operators import cover, incons, profile
from tarnish.operators import edges as numbered
from tests.brute import edges, minimum_cover

FDS = [FD(("a", "b"), "c"), FD(("c",), "d"), FD(("a",), "e")]


def table(spark, seed, n=14, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = 0 if hot and i % 3 == 0 else rng.randrange(4)
        rows.append((f"r{i:03d}", a, rng.randrange(3), rng.randrange(4), rng.randrange(3), rng.randrange(3)))
    names = ["row_id", "a", "b", "c", "d", "e"]
    return spark.createDataFrame(rows, names), [dict(zip(names, r)) for r in rows]


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_indices_match_all_pairs(spark, seed, hot):
    df, rows = table(spark, seed, hot=hot)
    got = incons.indices(df, FDS).first()
    found = edges(rows, FDS)
    assert got["im"] == len(found)
    assert got["ip"] == len({x for p in found for x in p})
    for i, fd in enumerate(FDS, 1):
        assert got[f"im_{i}"] == len(edges(rows, [fd]))
    assert got["ih_min"] == max(minimum_cover(edges(rows, [fd]), len(rows)) for fd in FDS)
    best = minimum_cover(found, len(rows))
    assert got["ih_min"] <= best <= got["ih"]
    for fd in FDS:
        assert incons.ih_single(df, fd).first()["ih"] == minimum_cover(edges(rows, [fd]), len(rows))
        assert incons.im_single(df, fd).first()["im"] == len(edges(rows, [fd]))
    blocks = incons.conflict_blocks(df, FDS).groupBy("fd_no").agg(F.sum(F.col("n") * F.col("later")).alias("e"))
    assert {r["fd_no"]: r["e"] for r in blocks.collect()} == {i: len(edges(rows, [fd])) for i, fd in enumerate(FDS, 1)}


def test_by_columns_measure_every_version(spark):
    (first, rows1), (second, rows2) = table(spark, 3), table(spark, 4)
    both = first.withColumn("v", F.lit(1)).unionByName(second.withColumn("v", F.lit(2)))
    got = {r["v"]: r["im"] for r in incons.im(both, FDS, ["v"]).collect()}
    assert got == {1: len(edges(rows1, FDS)), 2: len(edges(rows2, FDS))}


def test_cover_removes_all_violations(spark):
    df, _ = table(spark, 5, hot=True)
    kept = incons.remove_cover(df, FDS)
    assert profile.count_violations(kept, FDS) == 0
    assert df.count() - kept.count() == incons.ih_bounds(df, FDS).first()["ih"]


def test_matching_of_all_folds_at_once_is_that_of_each(spark):
    rows = [(f"r{i:03d}", i % 3, f"a{i * 7 % 11}", f"b{i * i % 5}", f"c{i * 5 % 4}") for i in range(150)]
    df = spark.createDataFrame(rows, "row_id string, fold int, a string, b string, c string")
    fds = [FD(("a",), "b"), FD(("b",), "c")]
    got = {r["test_fold"]: (r["n_rows"], r["ih_lower"], r["ih_approx"]) for r in cover.matching_by_fold(df, fds, 3).collect()}
    for f in range(3):
        assert got.pop(f) == tuple(cover.matching_cover(df.filter(F.col("fold") != f), fds).first())
    assert not got


@pytest.mark.parametrize("seed", [6, 7])
def test_matching_is_maximal_and_within_twice_the_optimum(spark, seed):
    df, rows = table(spark, seed, hot=seed == 7)
    matched = {r["row_id"] for r in cover.matched_rows(df, FDS).filter("matched_by IS NOT NULL").collect()}
    found = edges(rows, FDS)
    assert all(rows[i]["row_id"] in matched or rows[j]["row_id"] in matched for i, j in found)
    sizes = cover.matching_cover(df, FDS).first()
    best = minimum_cover(found, len(rows))
    assert sizes["ih_lower"] <= best <= sizes["ih_approx"] <= 2 * best


def test_component_repairs_bracket_the_minimum(spark):
    df, rows = table(spark, 8)
    sparse = df.withColumn("b", F.expr("cast(substring(row_id, 4, 1) as int) % 4"))
    for row in rows:
        row["b"] = int(row["row_id"][3]) % 4
    fds = [FD(("a", "b"), "c"), FD(("b", "c"), "d"), FD(("b", "e"), "d")]
    total = cover.exact_total(cover.component_repairs(sparse, fds)).first()
    best = minimum_cover(edges(rows, fds), len(rows))
    assert total["ih_lower"] <= best <= total["ih_upper"] <= 2 * best and total["ih_exact"] in (None, best)
    one = cover.component_repairs(df, FDS[:1])
    assert one.filter("not solved").count() == 0
    assert cover.exact_total(one).first()["ih_exact"] == incons.ih_single(df, FDS[0]).first()[0]


def test_missing_values_stop_the_indices(spark):
    df = spark.createDataFrame([("x", 1, None), ("y", 1, 2)], "row_id string, a int, c int")
    with pytest.raises(ValueError, match="missing"):
        incons.indices(df, [FD(("a",), "c")])


def test_pair_counts_beyond_64_bits(spark):
    n = 5_000_000_000
    combos = spark.createDataFrame([(1, 1, n), (1, 2, n)], "a int, c int, n long")
    assert incons._im(combos, [FD(("a",), "c")], []).first()["im"] == n * n


def test_terms_cancel():
    assert len(incons.im_terms([FD(("a", "b"), "c"), FD(("c",), "d")])) == 4
    chain = [FD((f"c{i}",), f"c{i + 1}") for i in range(12)]
    # Without the empty set the coefficients of any set of dependencies cancel.
    assert sum(incons.im_terms(chain).values()) == 0


def test_many_dependencies_in_batches(spark, monkeypatch):
    df, rows = table(spark, 3)
    whole = incons.im(df, FDS).first()[0]
    monkeypatch.setattr(incons, "SETS_AT_ONCE", 2)
    assert incons.im(df, FDS).first()[0] == whole == len(edges(rows, FDS))


def test_comparison_ignores_unsolved(spark):
    rows = [(1, 4, 2, True), (1, 9, None, False), (2, 0, 0, True)]
    df = spark.createDataFrame(rows, "level int, ih_approx int, ih_exact int, solved boolean")
    got = {(r["level"], r["ih_approx"]): (r["gap"], r["ratio"]) for r in cover.compare_repairs(df).collect()}
    assert got == {(1, 4): (2, 2.0), (1, 9): (None, None), (2, 0): (0, None)}
    assert {r["level"] for r in cover.complete_levels(df, ["level"]).collect()} == {2}


def test_metadata():
    fd = FD(("a", "b"), "c", ("d",))
    other = FD(("c",), "e")
    assert fd.name == "a+b -> c"
    assert corrupted_columns([fd, other]) == ["a", "b", "c", "d", "e"]
    assert corrupted_columns([fd], corrupt_lhs=False) == ["c", "d"]
    assert configurations([fd, other]) == {"C1": [fd], "C2": [fd, other]}
    assert redundancy_dependencies([fd, other]) == [FD(("a", "b"), "d")]


def pairs_of(rows, fd):
    return {frozenset((rows[i]["row_id"], rows[j]["row_id"])) for i, j in edges(rows, [fd])}


def test_every_number_is_one_edge(spark):
    df, rows = table(spark, 8, n=16, hot=True)
    for fd in FDS[:2]:
        want = pairs_of(rows, fd)
        asked = spark.range(-2, len(want) + 3).unionByName(spark.range(5)).withColumn("row_u", F.lit("x"))
        got = numbered.edges_by_number(df.withColumn("k", F.lit(1)).withColumn("g", F.lit("x")), fd, asked).collect()
        assert sorted(int(r["k"]) for r in got) == list(range(len(want)))
        assert len(want) == len(got) and {frozenset((r["row_u"], r["row_v"])) for r in got} == want


def test_sampled_edges(spark):
    df, rows = table(spark, 9, n=16, hot=True)
    want = pairs_of(rows, FDS[0])
    got = numbered.sample_edges(df, FDS[0], 4 * len(want), seed=3).collect()
    found = {frozenset((r["row_u"], r["row_v"])) for r in got}
    assert len(found) == len(got) and found <= want and len(found) > len(want) // 2
    gaps = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("c", 1, None), ("d", 1, 2), ("e", 2, 1)], "row_id string, k int, d int")
    assert {frozenset((r["row_u"], r["row_v"])) for r in numbered.sample_edges(gaps, FD(("k",), "d"), 3, 1).collect()} == {frozenset("cd")}
    assert numbered.sample_edges(gaps.filter("k = 2"), FD(("k",), "d"), 3, 1).count() == 0
    assert numbered.sample_edges(gaps.limit(0), FD(("k",), "d"), 3, 1).count() == 0


def test_components_are_named_after_their_smallest_vertex(spark):
    # Chains a-b-c-... through alternating dependencies, so labels travel several rounds.
    rows = [(f"r{k}", (k + 1) // 2, k // 2, k) for k in range(12)] + [("s0", 100, 200, 1), ("s1", 100, 201, 2)]
    df = spark.createDataFrame(rows, "row_id string, a int, b int, y int")
    got = cover.components(df, [FD(("a",), "y"), FD(("b",), "y")]).collect()
    members = {}
    for r in got:
        members.setdefault(r["component"], set()).add(r["vertex"])
    assert sorted(len(m) for m in members.values()) == [2, 12]
    assert all(min(m) == c for c, m in members.items())


@pytest.mark.parametrize("at_once", [0, 30, 1 << 20])
def test_components_shrink_round_by_round(spark, monkeypatch, at_once):
    """Long chains, a hot group and a pair: few rounds, each of which leaves fewer edges."""
    chain = [(k // 2, 1000 + (k + 1) // 2) for k in range(200)]
    rows = chain + [(-1, 2000 + k) for k in range(60)] + [(-2, 3000 + k) for k in range(2)] + [(-3, 4000)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "a int, b int, y int")
    sizes, stage = [], cover.stage
    monkeypatch.setattr(cover, "EDGES_AT_ONCE", at_once)
    monkeypatch.setattr(cover, "stage", lambda t: (t.columns == ["u", "v"] and sizes.append(t.count())) or stage(t))
    got = cover.components(df, [FD(("a",), "y"), FD(("b",), "y")]).collect()
    members = {}
    for r in got:
        members.setdefault(r["component"], set()).add(r["y"])
        assert r["n"] == 1 and r["component"] <= r["vertex"]
    assert sorted(members.values(), key=len) == [set(range(260, 262)), set(range(200, 260)), set(range(200))]
    assert sizes[0] == 199 + 59 + 1 and len(sizes) <= 20 and all(b < a for a, b in zip(sizes, sizes[1:]))


def test_dependencies_count_their_own_columns(spark, monkeypatch):
    rows = [(i % 5, i % 3, i % 7, i % 2) for i in range(210)]  # all columns together have 210 combinations
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    fds, sizes, stage = [FD(("a",), "b"), FD(("c",), "d")], [], incons.stage
    monkeypatch.setattr(incons, "stage", lambda t: sizes.append(t.count()) or stage(t))
    blocks = incons.conflict_blocks(df, fds).collect()
    assert len(blocks) == 15 + 14 and sum(r["n"] * r["later"] for r in blocks) == 5 * 3 * 14 * 14 + 7 * 15 * 15
    table = {r["fd_no"]: r for r in incons.mechanism(df, fds).collect()}
    assert [table[i]["conflicts"] for i in (1, 2)] == [5 * 3 * 14 * 14, 7 * 15 * 15] and table[1]["rows_involved"] == 210
    assert max(sizes) == 15
