"""Ranked search, the curriculum and hard negatives against plain Python, on odd rows and on clustered vectors."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tarnish.llm import negatives
from tarnish.llm.curriculum import SCHEDULES, mix, position
from tarnish.llm.gnat import Tree
from tarnish.llm.negatives import hard_negatives
from tarnish.llm.search import Heaps, search
from tests.llm.plain import FOLD, SPACED

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    terms = [(d, TERM.findall((t or "").translate(FOLD))) for d, t in docs]
    terms = [(d, t) for d, t in terms if t]
    n_docs, n_words = len(terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    out = []
    for item, text in {(i, t) for i, t in items if t}:
        scores = []
        for doc, ts in terms:
            tf, m = Counter(ts), 100 - 75 + (75 * len(ts) * n_docs) // n_words
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in tf}
            score = sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in TERM.findall(text.translate(FOLD)) if t in tf)
            if score > 0:
                scores.append((-score, (1 << 63) if doc is None else doc))
        out += [(item, k_ + 1, None if d == 1 << 63 else d, -s) for k_, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_search(spark, table, made, block_words):
    items = [(1, made[5][1]), (2, "changed among documents CHANGED x"), (3, None), (4, "..."), (5, "nowhere"), (6, "ÜNÏ ünï 日本語"), (2, "changed among documents CHANGED x"), (7, "long tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table.unionByName(spark.createDataFrame([(None, "changed x")], "doc_id long, text string"), allowMissingColumns=True)
    got = found(search(docs, bench, block_words=block_words), "item_id", "rank", "doc_id", "score")
    want = ranked([*made, (None, "changed x")], items)
    assert got == want and {w[0] for w in want} >= {1, 2, 6, 7} and any(w[2] is None for w in want)


def test_search_on_empty_tables(spark, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert search(docs, none).count() == 0 and search(empty, some).count() == 0
    assert search(docs.filter("text IS NULL"), some).count() == 0
    assert search(docs, some).columns == ["item_id", "rank", "doc_id", "score"]


def test_heaps_keep_the_best():
    rng = np.random.default_rng(3)
    heaps, seen = Heaps(4, 5), []
    for _ in range(30):
        item, score, doc = rng.integers(0, 4, 50), rng.integers(1, 40, 50), rng.integers(0, 1000, 50)
        keep = score >= heaps.least[item]
        heaps.add(item[keep], score[keep], doc[keep])
        seen += zip(item.tolist(), (-score).tolist(), doc.tolist(), strict=True)
    want = [x for i in range(4) for x in sorted(s for s in seen if s[0] == i)[:5]]
    assert sorted(zip(heaps.item.tolist(), (-heaps.score).tolist(), heaps.doc.tolist(), strict=True)) == sorted(want)


def shared_out(sizes, weights, demand=1.5, most=2):
    """Targets by stopping one source after another, in exact order of names."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out = demand * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] >= most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]


def corpus():
    rng = random.Random(8)
    docs = [(k, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), rng.choice(["a"] * 8 + ["b", "é", "z", None, "~", "="])) for k in range(400)]
    return [*docs, (1000, None, "b"), (None, "no id", "z"), (None, "no id", "z"), docs[3], docs[3], (1001, "long " * 5000, "z"), (1002, "", "only")]


def test_mix(spark):
    docs = corpus()
    table = spark.createDataFrame([(*d, 5, "mine") for d in docs], "doc_id long, text string, source string, TAKEN long, no string").repartition(5)
    got = mix(table)
    assert {*got.columns} == {"doc_id", "text", "source", "no", "size", "source_size", "target", "taken", "position", "uses"}
    rows = got.collect()
    assert len(rows) == len(docs) and sorted(repr((r["doc_id"], r["text"], r["source"])) for r in rows) == sorted(map(repr, docs))
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(SPACED.findall(text or ""))
    want = shared_out(sizes, (5, 2, 1))
    taken = Counter()
    for r in rows:
        assert r["size"] == len(SPACED.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert sum(u["words"] for u in r["uses"]) == r["taken"] and len(r["uses"]) <= 2
        assert [u["position"] for u in r["uses"]] == sorted(u["position"] for u in r["uses"]) and all(0 <= u["position"] <= 1 for u in r["uses"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 + 1e-6 * want[s] for s in sizes)
    order = [r["position"] for r in rows]
    seen = [p for p in order if p is not None]
    assert seen == sorted(seen) and all(p is None for p in order[len(seen) :])
    again = {repr((r["doc_id"], r["text"])): r["taken"] for r in mix(table.repartition(2)).collect()}
    assert again == {repr((r["doc_id"], r["text"])): r["taken"] for r in rows}


def test_mix_of_little(spark, empty):
    assert mix(empty).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"], r["position"]) for r in mix(docs).collect()] == [(0, 0.0, 0, None)] * 2
    one = mix(spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")).first()
    assert (one["taken"], one["target"], [u["words"] for u in one["uses"]]) == (4, 4.5, [3, 1])
    with pytest.raises(ValueError):
        mix(docs, demand=3)


@pytest.mark.parametrize("schedule", [*SCHEDULES, ((0, 0), (0.2, 3), (0.7, 0), (1, 0.5)), ((0, 1), (0.5, 0), (0.6, 0), (1, 2))])
def test_position_inverts_the_integral(spark, schedule):
    shares = [k / 50 for k in range(51)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s,) for s in shares], "share double").select("share", position(F.col("share"), schedule).alias("t")).collect()
    times = [p[0] for p in schedule]
    weight = [p[1] for p in schedule]
    grid = np.linspace(0, 1, 200_001)
    area = np.concatenate([[0], np.cumsum((np.interp(grid[1:], times, weight) + np.interp(grid[:-1], times, weight)) / 2)]) / 200_000
    for r in rows:
        assert np.interp(r["t"], grid, area) / area[-1] == pytest.approx(r["share"], abs=1e-6)


def mined(rows, every=50):
    """By brute force over all pairs."""
    known = {}
    for v, x, label in rows:
        if v is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = ((label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * c) for c in x])
        known[v] = min(known.get(v, row), row)
    out = []
    for a in known:
        if a % every:
            continue
        label, q = known[a]
        others = [(-sum(s * t for s, t in zip(q, x, strict=False)), v, m) for v, (m, x) in known.items() if v != a]
        for score, v, _ in sorted(o for o in others if o[2] == label)[:5]:
            hard = sorted(o for o in others if o[2] != label and 50 * -score <= 100 * -o[0] <= 95 * -score)[:3]
            out += [(a, v, k + 1, n, -score, -s) for k, (s, n, _) in enumerate(hard)]
    return sorted(out)


def vectors(seed=1, n=700, dim=8):
    """Clusters, one vector held by many ids, and odd rows; some rows stand twice."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(k, (centres[k % 12] + rng.normal(size=dim) * 0.2).astype(np.float32).tolist(), int(rng.integers(0, 4))) for k in range(n)]
    rows += [(1000 + k, [0.5] * dim, k % 3) for k in range(250)]
    odd = [(5000, None, 1), (5050, [float("nan")] * dim, 1), (5100, [1.0, None], 1), (5150, [math.inf] * dim, 2), (5200, [0.4] * dim, None), (None, [0.4] * dim, 1)]
    odd += [(5250, [0.3, 0.2], 1), (5300, [], 2), (5350, [0.0] * dim, 3), (5400, [100.0] * dim, 0), rows[50], rows[0], (5450, [0.1] * dim, 2), (5450, [0.2] * dim, 2)]
    return rows + odd


def as_table(spark, rows):
    return spark.createDataFrame([(v, x, label, 7.0) for v, x, label in rows], "vec_id long, embedding array<float>, label int, q double").repartition(4)


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 8, "part_rows": 60, "block": 7, "fanout": 4, "sample_rows": 200}])
def test_hard_negatives(spark, sizes):
    rows = vectors()
    want = mined(rows)
    assert found(hard_negatives(as_table(spark, rows), **sizes), *NAMES) == sorted(want, key=repr) and len(want) > 100


def test_hard_negatives_of_little(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(none).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.2], 2), (50, None, 1), (3, [0.1, 0.0], 2)]
    assert found(hard_negatives(as_table(spark, few)), *NAMES) == sorted(mined(few), key=repr)
    assert hard_negatives(as_table(spark, [(0, [0.0], 1)])).count() == 0


def test_tree_leaves_out_subtrees_but_no_hit():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 6)) * 300
    x = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(2000, 6)) * 10)
    tree = Tree(x[::7], 5, 3)
    leaf = tree.leaf(x)
    tree.fit(list(tree.measure(x, leaf)))
    q = x[::40]
    scores = q @ x.T
    low = np.sort(scores, 1)[:, -20] - 0.0
    high = np.sort(scores, 1)[:, -5] + 0.0
    alive = tree.alive(q, np.arange(len(q)), low, high)
    hits = (scores >= low[:, None]) & (scores <= high[:, None])
    who, row = np.nonzero(hits)
    assert alive[who, leaf[row]].all()
    assert tree.leaves > 50 and alive.mean() < 0.3  # most leaves are never looked at
    some = np.zeros(tree.leaves, bool)
    some[leaf[:100]] = True
    assert (tree.alive(q, np.arange(len(q)), low, high, some)[:, some] == alive[:, some]).all()


def test_rows_are_dealt_in_parts():
    parts, n = negatives._dealt({0: 3, 1: 3, 2: 25, 4: 1, 5: 9}, 6, 10)
    assert parts == [(0, 1), (0, 1), (1, 3), (4, 1), (4, 1), (4, 1)] and n == 5
