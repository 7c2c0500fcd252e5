"""Operator 13: hard negatives, found in a multiway tree of hyperplanes with exact leaves.

An anchor's positives are the nearest vectors of its label; its hard negatives are the nearest ones of
other labels whose scores lie within a window below the positive's score. Both are searches for the best
few scores of a window: the tree (see `gnat`) leaves out subtrees, and what is left is scored exactly.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnish.llm.gnat import Tree
from tarnish.llm.text import map_rows
from tarnish.session import stage

CHUNK = 256  # queries that are scored together
FAR = float(1 << 62)

_built: dict[str, tuple] = {}


def clean(rows: DataFrame, scale: int, flip_every: int, labels: int) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, one for each id; `q` are whole numbers."""
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    number = lambda x: x.cast("double")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) < math.inf), F.lit(False)))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    flipped = F.when(F.pmod(vec_id, F.lit(flip_every)) == 0, (label + 1) % labels).otherwise(label)
    whole = F.transform("embedding", lambda x: F.floor(number(x) * scale).cast("long"))
    taken = rows.filter(known & finite).select(vec_id.alias("vec_id"), F.struct(flipped.alias("label"), whole.alias("q")).alias("row"))
    return taken.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.q")


class Index:
    """What every task needs: the tree, the type of the vectors' bytes, and the parts that rows are dealt to."""

    def __init__(self, tree: Tree, width: int, kind: str, rows: dict[int, int], queries: dict[int, int], part_rows: int, block: int):
        self.tree, self.width, self.kind = tree, width, kind
        self.parts, self.n_parts = _dealt(rows, tree.leaves, part_rows)
        self.blocks, _ = _dealt(queries, tree.leaves, block)
        self.part_of_leaf = np.zeros((self.n_parts, tree.leaves), bool)
        for leaf, (first, n) in enumerate(self.parts):
            self.part_of_leaf[first : first + n, leaf] = leaf in rows

    def vectors(self, packed) -> np.ndarray:
        return np.frombuffer(b"".join(packed), self.kind).reshape(len(packed), self.width).astype(np.float64)


def _dealt(counts: dict[int, int], leaves: int, size: int) -> tuple[list[tuple[int, int]], int]:
    """(first part, number of parts) by leaf: small leaves share a part, large ones have several."""
    out, part, filled = [], 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if filled and filled + n > size:
            part, filled = part + 1, 0
        pieces = max(1, math.ceil(n / size))
        out.append((part, pieces))
        if pieces > 1:
            part, filled = part + pieces, 0
        else:
            filled += n
    return out, part + 1


def _shared(spark, value):
    """A function that unpacks a broadcast value once in each worker."""
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def get():
        if key not in _built:
            if len(_built) > 4:
                _built.clear()
            _built[key] = sent.value
        return _built[key]

    return get


def _slot(table: str, leaf, identity, index: Index):
    """The part (or block) of a row: its leaf's, one of several by a hash."""
    dealt = getattr(index, table)
    first, n = (F.array(*[F.lit(x[k]) for x in dealt]) for k in (0, 1))
    return F.get(first, leaf) + F.pmod(F.xxhash64(identity), F.get(n, leaf)).cast("int")


def _plan(asked: DataFrame, get, home: bool) -> DataFrame:
    """`asked` with `part`, once for each part to visit: those of the own leaf, or all others that may hold something."""

    def make():
        index: Index = get()

        def work(rows):
            x = index.vectors(rows["q"])
            own = index.part_of_leaf[:, np.array(rows["leaf"], np.int64)].T
            if home:
                visit = own
            else:
                windows = [(k, w["low"], w["high"]) for k, ws in enumerate(rows["windows"]) for w in ws]
                owner, low, high = (np.array(c, t) for c, t in zip(zip(*windows, strict=True), (np.int64, float, float), strict=True))
                visit = np.zeros((len(x), index.n_parts), bool)
                at, part = np.nonzero((index.tree.alive(x, owner, low, high).astype(np.float32) @ index.part_of_leaf.T.astype(np.float32)) > 0)
                visit[owner[at], part] = True
                visit &= ~own
            who, part = np.nonzero(visit)
            return {c: [rows[c][k] for k in who] for c in names} | {"part": part.tolist()}

        return work

    names = asked.columns
    schema = asked.withColumn("part", F.lit(0)).schema
    return map_rows(asked, make, schema, CHUNK)


def best_of(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of the `k` best fitting scores of each query; columns have rising ids, so the smaller id wins a tie."""
    left = np.where(fits, scores, -np.inf)
    rows, columns = [], []
    for _ in range(min(k, left.shape[1])):
        at = left.argmax(1)
        who = np.flatnonzero(left[np.arange(len(left)), at] > -np.inf)
        if not len(who):
            break
        rows.append(who)
        columns.append(at[who])
        left[who, at[who]] = -np.inf
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(get, same: bool, k: int):
    """Scores of the queries of one block with the rows of one part, exact."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index: Index = get()
        left = left.sort_values("vec_id", kind="stable")
        x, ids, label, leaf = index.vectors(left["q"]), left["vec_id"].to_numpy(), left["label"].to_numpy(), left["leaf"].to_numpy()
        here = np.zeros(index.tree.leaves, bool)
        here[leaf] = True
        found = [pd.DataFrame({"cid": np.zeros(0, object), "no": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        for a in range(0, len(right), CHUNK):
            asked = right.iloc[a : a + CHUNK]
            q, mine, cids = index.vectors(asked["q"]), asked["label"].to_numpy(), asked["cid"].to_numpy()
            windows = [(n, turn, w["no"], w["low"], w["high"]) for n, ws in enumerate(asked["windows"]) for turn, w in enumerate(ws)]
            kinds = (np.int64, np.int64, np.int64, float, float)
            owner, turn, no, low, high = (np.array(c, t) for c, t in zip(zip(*windows, strict=True), kinds, strict=True))
            open_ = index.tree.alive(q, owner, low, high, here)
            fits = (mine[:, None] == label[None, :]) == same
            scores = q @ x.T
            for t in range(turn.max() + 1):
                some = np.flatnonzero((turn == t) & open_[:, here].any(1))
                who = owner[some]
                inside = fits[who] & open_[some][:, leaf] & (scores[who] >= low[some, None]) & (scores[who] <= high[some, None])
                r, c = best_of(scores[who], inside, k)
                found.append(pd.DataFrame({"cid": cids[who[r]], "no": no[some[r]], "vec_id": ids[c], "score": scores[who[r], c].astype(np.int64)}))
        return pd.concat(found)

    return compare


def best(asked: DataFrame, rows: DataFrame, index: Index, get, same: bool, k: int) -> DataFrame:
    """(cid, no, vec_id, score): the `k` best rows of the same or of other labels for each window of each query.

    First the parts of the query's own leaf are searched. The k-th score found there lifts the window's
    lower end, and then only parts are visited in which the tree leaves something possible.
    """

    def visit(queries: DataFrame, home: bool) -> DataFrame:
        planned = stage(_plan(queries, get, home).withColumn("block", _slot("blocks", F.col("leaf"), F.col("cid"), index)))
        dealt = rows.join(planned.select("part", F.col("block").alias("for_block")).distinct(), "part").withColumnRenamed("part", "in_part")
        return dealt.groupBy("in_part", "for_block").cogroup(planned.groupBy("part", "block")).applyInPandas(
            _compare(get, same, k), "cid string, no long, vec_id long, score long"
        )

    ranked = W.partitionBy("cid", "no").orderBy(F.col("score").desc(), "vec_id")
    top = lambda found: found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k)
    near = stage(top(visit(asked, True)))
    reached = near.filter(F.col("place") == k).groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("no", "score"))).alias("reached"))
    lifted = F.transform("windows", lambda w: F.struct(
        w["no"].alias("no"), F.greatest(w["low"], F.coalesce(F.try_element_at("reached", w["no"]), w["low"])).alias("low"), w["high"].alias("high")
    ))
    # A query has no more windows than it may have positives, so the list of a query is short.
    again = asked.join(reached, "cid", "left").withColumn("windows", lifted).select(*asked.columns)
    return stage(top(near.drop("place").unionByName(visit(again, False)))).drop("place")


def hard_negatives(
    rows: DataFrame,
    anchor_every: int = 50,
    flip_every: int = 7,
    labels: int = 10,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    sample_rows: int = 4096,
    fanout: int = 16,
    leaf_rows: int = 256,
    part_rows: int = 4096,
    block: int = 512,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `rows` (vec_id, embedding, label).

    Rows with a missing id, label or vector, or with a missing or non-finite component, take no part. Every
    `flip_every`-th id first gets the next of `labels` labels. Components become floor(`scale` x); a score is
    the inner product of two vectors, shorter ones are filled with zeros. Anchors are the rows whose id
    `anchor_every` divides; their positives are the first `positives` rows of another id and the same label, by
    descending score, then ascending id. For each, the first `negatives` rows of other labels are returned
    whose scores are at least `low_percent` and at most `high_percent` of the positive's. Repeated rows count
    once; of different rows with one id the one with the smallest label, then vector, counts. Scores must stay
    below 2^53. An empty table gives an empty table. Other columns are not used.

    The result is exact. The tree's split points come from a sample of `sample_rows` rows (by a hash of the
    id), the ranges from all rows; leaves grow with the table up to `fanout`^3. Rows of one vector
    and label are scored as the `positives` + 1 smallest ids of them, as no other can be among the first;
    anchors of one vector and label are one query. Rows are dealt in parts of about `part_rows`, large
    leaves in several, and queries in blocks of about `block`: a task holds one of each.
    """
    spark = rows.sparkSession
    shown = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    table = stage(clean(rows, scale, flip_every, labels))
    size = F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))
    width, largest = table.agg(F.max(F.size("q")), F.max(size)).first()
    if width is None:
        return spark.createDataFrame([], shown)
    kind = next((k for k, bits in (("<i2", 15), ("<i4", 31)) if (largest or 0) < 1 << bits), "<i8")
    ranked = W.partitionBy("q", "label").orderBy("vec_id")
    few = table.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= positives + 1).drop("place")

    # The sample is bounded by its parameter, whatever the table.
    chosen = table.select("vec_id", "q").orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(sample_rows).collect()
    sample = np.zeros((len(chosen), width))
    for k, r in enumerate(chosen):
        sample[k, : len(r["q"])] = r["q"]
    n_rows = table.count()
    levels = min(3, max(1, round(math.log(max(1, n_rows / leaf_rows), fanout))))
    tree = Tree(sample, fanout, levels)
    plant = _shared(spark, tree)

    def make():
        grown: Tree = plant()

        def work(r):
            x = np.zeros((len(r["q"]), width), np.int64)
            for k, q in enumerate(r["q"]):
                x[k, : len(q)] = q
            leaf = grown.leaf(x.astype(np.float64))
            return {"vec_id": r["vec_id"], "label": r["label"], "cid": r["cid"], "leaf": leaf.tolist(), "q": [v.tobytes() for v in x.astype(kind)]}

        return work

    planted = "vec_id long, label long, cid string, leaf int, q binary"
    cid = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("q").cast("array<string>"))).alias("cid")
    known = stage(map_rows(few.select("vec_id", "label", cid, "q"), make, planted))
    anchors = stage(map_rows(table.filter(F.pmod("vec_id", F.lit(anchor_every)) == 0).select("vec_id", "label", cid, "q"), make, planted))

    def gather():
        grown: Tree = plant()

        def work(r):
            x = np.frombuffer(b"".join(r["q"]), kind).reshape(len(r["q"]), width).astype(np.float64)
            out = list(grown.measure(x, np.array(r["leaf"])))
            return dict(zip(("node", "point", "child", "low", "high"), map(list, zip(*out, strict=True)), strict=True))

        return work

    measured = map_rows(known.select("leaf", "q"), gather, "node int, point int, child int, low double, high double")
    # At most one row for each pair of siblings of the bounded tree comes back.
    tree.fit([tuple(r) for r in measured.groupBy("node", "point", "child").agg(F.min("low"), F.max("high")).collect()])
    queries = stage(anchors.drop("vec_id").dropDuplicates(["cid"]))
    counts = [{r["leaf"]: r["n"] for r in t.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()} for t in (known, queries)]
    index = Index(tree, width, kind, *counts, part_rows, block)
    get = _shared(spark, index)
    dealt = stage(known.select("vec_id", "label", "leaf", "q", _slot("parts", F.col("leaf"), F.col("vec_id"), index).alias("part")))

    window = lambda no, low, high: F.struct(no.cast("long").alias("no"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    asked = queries.withColumn("windows", F.array(window(F.lit(0), F.lit(-FAR), F.lit(FAR))))
    near = best(asked, dealt, index, get, True, positives + 1)
    # One window for each different score of a positive; no more than `positives` + 1 for each query.
    scores = F.array_sort(F.array_distinct(F.collect_list("score")))
    wanted = F.filter("scores", lambda s: s >= 0)
    below = lambda n: ((n - F.pmod(n, F.lit(100))) / 100).cast("long")
    low = lambda s: below(s * low_percent + 99)
    high = lambda s: below(s * high_percent)
    per_query = near.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id"))).alias("positives"), scores.alias("scores"))
    per_query = stage(per_query.withColumn("windows", F.transform(wanted, lambda s: window(s, low(s), high(s)))))
    asked = queries.join(per_query.filter(F.size("windows") > 0).select("cid", "windows"), "cid")
    far = best(asked, dealt, index, get, False, negatives)

    per_query = per_query.select("cid", "positives").join(
        far.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("no", (-F.col("score")).alias("order"), "vec_id"))).alias("negatives")), "cid"
    )
    others = F.slice(F.filter("positives", lambda p: p["vec_id"] != F.col("vec_id")), 1, positives)
    pairs = anchors.select("vec_id", "cid").join(per_query, "cid").select(F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p"), "negatives")
    mine = F.filter("negatives", lambda n: n["no"] == -F.col("p.order"))
    out = pairs.select("anchor_id", "p", F.posexplode(mine).alias("at", "n"))
    return out.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        (-F.col("p.order")).alias("positive_score"), (-F.col("n.order")).alias("negative_score"),
    )
