"""Operator 11: ranked lexical search, reversed: the items are the index and the documents stream past it.

The benchmark is small and the corpus is not, so an inverted index over the items' terms goes to every
task. One pass over the texts counts each document's terms that the index knows and, per task, how many
documents hold each. A second pass over these counts, without the texts, scores documents in batches and
keeps a bounded heap of the best ones for each item; the heaps of all tasks are merged in two steps.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tarnish.llm.text import alnum_words, map_rows
from tarnish.session import stage

LAST_ID = (1 << 63) - 1
CELLS = 1 << 21  # score cells that a task holds at once
SLOTS = 32  # parts of an item's heaps that are merged first
COUNTED = "doc_id long, n long, terms binary, tfs binary, docs long, words long, held array<struct<term:int,df:long>>"

_built: dict[str, tuple] = {}


def _blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in parts of about `block_words` words, the most that one index has to hold."""
    distinct = items.filter("text IS NOT NULL").select("item_id", "text").distinct()
    total = distinct.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / (6 * block_words)))
    if n == 1:
        return [distinct]
    distinct = stage(distinct)
    return [distinct.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _counted(docs: DataFrame, shared) -> DataFrame:
    """One row per document with the counts of its known terms, and one per task with its totals."""
    key = uuid.uuid4().hex

    def make():
        if key not in _built:
            _built.clear()
            _built[key] = (shared.value,)
        vocabulary = _built[key][0]
        held = np.zeros(len(vocabulary), np.int64)
        seen = [0, 0]

        def work(rows):
            out = {"doc_id": [], "n": [], "terms": [], "tfs": []}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                words = alnum_words(text)
                if not words:
                    continue
                counts = [(vocabulary[w], k) for w, k in Counter(words).items() if w in vocabulary]
                terms = np.array([t for t, _ in counts], np.int32)
                held[terms] += 1
                seen[0] += 1
                seen[1] += len(words)
                if counts:
                    out["doc_id"].append(doc)
                    out["n"].append(len(words))
                    out["terms"].append(terms.tobytes())
                    out["tfs"].append(np.array([k for _, k in counts], np.int32).tobytes())
            nothing = [None] * len(out["n"])
            return out | {"docs": nothing, "words": nothing, "held": nothing}

        def flush():
            held_now = [{"term": int(t), "df": int(held[t])} for t in np.flatnonzero(held)]
            none = {c: [None] for c in ("doc_id", "n", "terms", "tfs")}
            return none | {"docs": [seen[0]], "words": [seen[1]], "held": [held_now]}

        work.flush = flush
        return work

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id")
    return map_rows(docs.select(ids, "text"), make, COUNTED)


class Heaps:
    """The `k` best documents of each item so far: by score, then the smaller id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.least = np.ones(items, np.int64)  # what a new score has to reach

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        self.item, self.score, self.doc = item[place < self.k], score[order], doc[order]
        full = place[place < self.k] == self.k - 1
        self.least[self.item[full]] = np.maximum(self.score[full], 1)


def _heaps(counted: DataFrame, shared, item_type: T.DataType, k: int) -> DataFrame:
    """(item_no, item_id, doc_id, score): the heaps of every task."""
    key = uuid.uuid4().hex

    def make():
        if key not in _built:
            _built.clear()
            _built[key] = (shared.value,)
        ids, first, posted, repeats, weight, n_docs, n_words = _built[key][0]
        heaps = Heaps(len(ids), k)

        def score(doc, n, terms, tfs, sizes):
            m = 100 - 75 + (75 * n * n_docs) // n_words
            row = np.repeat(np.arange(len(n)), sizes)
            value = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row]))
            length = first[terms + 1] - first[terms]
            each = np.repeat(np.arange(len(terms)), length)
            at = np.arange(len(each)) - np.repeat(np.cumsum(length) - length, length) + first[terms][each]
            cells = np.zeros((len(n), len(ids)), np.int64)
            np.add.at(cells.reshape(-1), row[each] * len(ids) + posted[at], value[each] * repeats[at])
            r, i = np.nonzero(cells >= heaps.least)
            if len(r):
                heaps.add(i, cells[r, i], doc[r])

        def work(rows):
            doc, n = np.array(rows["doc_id"], np.int64), np.array(rows["n"], np.int64)
            sizes = np.array([len(t) // 4 for t in rows["terms"]], np.int64)
            terms = np.frombuffer(b"".join(rows["terms"]), np.int32).astype(np.int64)
            tfs = np.frombuffer(b"".join(rows["tfs"]), np.int32).astype(np.int64)
            ends = np.cumsum(sizes)
            step = max(1, CELLS // len(ids))
            for a in range(0, len(n), step):
                b = min(len(n), a + step)
                low, high = ends[a] - sizes[a], ends[b - 1]
                score(doc[a:b], n[a:b], terms[low:high], tfs[low:high], sizes[a:b])

        def flush():
            return {
                "item_no": heaps.item.tolist(), "item_id": [ids[i] for i in heaps.item],
                "doc_id": heaps.doc.tolist(), "score": heaps.score.tolist(),
            }

        work.flush = flush
        return work

    fields = [("item_no", T.LongType()), ("item_id", item_type), ("doc_id", T.LongType()), ("score", T.LongType())]
    return map_rows(counted, make, T.StructType([T.StructField(n, t) for n, t in fields]), 500)


def _index(items: list[tuple], vocabulary: dict[bytes, int], totals: DataFrame) -> tuple | None:
    """Postings by term (first, item, repeats) with the term weights of this corpus; None without a document."""
    n_docs, n_words = totals.agg(F.sum("docs"), F.sum("words")).first()
    if not n_words:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    # One row for each term of the block comes back.
    for r in totals.select(F.explode("held").alias("h")).groupBy("h.term").agg(F.sum("h.df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    entries = sorted((t, k, n) for k, (_, terms) in enumerate(items) for t, n in terms.items())
    term, item, repeats = (np.array(x, np.int64) for x in zip(*entries, strict=True))
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    return [i for i, _ in items], first, item, repeats, weight, n_docs, n_words


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_words: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best rows of `docs` (doc_id, text) for each of `items` (item_id, text).

    Terms are lower-case runs of letters and digits in the whole text. A term weighs floor(1000 ln((2N+2) /
    (2df+1))); a document adds to a term's weight a share that grows with the term's occurrences and
    shrinks with the document's length, in whole numbers; an item's repeated terms count each time. Only
    scores above 0 are ranked, equal ones by the smaller doc_id; a missing doc_id comes last and stays null.
    Null and empty texts have no terms: such documents count nowhere and such items have no rows.
    Repeated documents are ranked each for itself, repeated items (id and text) once. Items of one id and
    different texts are ranked each for itself. Other columns are not used. An empty table on either
    side gives an empty table. The index holds about `block_words` words of items; more items are
    searched block by block, each in its own passes over the documents.
    """
    spark = docs.sparkSession
    item_type = items.schema["item_id"].dataType
    fields = [("item_id", item_type), ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())]
    found = spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in fields]))
    for block in _blocks(items, block_words):
        vocabulary: dict[bytes, int] = {}
        known = []
        for r in block.collect():
            counts = Counter(alnum_words(r["text"]))
            if counts:
                known.append((r["item_id"], {vocabulary.setdefault(w, len(vocabulary)): n for w, n in counts.items()}))
        if not known:
            continue
        counted = stage(_counted(docs, spark.sparkContext.broadcast(vocabulary)))
        index = _index(known, vocabulary, counted.filter("docs IS NOT NULL"))
        if index is None:
            continue
        rows = counted.filter("docs IS NULL").select("doc_id", "n", "terms", "tfs")
        heaps = _heaps(rows, spark.sparkContext.broadcast(index), item_type, k)
        best = [F.col("score").desc(), F.col("doc_id")]
        heaps = heaps.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
        for keys in (("item_no", "slot"), ("item_no",)):
            heaps = heaps.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= k)
        doc = F.when(F.col("doc_id") != LAST_ID, F.col("doc_id"))
        found = found.unionByName(heaps.select("item_id", "rank", doc.alias("doc_id"), "score"))
    return found
