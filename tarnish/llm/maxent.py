"""Operator 2: language-model scores from a hashed maximum-entropy model.

Each word belongs to one class: the most frequent words have one of their own, the others share one
with words of the same ending. The class of the next word comes from two softmaxes, one over groups of
classes and one inside the group, over hashed features: the word before, the pair before, and two skips
further back. Inside a class, words have their smoothed share.
All weights are trained by gradient steps inside tasks, averaged over the tasks after each round; all
training texts take part in one round. Counts of all words come from one aggregation.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.frequent import least_count, most_frequent
from tarnish.llm.text import fold, lower_spaced_words, map_rows
from tarnish.session import stage

SMOOTH = 0.1
END = b""  # the token after the last word; no word is empty
SINGLES, ENDINGS, OTHERS = 32, 56, 8
CLASSES = SINGLES + ENDINGS + OTHERS
GROUPS, IN_GROUP = 8, 12  # a class is a group and a place in it; each has its own softmax
# Rows of weights by feature: word before, second before, pair before, third before.
SIZES = (4096, 2048, 4096, 2048)
STARTS = tuple(int(x) for x in np.cumsum((0, *SIZES[:-1])))
ROWS = sum(SIZES)
CHUNK = 16_384
FLUSH = 200_000
CACHE = 300_000
BLOCKS = 64  # parts in which weights are averaged


class WordCounts:
    """Tokens with their counts; partial counts leave when there are many."""

    def __init__(self):
        self.counts: Counter[bytes] = Counter()

    def __call__(self, rows):
        for text in rows["text"]:
            self.counts.update(lower_spaced_words(text))
        self.counts[END] += len(rows["text"])
        return self.flush() if len(self.counts) > FLUSH else None

    def flush(self):
        out = {"word": [w.decode() for w in self.counts], "n": list(self.counts.values())}
        self.counts = Counter()
        return out


class Numbers(dict):
    """Words with their numbers; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Vocabulary:
    """Class, hash and, for frequent words, count of each word; filled as words come, and bounded."""

    def __init__(self, singles: list[bytes], endings: list[str], counts: dict[bytes, int] | None = None):
        self.single = {w: k for k, w in enumerate(singles)}
        self.ending = {e: SINGLES + k for k, e in enumerate(endings)}
        self.counts = counts or {}
        self._clear()

    def _clear(self):
        self.ids = Numbers()
        self.classes, self.hashes, self.logs = (np.zeros(0, t) for t in (np.int32, np.int64, float))

    def class_of(self, word: bytes) -> int:
        found = self.single.get(word)
        if found is None:
            end = word.decode()[-3:]
            found = self.ending.get(end)
            if found is None:
                found = SINGLES + ENDINGS + zlib.crc32(end[-1:].encode()) % OTHERS
        return found

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words in `classes`, `hashes` and `logs`."""
        if len(self.ids) > CACHE:
            self._clear()
        old = len(self.ids)
        found = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > old:
            new = list(islice(self.ids, old, None))
            counts = np.array([self.counts.get(w) or np.nan for w in new], float)
            self.classes = np.append(self.classes, np.array([self.class_of(w) for w in new], np.int32))
            self.hashes = np.append(self.hashes, np.array([zlib.crc32(w) for w in new], np.int64))
            self.logs = np.append(self.logs, np.log10(counts + SMOOTH))
        return found


def tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of some texts, with an end after each, and where each text begins."""
    words: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(words))
        words += lower_spaced_words(text)
        words.append(END)
    return words, np.array(starts, np.int64)


def contexts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of weights of the four features of every token; before a text there are ends."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    end = zlib.crc32(END)
    back = [np.where(place >= k, np.concatenate((np.full(min(k, n), end), hashes[: max(0, n - k)])), end) for k in (1, 2, 3)]
    pair = (back[0] * 0x9E3779B1 + back[1] * 0x85EBCA6B) >> 7
    features = (back[0], back[1], pair, back[2])
    return np.stack([start + (f ^ (f >> 15)) % size for start, f, size in zip(STARTS, features, SIZES, strict=True)])


class Weights:
    """Weights of both softmaxes, class by row, with the mean squared gradients of each row.

    In memory the weights of a row lie side by side, as tokens look them up row by row.
    """

    def __init__(self):
        self.group, self.inner = np.zeros((ROWS, GROUPS), np.float32).T, np.zeros((ROWS * GROUPS, IN_GROUP), np.float32).T
        self.group_squares, self.inner_squares = np.zeros(ROWS, np.float32), np.zeros(ROWS * GROUPS, np.float32)

    def parts(self) -> tuple[np.ndarray, ...]:
        """All of it, with the rows last."""
        return self.group, self.group_squares[None], self.inner, self.inner_squares[None]


def softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exponentials of the summed weights, class by token; not yet divided by their sum."""
    by_row = weights.T
    z = np.take(by_row, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(by_row, r, axis=0)
    z = np.ascontiguousarray(z.T)
    z += bias if bias.ndim > 1 else bias[:, None]
    return np.exp(z, out=z)


def biases(bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups, and of classes inside each group (place by group), from the log share of every class."""
    by_group = bias.reshape(GROUPS, IN_GROUP)
    groups = np.log(np.exp(by_group).sum(axis=1))
    return groups.astype(np.float32), np.ascontiguousarray((by_group - groups[:, None]).T, np.float32)


def log_classes(bias: np.ndarray, weights: Weights, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class after its context."""
    groups_bias, inner_bias = biases(bias)
    out = np.empty(len(classes))
    for at in range(0, len(classes), CHUNK):
        part = slice(at, at + CHUNK)
        group, inner = np.divmod(classes[part], IN_GROUP)
        each = np.arange(len(group))
        z = softmax(groups_bias, weights.group, rows[:, part])
        y = softmax(inner_bias[:, group], weights.inner, rows[:, part] * GROUPS + group)
        out[part] = np.log10(z[group, each] / z.sum(axis=0)) + np.log10(y[inner, each] / y.sum(axis=0))
    return out


class Trainer:
    """Adaptive gradient steps on one task's share of the texts, from the shared weights."""

    def __init__(self, vocabulary: Vocabulary, bias: np.ndarray, weights: Weights, rate: float):
        self.vocabulary, self.weights, self.rate = vocabulary, weights, rate
        self.bias, self.inner_bias = biases(bias)
        self.touched = np.zeros(ROWS), np.zeros(ROWS * GROUPS)

    def __call__(self, columns):
        words, starts = tokens(columns["text"])
        ids = self.vocabulary(words)
        rows, classes = contexts(self.vocabulary.hashes[ids], starts), self.vocabulary.classes[ids]
        for at in range(0, len(classes), CHUNK):
            part = slice(at, at + CHUNK)
            group, inner = np.divmod(classes[part], IN_GROUP)
            w = self.weights
            self._step(w.group, w.group_squares, self.touched[0], self.bias, rows[:, part], group, 1)
            self._step(w.inner, w.inner_squares, self.touched[1], self.inner_bias[:, group], rows[:, part] * GROUPS + group, inner, GROUPS)

    def _step(self, weights, squares, touched, bias, rows, target, width):
        error = softmax(bias, weights, rows)
        error /= error.sum(axis=0)
        error[target, np.arange(len(target))] -= 1
        error = error.astype(float)  # as bincount sums it
        for start, size, r in zip(STARTS, SIZES, rows, strict=True):
            # Only the rows that a token of the chunk has get a gradient.
            place = r - start * width
            times = np.bincount(place, minlength=size * width)
            seen = np.flatnonzero(times)
            at = np.empty(size * width, np.int64)
            at[seen] = np.arange(len(seen))
            place, own = at[place], seen + start * width
            gradient = np.stack([np.bincount(place, e, len(seen)) for e in error]).astype(np.float32)
            squares[own] += np.square(gradient).mean(axis=0)
            gradient *= self.rate / np.sqrt(squares[own] + 1)
            weights.T[own] -= gradient.T
            touched[own] += times[seen]

    def flush(self):
        """Blocks of rows that any token touched: weights, squares and how often, as numbers of 32 bits."""
        parts = (*self.weights.parts(), self.touched[0][None], self.touched[1][None])
        blocks = [b for b in range(BLOCKS) if self.touched[0][_rows(b, ROWS)].any()]
        return {"block": blocks, "state": [b"".join(p[:, _rows(b, p.shape[1])].astype("<f4").tobytes() for p in parts) for b in blocks]}


def _rows(block: int, n: int) -> slice:
    return slice(block * n // BLOCKS, (block + 1) * n // BLOCKS)


def _unpacked(state: bytes) -> list[np.ndarray]:
    """Group weights, their squares, inner weights, their squares, and how often rows of both were touched."""
    n = ROWS // BLOCKS
    shapes = [(GROUPS, n), (1, n), (IN_GROUP, n * GROUPS), (1, n * GROUPS), (1, n), (1, n * GROUPS)]
    cuts = np.cumsum([a * b for a, b in shapes])[:-1]
    return [x.reshape(s) for x, s in zip(np.split(np.frombuffer(state, "<f4"), cuts), shapes, strict=True)]


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights and squares of a block, averaged by how many tokens of a task touched each row."""
    total = None
    for state in frame["state"]:
        *values, group, inner = _unpacked(state)
        weighted = [v * (group if k < 2 else inner).astype(float) for k, v in enumerate(values)] + [group.astype(float), inner.astype(float)]
        total = weighted if total is None else [a + b for a, b in zip(total, weighted, strict=True)]
    *sums, group, inner = total
    mean = [v / np.maximum(group if k < 2 else inner, 1e-9) for k, v in enumerate(sums)]
    data = b"".join(v.astype("<f4").tobytes() for v in (*mean, group, inner))
    return pd.DataFrame({"block": frame["block"].iloc[:1], "state": [data]})


def train(docs: DataFrame, singles, endings, bias: np.ndarray, rounds: int, rate: float) -> Weights:
    """Weights after one pass over all of `docs`, a share of them in each round."""
    spark = docs.sparkSession
    weights = Weights()
    tasks = 4 * spark.sparkContext.defaultParallelism  # each returns at most one set of weights
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def make(shared=shared):
            return Trainer(Vocabulary(singles, endings), bias, copy.deepcopy(shared.value), rate)

        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k).select("text").coalesce(tasks)
        states = map_rows(part, make, "block int, state binary", 500).groupBy("block").applyInPandas(_average, "block int, state binary")
        for r in states.collect():  # one set of weights in all
            *values, group, inner = _unpacked(r["state"])
            for j, (whole, new) in enumerate(zip(weights.parts(), values, strict=True)):
                seen = np.flatnonzero((group if j < 2 else inner)[0])
                whole[:, _rows(r["block"], whole.shape[1])][:, seen] = new[:, seen]
        shared.unpersist()
    return weights


def score_texts(
    docs: DataFrame, held_out_fold: int = 0, n_folds: int = 10, n_head: int = 65_536, rounds: int = 3, rate: float = 0.25
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Tokens are lower-cased words between ASCII white space, then one end. Counts, classes and weights
    come from all rows outside the held-out fold. `base_score` is the log10 probability under smoothed
    word counts, `score` the one under the model; in both, all words without a count share the place of
    one more word (in the model: of each class). Counts of the `n_head` most frequent words are sent to
    every task; all others are joined. A null or empty text is one end. Repeated rows count and are
    scored each for itself; other columns are not used; an empty table gives an empty table, and
    without training rows no word is known.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), n_folds) == held_out_fold)
    training = docs.filter("not held_out")
    counts = stage(map_rows(training.select("text"), WordCounts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n_all, n_words = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())

    head = {w.encode(): n for w, n in most_frequent(counts, n_head).items()}
    top = counts.filter("word <> ''").orderBy(F.desc("n"), "word").limit(SINGLES - 1).collect()
    singles = [END, *[r["word"].encode() for r in top]]
    rest = counts.filter(~F.col("word").isin([s.decode() for s in singles]))
    by_ending = rest.groupBy(F.right("word", F.lit(3)).alias("ending")).agg(F.sum("n").alias("n"))
    endings = [r["ending"] for r in by_ending.orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()]
    sizes = class_sizes(counts, singles, endings)
    log_sizes = np.log10(sizes[0] + SMOOTH * (sizes[1] + 1))
    bias = np.log((sizes[0] + 1) / (sizes[0].sum() + CLASSES)).astype(np.float32)
    weights = train(training, singles, endings, bias, rounds, rate)
    shared = spark.sparkContext.broadcast((weights, head))

    def make():
        weights, head = shared.value
        vocabulary = Vocabulary(singles, endings, head)
        state = {"next": TaskContext.get().partitionId() << 36}

        def work(columns):
            words, starts = tokens(columns["text"])
            ids = vocabulary(words)
            classes, logs = vocabulary.classes[ids], vocabulary.logs[ids]
            model = log_classes(bias, weights, contexts(vocabulary.hashes[ids], starts), classes) - log_sizes[classes]
            rare = np.isnan(logs)
            n = np.diff(np.append(starts, len(words)))
            known = np.add.reduceat(~rare, starts, dtype=np.int64)
            stops = starts + n
            tails = [[words[k].decode() for k in (a + np.flatnonzero(rare[a:b])).tolist()] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            numbers = list(range(state["next"], state["next"] + len(n)))
            state["next"] += len(n)
            return columns | {
                "row": numbers,
                "n_tokens": n.tolist(),
                "head_known": known.tolist(),
                "head_log": np.add.reduceat(np.where(rare, 0, logs), starts).tolist(),
                "model_log": np.add.reduceat(model, starts).tolist(),
                "tail": tails,
            }

        return work

    schema = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, model_log double, tail array<string>"
    scored = stage(map_rows(docs, make, schema, 500))
    # Rare words only: each is a small share of all tokens, so no key of this join is hot.
    rare = scored.select("row", F.explode("tail").alias("word")).join(counts.filter(F.col("n") < least_count(counts, n_head)), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("tail_log"), F.count("n").alias("tail_known")
    )
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    return scored.drop("tail").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (log - F.col("n_tokens") * F.lit(float(np.log10(n_all + SMOOTH * (n_words + 1))))).alias("base_score"),
        (log + F.col("model_log")).alias("score"),
    )


def class_sizes(counts: DataFrame, singles, endings) -> np.ndarray:
    """Tokens and different words of each class."""

    def make():
        vocabulary = Vocabulary(singles, endings)

        def work(rows):
            classes = np.array([vocabulary.class_of(w.encode()) for w in rows["word"]], int)
            n = np.bincount(classes, np.array(rows["n"], float), CLASSES)
            v = np.bincount(classes, minlength=CLASSES)
            hit = np.flatnonzero(v)
            return {"class": hit.tolist(), "n": n[hit].tolist(), "v": v[hit].tolist()}

        return work

    sums = map_rows(counts, make, "class int, n double, v long", 10_000).groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = np.zeros((2, CLASSES))
    for r in sums.collect():
        out[:, r["class"]] = r["n"], r["v"]
    return out
