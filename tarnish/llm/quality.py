"""Operator 1: quality scores from random Fourier features of document statistics.

One pass over the texts makes a short row of statistics for each document. Everything later reads only
those: random Fourier features approximate a Gaussian kernel over them, sums of cross products by
partition give the normal equations of a ridge fit, and isotonic regression on scores of left-out
folds turns the fitted values into probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.gram import solve, summed
from tarnish.llm.text import encoded, fold, map_rows
from tarnish.session import stage

FOLDS = 4
BINS = 2000
LOW, HIGH = -0.5, 1.5
SYMBOLS = np.frombuffer(b"#*$%&|<>@^~`\\{}[]_=+", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Shares and lengths that describe a text; all finite, also for the empty text."""
    data = encoded(text)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    size = max(1, len(data))
    words = data.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    distinct = len(set(words))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    letters_upper, letters_lower = counts[65:91].sum(), counts[97:123].sum()
    return [
        np.log1p(len(words)),
        np.log1p(len(data)),
        lengths.mean(),
        lengths.std(),
        float(lengths.max()) if lengths.max() < 100 else 100.0,
        distinct / n / (1 + np.log1p(n)) * 8,
        triples / max(1, len(words) - 2),
        letters_upper / size,
        letters_lower / size,
        counts[48:58].sum() / size,
        counts[128:].sum() / size,
        counts[SYMBOLS].sum() / size,
        counts[124] / size,
        counts[33] / size,
        (counts[44] + counts[46]) / n,
        counts[[63, 58, 59, 34, 39, 40, 41, 45, 47]].sum() / size,
        counts[10] / n,
        len(lines) / n * 10,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) <= 3 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(line.count(b" | ") > 2 or line.isupper() for line in lines) / max(1, len(lines)),
    ]


class Features:
    """Constant, standardised statistics and `width` random cosines of them."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: int, bandwidth: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequency = rng.normal(size=(len(mean), width)) / bandwidth
        self.phase = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, stats: pd.Series) -> np.ndarray:
        x = np.clip((np.stack(stats.to_numpy()) - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([np.ones((len(x), 1)), x, z])


def isotonic(n: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising shares for bins in order, by pooling adjacent violators: (middle bin of a pool, share)."""
    pools: list[list[float]] = []  # rows, positives, weighted bins
    for k, (rows, hits) in enumerate(zip(n, positives, strict=True)):
        if rows <= 0:
            continue
        pools.append([rows, hits, rows * k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            rows_, hits_, place_ = pools.pop()
            pools[-1] = [pools[-1][0] + rows_, pools[-1][1] + hits_, pools[-1][2] + place_]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    held_out_fold: int = 0,
    n_folds: int = 5,
    width: int = 128,
    bandwidth: float = 4.0,
    penalty: float = 1.0,
    threshold: float = 0.3,
    seed: int = 20,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, raw_score) for every row of `docs`.

    Labels (doc_id, quality) of documents in the held-out fold are not used; several labels of one
    document are averaged, null labels ignored. Null texts are empty and are scored like any other.
    Without any usable label, or with one class only, the score is the share of label 1, or 0.5.
    Repeated rows get the same score each; other columns are not used; an empty table gives an empty
    table. Statistics of all documents set the scales, and all usable labels enter the fit.
    """

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "stats": [statistics(t) for t in rows["text"]]}

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stage(map_rows(ids, make, "doc_id long, stats array<double>"))
    table = table.withColumn("held_out", fold(F.col("doc_id"), n_folds) == held_out_fold)
    k = len(statistics(None))
    moments = table.agg(*[F.avg(F.col("stats")[i]) for i in range(k)], *[F.stddev_pop(F.col("stats")[i]) for i in range(k)]).first()
    mean = np.array([v or 0.0 for v in moments[:k]])
    scale = np.array([v if v and v > 1e-9 else 1.0 for v in moments[k:]])
    features = Features(mean, scale, width, bandwidth, seed)

    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = known.filter(fold(F.col("doc_id"), n_folds) != held_out_fold)
    train = stage(table.filter("not held_out").join(known, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("part")))

    def products(batch: pd.DataFrame) -> dict[int, np.ndarray]:
        if not len(batch):
            return {}
        x, y, part = features(batch["stats"]), batch["y"].to_numpy(float), batch["part"].to_numpy()
        return {f: np.hstack([x[part == f].T @ x[part == f], (x[part == f].T @ y[part == f])[:, None]]) for f in range(FOLDS)}

    sums = summed(train, products)
    total = sum(sums.values()) if sums else np.zeros((1 + k + width, 2 + k + width))
    rows, hits = total[0, 0], total[0, -1]
    share = hits / rows if rows else 0.5
    usable = rows > 0 and 0 < hits < rows
    weights = solve(total[:, :-1], total[:, -1], penalty) if usable else np.zeros(1 + k + width)
    left_out = {f: solve(*_without(total, sums.get(f)), penalty) for f in range(FOLDS)} if usable else {}

    def binned(batch: pd.DataFrame) -> dict[int, np.ndarray]:
        if not len(batch):
            return {}
        x, part = features(batch["stats"]), batch["part"].to_numpy()
        raw = sum(np.where(part == f, x @ w, 0) for f, w in left_out.items())
        at = _bin(raw)
        return {0: np.stack([np.bincount(at, minlength=BINS), np.bincount(at, batch["y"].to_numpy(float), BINS)])}

    pools = isotonic(*summed(train, binned)[0]) if usable else (np.zeros(1), np.full(1, share))

    def score(batches):
        for batch in batches:
            raw = features(batch["stats"]) @ weights if len(batch) else np.zeros(0)
            place = (np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * BINS
            # The small rising term orders texts inside a pool; it never leaves 0 to 1.
            value = 0.999 * np.interp(place, *pools) + 0.001 * place / BINS if usable else np.full(len(batch), share)
            yield batch[["doc_id", "held_out"]].assign(score=value, predicted=(value >= threshold).astype(np.int32), raw_score=raw)

    return table.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int, raw_score double")


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)


def _without(total: np.ndarray, part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    rest = total if part is None else total - part
    return rest[:, :-1], rest[:, -1]
