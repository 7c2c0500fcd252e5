"""Sums of cross products over partitions: the shared step of the linear fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

BUCKETS = 32


def summed(df: DataFrame, parts: Callable[[pd.DataFrame], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums, by key, of the equally shaped arrays that `parts` makes of every batch of rows.

    Each task adds up its own batches; tasks are added in two steps, first those with the same number
    modulo `BUCKETS`, so no step holds more than its share. The driver gets one array for each key.
    """

    def local(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in parts(batch).items():
                total[key] = total[key] + value if key in total else np.asarray(value, float)
        task = TaskContext.get().partitionId() % BUCKETS
        rows = [(key, task, list(value.shape), value.tobytes()) for key, value in total.items()]
        yield pd.DataFrame(rows, columns=["key", "bucket", "shape", "data"])

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in frame["data"])
        return pd.DataFrame([(key[0], key[-1], frame["shape"].iloc[0], total.tobytes())], columns=["key", "bucket", "shape", "data"])

    schema = "key int, bucket int, shape array<int>, data binary"
    rows = df.mapInPandas(local, schema).groupBy("key", "bucket").applyInPandas(add, schema)
    last = lambda key, frame: add((key[0], 0), frame)
    rows = rows.groupBy("key").applyInPandas(last, schema).collect()
    return {r["key"]: np.frombuffer(r["data"]).reshape(r["shape"]) for r in rows}


def solve(matrix: np.ndarray, right: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge solution; the first coefficient, the constant, is free."""
    ridge = np.full(len(right), penalty)
    ridge[0] = 1e-9
    return np.linalg.lstsq(matrix + np.diag(ridge), right, rcond=None)[0]
