"""Join-back of per-key statistics to rows when a few keys may own most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.functions.ranking import free_name

HOT_KEYS = 1000


def attach(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], values: Sequence[str], size: str, total,
    identity: str = "row_id",
) -> DataFrame:
    """Left-join `values` of `stats` (one row per key, `size` = rows behind the key) to `rows`.

    Keys owning more than 1/1000 of `total` rows are hot. There are fewer than 1000 of them by
    arithmetic, so their statistics are broadcast, and their rows are spread over the shuffle of the
    remaining keys by a hash of the row instead of meeting in one partition: of its identity column where
    there is one, so that no other column has to be read, else of all columns.
    """
    keys, values = list(keys), list(values)
    spread = [identity] if identity in rows.columns else rows.columns
    hot_test = F.col(size) * HOT_KEYS > total
    # What is joined on goes under names that the rows do not have, values in one struct for each side.
    mark, slot = free_name(rows, "_hot"), free_name(rows, "_slot")
    value = F.struct(*[F.col(v) for v in values])
    hot = stats.filter(hot_test).select(*keys, value.alias(mark))
    cold = stats.filter(~hot_test).select(*keys, F.lit(0).alias(slot), value.alias(free_name(rows, "_cold")))
    dealt = F.when(F.col(mark).isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(F.lit(0))
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn(slot, dealt.cast("int"))
        .join(cold, [*keys, slot], "left")
        .withColumn(mark, F.coalesce(mark, free_name(rows, "_cold")))
    )
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in values], *[F.col(mark).getField(v).alias(v) for v in values])
