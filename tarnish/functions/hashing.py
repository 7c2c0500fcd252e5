"""Keyed draws: reproducible pseudo-random integers from row keys, the same on every engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60
BUCKET_BITS = 16


def draw(*parts) -> Column:
    """Uniform integer in [0, 2^60) keyed by the given parts (columns or literals)."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *texts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def bucket(h: Column) -> Column:
    """The leading 16 bits of a draw: 65,536 buckets in draw order."""
    return F.shiftright(h, DRAW_BITS - BUCKET_BITS)


def encode(column: Column) -> Column:
    """Text form of a cell in which NULL differs from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def fingerprint(*names: str) -> Column:
    """md5 over all cells of the named columns, NULL-safe."""
    return F.md5(F.concat_ws("|", *[encode(F.col(n)) for n in names]))
