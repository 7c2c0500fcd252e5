"""Text handling shared by the operators: words as bytes, folds, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Bytes of UTF-8 that are ASCII but neither letter nor digit become blanks, A-Z become a-z.
_ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or the named columns of it."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (blank, 0x09 to 0x0D), in UTF-8."""
    return encoded(text).split()


def lower_spaced_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case; other letters keep their case."""
    return encoded(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of everything beyond ASCII, in UTF-8."""
    return encoded(text).translate(_ALNUM).split()


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df` without columns that would clash with `names` (an operator's own columns win)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]],
    schema: str | T.StructType,
    slice_rows: int = 1000,
) -> DataFrame:
    """Run a function over column lists of a few rows at a time, inside Arrow batches.

    `make` is called once per task and returns the function, so that it can load models there. A
    function with a `flush` attribute is asked once more at the end of its task.
    """
    target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = work(dict(zip(part.schema.names, (c.to_pylist() for c in part.columns), strict=True)))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        if hasattr(work, "flush") and (out := work.flush()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)
