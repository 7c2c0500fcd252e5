"""Reading, preparing and writing tables."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish.functions.numeric import g6
from tarnish.session import stage


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN becomes NULL, so that a missing value is one thing everywhere below."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    fix = {c: F.when(~F.isnan(c), F.col(c)) for c in floats}
    return df.select(*[fix[c].alias(c) if c in floats else F.col(c) for c in df.columns])


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read parquet, or CSV with a header and an explicit schema; missing floats become NULL.

    The header has to match the schema and every row has to fit it; see `load_delimited` for files with bad rows.
    """
    if path.endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV needs an explicit schema; inferring one reads the file twice")
        strict = spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST", columnPruning=False)
        return nan_to_null(strict.csv(path))
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.parquet(path))


def load_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str, keep: Sequence[str] | None = None, separator: str = ","
) -> tuple[DataFrame, DataFrame]:
    """Read delimited files with a header: (rows, bad), `bad` with the text of each set-aside row as `record`.

    A row is bad if it has more or fewer fields than the schema, or if one of its kept columns cannot be read as
    its type. Fields of other columns are cut but not converted. Empty fields are NULL. A header that does not name
    the schema's columns in order raises an error. The files are parsed once, into a staged table; `bad.count()`
    then reads one column of it. A file with nothing but a header gives no rows.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    keep = list(schema.names if keep is None else keep)
    unknown = [c for c in keep if c not in schema.names]
    if unknown:
        raise ValueError(f"columns that the schema lacks: {unknown}")
    record = "record"
    while record.lower() in {c.lower() for c in schema.names}:
        record += "_"
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(record, T.StringType())]))
    reader = reader.options(header=True, sep=separator, mode="PERMISSIVE", enforceSchema=False)
    # Without the parser's own pruning rows are cut whole, so a wrong number of fields shows.
    reader = reader.options(columnNameOfCorruptRecord=record, columnPruning=False)
    read = stage(reader.csv(path).select(*keep, record))
    rows = read.filter(F.col(record).isNull()).select(*keep)
    return nan_to_null(rows), read.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"))


def kept_columns(
    names: Sequence[str],
    blacklist: Collection[str] = (),
    id_token: str = "ID",
    allowed_ids: Collection[str] = (),
    keep: Collection[str] = (),
) -> list[str]:
    """Names that may become features: not blacklisted and not an id, unless allowed or kept."""
    return [
        c for c in names if c in keep or (c not in blacklist and (id_token not in c or c in allowed_ids))
    ]


def prune(df: DataFrame, **rules) -> DataFrame:
    """Keep the columns that `kept_columns` allows; the scan below then reads only those."""
    return df.select(*kept_columns(df.columns, **rules))


def with_row_id(df: DataFrame, keys: Sequence[str], out: str = "row_id") -> DataFrame:
    """Row identity from a natural key: stable across runs, retries and engines."""
    return df.withColumn(out, F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))


def duplicate_ids(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Row ids that occur more than once; must be empty before rows are chosen by id."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Create the prepared table if it is absent, then always re-read it, also right after creation."""
    spark = df.sparkSession
    try:
        return spark.read.schema(df.schema).parquet(_existing(spark, path))
    except FileNotFoundError:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)


def _existing(spark: SparkSession, path: str) -> str:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        raise FileNotFoundError(path)
    return path


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = ("config", "level")) -> None:
    """Add finished cells of an experiment grid to the results table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_cells(df: DataFrame, path: str, cell: Sequence[str]) -> None:
    """Write the cells of an experiment grid that `df` holds; what the table had of those cells goes, all others stay.

    The cell's columns are the table's partitions, so a cell that was written in part or twice is whole again.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*cell).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a derived table (aggregates, tests, summaries) as parquet or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def markdown_rows(df: DataFrame, out: str = "line") -> DataFrame:
    """Each row as a line of a markdown table: numbers as %g, NULL as an empty cell."""
    numeric = (T.NumericType,)
    cells = [
        g6(f.name) if isinstance(f.dataType, numeric) else F.coalesce(F.col(f.name).cast("string"), F.lit(""))
        for f in df.schema.fields
    ]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias(out))


def markdown_header(names: Sequence[str]) -> list[str]:
    """The header and separator lines of a markdown table."""
    return ["| " + " | ".join(names) + " |", "|" + "|".join(["---"] * len(names)) + "|"]
