"""Session defaults and the shared staging folder."""

from __future__ import annotations

import os
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_staged: dict[str, list[str]] = {}
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cores: int | str = 8, app: str = "tarnish", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def staging_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names, else one below the warehouse.

    Outside local mode it must be a folder that all executors share, so the warehouse has to be named
    or the checkpoint folder set; the executors' own disks are refused.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    folder = configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged"
    if not configured and not spark.sparkContext.master.startswith("local") and folder.startswith(("file:", "/")):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the staging folder and re-read it.

    Cuts the lineage in a way that survives the loss of executors, and gives the optimizer the true
    size, so that it alone decides whether the table is small enough to broadcast. Staged tables live as
    long as their session unless they are freed, see `free` and `clear_staged`. Row ids are hexadecimal, which
    zstd stores in half the space that they take as text.
    """
    spark = df.sparkSession
    path = os.path.join(staging_dir(spark), f"{spark.sparkContext.applicationId}-stage-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def free(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has been staged itself; what `stage` has not written is left alone."""
    for table in tables:
        path = _folders.pop(table, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            _delete(context, path)
            _staged[context.applicationId].remove(path)


def _delete(context, path: str) -> None:
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables that this session has staged; call it before the session ends. Returns their number."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    context = spark.sparkContext
    for path in paths:
        _delete(context, path)
    return len(paths)
