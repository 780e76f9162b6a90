"""Shared plumbing of the training-data operators: tables in the shared folder and column hygiene."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Partitions of a shuffled join's smaller side below this are hashed rather than sorted, as measured when it runs.
_HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
_WRITE = {_CLEANUP: "true", _HASHED: "64MB"}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Tables that lie in the shared folder, in the order they were made.
_made: list[str] = []


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quillon/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all, spark)
    _made.append(path)
    return path


def _remove_all(spark: SparkSession) -> None:
    for path in _made:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the folder's own retention clears the rest
        return


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    Shuffle files of the write are dropped as it ends, so that disk holds one copy of the rows.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    before = {key: spark.conf.get(key, None) for key in _WRITE}
    for key, value in _WRITE.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def materialise_alone(make: Callable[[], DataFrame], spark: SparkSession, tag: str) -> DataFrame:
    """The same of the frame that `make` gives; the tables that were made on the way go once it is written."""
    before = set(_made)
    out = materialise(make(), tag)
    own = _made[-1]
    for path in [p for p in _made if p not in before and p != own]:
        _remove(spark, path)
        _made.remove(path)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch (bytes are bounded by Spark's own setting)."""
    if int(spark.conf.get(_BATCH)) > rows:
        spark.conf.set(_BATCH, str(rows))


def keep_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns an operator reads: extra ones, whatever their names, can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def free_name(used: list[str], name: str) -> str:
    """The name, or with as many "_" added as it takes to be none of those used (in any case of letters)."""
    taken = {c.lower() for c in used}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
