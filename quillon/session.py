"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Fixed semantics: UTC clock, ANSI arithmetic, adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cpus: int | None = None, app: str = "quillon", **extra: str) -> SparkSession:
    """A local session; on a cluster the session is made by spark-submit and only SETTINGS matter."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 2))
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g"} | extra
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "quillon-shared")
    os.makedirs(path, exist_ok=True)
    return path
