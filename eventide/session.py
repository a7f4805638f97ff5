"""Session settings the library expects, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "eventide", **extra: str) -> SparkSession:
    """A session with ``SETTINGS`` and ``extra``. On a cluster ``spark.checkpoint.dir`` must name a shared folder; in local mode one is made."""
    if _one_machine(master) and "spark.checkpoint.dir" not in extra:
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="eventide-")
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()


def _one_machine(master: str | None) -> bool:
    return bool(master) and (master == "local" or master.startswith("local["))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, local mode (one process) makes a folder of its own; on a cluster that is an error,
    since no folder of one machine would be seen by the others.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not _one_machine(context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="eventide-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once into the shared folder and read back, for results that several readers share. Deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
