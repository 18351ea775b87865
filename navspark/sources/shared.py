"""Intermediate tables that several parts of one plan read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="navspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _dropped(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def once(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: its readers share one computation, and a lost executor costs a reread.

    Its size is then known to the optimizer, which broadcasts it or not by that.
    The table goes when the driver ends.
    """
    path = f"{_folder(df.sparkSession)}/navspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_dropped, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
