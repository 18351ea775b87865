"""Tables written once to the folder that every executor sees."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    ``spark.checkpoint.dir`` names it.  Only a local master, as in tests, may do
    without: it then gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="navspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


class Scratch:
    """Staged tables of one computation, removed when it ends; only what its result still reads should be staged outside."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        self.paths.append((df.sparkSession, path))
        return out

    def clear(self, but: int = 0) -> None:
        """Remove the tables, but for the last ``but``."""
        cut = len(self.paths) - but
        for spark, path in self.paths[:cut]:
            _remove(spark, path)
        del self.paths[:cut]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and rows that came from a shuffle keep the same contents in every later job.
    """
    out, path = _written(df, name)
    atexit.register(_remove, df.sparkSession, path)
    return out


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/navspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
