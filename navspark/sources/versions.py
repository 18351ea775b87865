"""Tables kept between runs: cleaned scans by file version, and solved weights by request and date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.functions.clean import spec_key
from navspark.operators.weights import Strategy, schedule


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _files(df: DataFrame) -> DataFrame:
    """(file, version) of a scan's files: the modification times that the scan itself reports."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS").alias("version"))


def cleaned_scan(spark: SparkSession, path: str, clean: Callable[[DataFrame], DataFrame], store: str) -> DataFrame:
    """``clean`` of the Parquet files under ``path``, kept in ``store`` by file and version.

    Files whose version the store has are not read again; a changed or new one
    is read, cleaned and added, and rows of versions that are no longer there
    are left out.  ``clean`` works row by row and keeps its input's other
    columns as it likes.  Versions are compared as tables; the list of changed
    files is the scan's partition filter.
    """
    scan = spark.read.parquet(path)
    now = _files(scan).distinct()
    known = spark.read.parquet(f"{store}/seen") if _there(spark, f"{store}/seen") else spark.createDataFrame([], "file string, version string")
    # As many rows as files changed; their names are what the next scan lists.
    changed = now.join(known, ["file", "version"], "left_anti").collect()
    if changed:
        fresh = spark.read.schema(scan.schema).parquet(*(r.file for r in changed))
        rows = fresh.withColumns({"_file": F.col("_metadata.file_path"), "_version": F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS")})
        tags = ["_file", "_version"]
        kept = clean(rows)
        kept.select(*[c for c in kept.columns if c not in tags], *tags).write.mode("append").parquet(f"{store}/rows")
        # Rows first: a run that stops in between reads its files again, and the version filter below keeps one copy of each.
        spark.createDataFrame([(r.file, r.version) for r in changed], "file string, version string").write.mode("append").parquet(f"{store}/seen")
    every = spark.read.parquet(f"{store}/rows")
    current = now.toDF("_file", "_version")
    return every.join(current, ["_file", "_version"], "left_semi").drop("_file", "_version")


def stored_schedule(panel: DataFrame, strategies: Sequence[Strategy], dates: DataFrame, store: str, at: int, most: int = 64, data: str = "") -> DataFrame:
    """``weights.schedule`` that solves only what ``store`` lacks.

    A request is a strategy's model, without its name, and ``data``, which names
    the panel's contents, such as an allocation and its last change; its key is
    the hash of both.  Solved weights are a table by key and date; wanted
    dates that it has are read, the others are solved and added.  ``at`` is a
    counter or time that rises from run to run: beyond ``most`` requests those
    of the least last use are dropped.
    """
    spark = panel.sparkSession
    keys = {s.name: spec_key({**{k: v for k, v in vars(s).items() if k != "name"}, "data": data, "assets": None}) for s in strategies}
    named = spark.createDataFrame(list(keys.items()), "strategy string, key string")
    wanted = dates.join(F.broadcast(named), "strategy").select("strategy", "key", "date")
    solved = f"{store}/solved"
    have = spark.read.parquet(solved) if _there(spark, solved) else spark.createDataFrame([], "date date, asset string, weight double, key string")
    missing = wanted.join(have.select("key", "date").distinct(), ["key", "date"], "left_anti")
    # Requests that share a key are solved once, under the least of their names.
    missing = missing.groupBy("key", "date").agg(F.min("strategy").alias("strategy"))
    found = schedule(panel, list(strategies), missing.select("strategy", "date")).join(F.broadcast(named), "strategy").select("date", "asset", "weight", "key")
    if not missing.isEmpty():
        found.write.mode("append").partitionBy("key").parquet(solved)
    spark.createDataFrame([(k, at) for k in sorted(set(keys.values()))], "key string, at bigint").coalesce(1).write.mode("append").parquet(f"{store}/used")
    _evict(spark, store, most)
    every = spark.read.parquet(solved)
    return wanted.join(every, ["key", "date"]).select("strategy", "date", "asset", "weight")


def _evict(spark: SparkSession, store: str, most: int) -> None:
    """Drop the requests of least last use; there are ``most`` and one run's at most."""
    used = spark.read.parquet(f"{store}/used").groupBy("key").agg(F.max("at").alias("at"))
    for r in used.orderBy(F.desc("at"), "key").offset(most).collect():
        _drop(spark, f"{store}/solved/key={r.key}")
