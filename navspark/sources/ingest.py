"""Sources and sinks of the platform's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navspark.operators.universe import first_rows

#: Names that one column may have in a universe file.
ALIASES = {"code": ("code", "ts_code"), "name": ("name", "fund_name"), "management": ("management", "manager"), "found_date": ("found_date", "foundation_date")}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def nav_of(spark: SparkSession, path: str, codes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Net asset values of products by code or name; both lists reach the Parquet scan as filters."""
    rows = spark.read.parquet(path).select("ts_code", "name", "date", "adj_nav")
    return rows.where(F.col("ts_code").isin(*codes) | F.col("name").isin(*names)).dropna(subset=["adj_nav"])


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; those that are missing are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def universe(rows: DataFrame) -> DataFrame:
    """code, name, management, found_date from whichever of their names a table has; rows without code or name go, repeated ones too."""
    def pick(target: str):
        found = [F.col(c) for c in ALIASES[target] if c in rows.columns]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(target)

    return rows.select(*(pick(t) for t in ALIASES)).dropna(subset=["code", "name"]).distinct()


def universe_file(spark: SparkSession, path: str) -> DataFrame:
    """A universe from a JSON array or a Parquet table."""
    return universe(spark.read.json(path, multiLine=True) if path.endswith(".json") else spark.read.parquet(path))


def table_or_seed(spark: SparkSession, paths: Sequence[str], seed: DataFrame) -> DataFrame:
    """The Parquet tables that are there, as one; if none is, the seed rows, which are written to the first path.

    A path that someone else writes meanwhile is left as it is.
    """
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        seed.write.mode("ignore").parquet(paths[0])
        return spark.read.parquet(paths[0])
    out = spark.read.parquet(there[0])
    for p in there[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def save_allocation(classes: DataFrame, nav: DataFrame, folder: str, name: str) -> None:
    """Append an allocation: its nav first, then its list of members, which makes it visible.

    A name that is taken is an error.  Both tables are partitioned by name, so
    saving rewrites nothing and a failed save leaves no visible allocation.
    """
    if name in {r[0] for r in allocations(classes.sparkSession, folder).where(F.col("asset_alloc_name") == name).collect()}:
        raise ValueError(f"allocation {name} exists")
    stamped = lambda df: df.withColumn("asset_alloc_name", F.lit(name)).withColumn("creat_time", F.current_timestamp())
    stamped(nav).write.mode("append").partitionBy("asset_alloc_name").parquet(f"{folder}/asset_nv")
    stamped(classes).write.mode("append").partitionBy("asset_alloc_name").parquet(f"{folder}/asset_alloc_info")


def allocations(spark: SparkSession, folder: str) -> DataFrame:
    """Names of saved allocations, in order; none where nothing was saved."""
    if not _exists(spark, f"{folder}/asset_alloc_info"):
        return spark.createDataFrame([], "asset_alloc_name string")
    return spark.read.parquet(f"{folder}/asset_alloc_info").select("asset_alloc_name").distinct().orderBy("asset_alloc_name")


def nested(classes: DataFrame) -> DataFrame:
    """Flat members (asset_name, etf_code, etf_name, etf_weight, pos) as one row a class, members in their order."""
    member = F.struct("pos", F.col("etf_code").alias("code"), F.col("etf_name").alias("name"), F.col("etf_weight").alias("weight"))
    return classes.groupBy("asset_name").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(member)).alias("etfs"))


def flat(classes: DataFrame) -> DataFrame:
    rows = classes.select("asset_name", F.explode("etfs").alias("e"))
    return rows.select("asset_name", F.col("e.code").alias("etf_code"), F.col("e.name").alias("etf_name"), F.col("e.weight").alias("etf_weight"), "e.pos")


def appended(parts: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Fetched parts as one table with one row of each key, the first by ``order``; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_rows(out, list(keys), order)


def exchange_traded(funds: DataFrame) -> DataFrame:
    """Funds listed in Shanghai or Shenzhen."""
    return funds.where(F.lower("exchange").isin("sh", "sz"))


def export_csv(matrix: DataFrame, path: str) -> None:
    """A metric matrix as CSV with a header, quoted where needed."""
    matrix.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def synthetic_prices(products: DataFrame, start: str, periods: int, floor: float = 0.5) -> DataFrame:
    """(id, date, open, high, low, close, volume) on ``periods`` business days of each product (id, issue_amount).

    Daily moves are normal, from hashes of product and day, so every run gives
    the same prices; closes are a running product and never below the floor.
    """
    from pyspark.sql import Window

    span = F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), int(periods * 1.5) + 10))
    days = F.slice(F.filter(span, lambda d: F.weekday(d) < 5), 1, periods)
    rows = products.select("id", "issue_amount", F.posexplode(days).alias("i", "date"))
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("id", "i", F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))
    order = Window.partitionBy("id").orderBy("i")
    rows = rows.withColumn("step", F.exp(0.0002 + 0.012 * normal))
    base = 1 + F.ln(1 + F.coalesce("issue_amount", F.lit(0.0))) / 10
    close = F.greatest(base * F.product("step").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(floor))
    rows = rows.withColumn("close", close)
    opened = F.coalesce(F.lag("close").over(order), F.col("close"))
    wide = 1 + 0.01 * u(3)
    return rows.withColumn("open", opened).select(
        "id", "date", "open", (F.greatest("open", "close") * wide).alias("high"), F.greatest(F.least("open", "close") / wide, F.lit(0.1)).alias("low"), "close",
        F.round(1e5 * (1 + F.coalesce("issue_amount", F.lit(0.0)) / 100) * (0.5 + u(4))).cast("bigint").alias("volume"),
    )
