"""Importance resampling of documents towards a target text distribution.

Words and pairs of words are hashed into buckets; a bucket's gain is the log
ratio of its share in the target and in the corpus.  A document's bucket array,
its sum of gains and its draw are expressions over its own row: no feature
becomes a row of its own but in the count of buckets, which is combined within
each task, so the totals of the buckets are all that is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.shared import staged

BUCKETS = 10_000
SMOOTH = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7

# What a word is, before and after A to Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A to Z lower-cased; none of a null text."""

    def lowered(w: Column) -> Column:
        # lower() is right, and much faster, where a word has nothing beyond ASCII.
        return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lowered)


def buckets(found: Column, n: int = BUCKETS) -> Column:
    """The buckets of an array of words: of each word, then of each two that follow one another."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % n).cast("smallint" if n <= 1 << 15 else "int")

    last = F.greatest(F.size(found) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(found, 1, last), F.slice(found, 2, last), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(found, bucket), pairs)


def totals(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often each bucket occurs; a row per bucket that does."""
    found = texts.select(words(F.col(text_col)).alias("words")).select(F.explode(buckets(F.col("words"))).alias("bucket"))
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n: int = BUCKETS) -> list[int]:
    """The gain of each bucket from two tables of ``totals``; buckets are all that reaches the driver.

    Sums are taken as doubles: floor(1000 ln((t + 1)(S + SMOOTH) / ((s + 1)(T + SMOOTH)))).
    """
    every = corpus.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    s = corpus.select(F.col("bucket").cast("int").alias("bucket"), F.col("n").alias("s"))
    t = target.select(F.col("bucket").cast("int").alias("bucket"), F.col("n").alias("t"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    whole = Window.partitionBy()  # a row per bucket, never more
    big_s, big_t = F.sum("s").over(whole), F.sum("t").over(whole)
    ratio = (F.col("t") + 1) * (big_s + SMOOTH) / ((F.col("s") + 1) * (big_t + SMOOTH))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows, key=lambda r: r.bucket)]


def _gain_array(values: list[int]) -> Column:
    """The gains as an array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scored(docs: DataFrame, values: list[int], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each document, from its own row alone."""
    table = _gain_array(values)
    found = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    found = found.select("doc_id", F.size("words").cast("bigint").alias("n_words"), buckets(F.col("words"), len(values)).alias("buckets"))
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.element_at(table, b.cast("int") + 1))
    found = found.select("doc_id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), total.alias("total"))
    n = F.greatest("n_features", F.lit(1))
    weight = ((F.col("total") - F.pmod("total", n)) / n).cast("bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return found.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def ranked(found: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` rows with "rank": 1, 2, 3... of the drawn by falling score, ties to the smaller id, null ids last; null for the others.

    Rows with ``min_words`` words come first in one order over all rows, sorted
    by ranges, so that a rank is the number in the range and the sizes of the
    ranges before: no task sees more than its range, and the driver nothing.
    """
    fits = F.col("n_words") >= min_words
    # A number of its own lets rows that are alike in all else, or have no id, be dealt to several ranges.
    rows = staged(found.withColumn("fits", fits).withColumn("row", F.monotonically_increasing_id()), "scored")
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    at = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = staged(ranges.withColumn("range", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"), F.count_if("fits").alias("fit"))
    # A row per range is all that meets here, and all that is broadcast.
    begins = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("begin"), F.floor(F.lit(percent) * F.sum("fit").over(Window.partitionBy()) / 100).alias("drawn"))
    rank = F.col("begin") + F.col("place") + 1
    out = ranges.join(F.broadcast(begins), "range")
    return out.select(*[c for c in found.columns if c != "n_words"], F.when(F.col("fits") & (rank <= F.col("drawn")), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; the drawn ones have a rank.

    Features are counted over all of ``docs`` and of ``target``.  Null and empty
    texts have no features and weight 0; repeated rows are ranked each on their
    own, those alike in an arbitrary order; a null id draws as the empty text
    and comes last among ties.  Long texts are scored whole, within their row.
    An empty target leaves gains by rarity in the corpus alone; an empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    values = gains(totals(docs, text_col), totals(target, text_col))
    return ranked(scored(docs, values, id_col, text_col, seed), percent, min_words)
