"""Not-modified revisit records joined to the full responses that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.shared import staged

#: Headers that a 304 response may update (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: A URL's time line is cut into at most so many pieces.
PIECES = 4096
#: Revisits of one response that are joined in one group.
GROUP = 16_384


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default port, then path and query without tracking parameters, fragment and last slash; a text without a scheme stays but for these."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*", "$1"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/$", ""))


def lower_keys(headers: Column) -> Column:
    """Headers with names in lower case; of equal names the last counts; null gives none."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda name: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def _strong(etag: Column) -> Column:
    """An entity tag without its weakness mark; revalidation compares weakly."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def moment(records: DataFrame, ts_col: str) -> Column:
    """A time column as a whole number that orders it: as it is, or in microseconds."""
    kind = dict(records.dtypes)[ts_col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(ts_col).cast("bigint")
    if kind in ("float", "double") or kind.startswith("decimal"):
        return (F.col(ts_col) * 1_000_000).cast("bigint")
    return F.unix_micros(F.col(ts_col).try_cast("timestamp"))


def resolved(
    records: DataFrame, id_col: str = "record_id", url_col: str = "url", ts_col: str = "ts", kind_col: str = "kind", headers_col: str = "headers", payload_col: str = "payload",
) -> DataFrame:
    """One row per revisit: record_id, canonical, ts, response_id, outcome, headers, payload.

    A revisit stands for the latest full response of its canonical URL that was
    captured before it; of responses at one time the one of greatest record_id
    counts.  ``kind`` is "response" or "revisit", other records are ignored.
    ``outcome``: "resolved" if entity tags, or else modification dates, are
    equal; "unverified" if no such pair is there; "changed" if they differ;
    "missing" without an earlier response, or without URL or time.  Resolved and
    unverified revisits have the response's payload and its headers, with those
    of the revisit that a 304 may update; the others have their own headers and
    no payload.  ``ts`` is a number of any unit, a timestamp, a date, or a text
    that casts to a timestamp, as WARC dates do; other texts are no time.
    Payloads of any length are moved whole.  Repeated revisits are resolved
    alike; ids and payloads may be null; an empty table gives an empty result.
    Other columns are ignored.

    A URL's time line is cut into pieces of time, so a URL that holds a third
    of all rows is many groups: the last response of each earlier piece is
    carried over by a second window over at most ``PIECES`` rows a URL.  A
    response that many revisits stand for is copied to groups of about GROUP of
    them before its payload is joined.
    """
    rows = records.select(
        F.col(id_col).alias("record_id"), canonical_url(F.col(url_col)).alias("canonical"), F.col(ts_col).alias("ts"), moment(records, ts_col).alias("tick"), F.col(kind_col).alias("kind"),
        lower_keys(F.col(headers_col)).alias("headers"), F.col(payload_col).alias("payload"),
    )
    low, high = rows.agg(F.min("tick"), F.max("tick")).first()
    width = max(1, ((high - low) // PIECES + 1) if low is not None else 1)
    piece = F.expr(f"(tick - {low or 0}L) div {width}L").cast("int")
    timed = rows.where("canonical is not null and tick is not null").withColumn("piece", piece)

    moments = timed.where("kind in ('response', 'revisit')").select("canonical", "piece", "tick", F.when(F.col("kind") == "response", F.col("tick")).alias("at"), (F.col("kind") == "revisit").alias("asked"))
    moments = moments.groupBy("canonical", "piece", "tick").agg(F.max("at").alias("at"), F.max("asked").alias("asked"))
    before = Window.partitionBy("canonical", "piece").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    inside = moments.withColumn("found", F.last("at", ignorenulls=True).over(before))
    earlier = Window.partitionBy("canonical").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = moments.groupBy("canonical", "piece").agg(F.max("at").alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    matched = inside.where("asked").join(carried, ["canonical", "piece"]).select("canonical", "tick", F.coalesce("found", "carried").alias("at"))
    matched = staged(matched, "moments")

    # Numbered as they are read, so that repeated rows are dealt apart too.
    revisits = rows.where("kind = 'revisit'").withColumnRenamed("headers", "own").drop("kind", "payload").withColumn("nth", F.monotonically_increasing_id())
    revisits = revisits.join(matched, ["canonical", "tick"], "left")
    # One row per response with more revisits than GROUP; being a written table, it is broadcast only if its files are small.
    busy = revisits.where("at is not null").groupBy("canonical", "at").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    busy = staged(busy.where("groups > 1"), "busy")
    groups = F.coalesce("groups", F.lit(1))
    dealt = revisits.join(busy, ["canonical", "at"], "left").withColumn("group", F.pmod(F.xxhash64("nth"), groups).cast("int"))
    responses = timed.where("kind = 'response'").withColumnRenamed("tick", "at").join(busy, ["canonical", "at"], "left")
    copied = responses.withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1)))
    answer = F.struct(F.col("record_id").alias("response_id"), "headers", "payload")
    best = copied.groupBy("canonical", "at", "group").agg(F.max_by(answer, F.coalesce(F.col("record_id"), F.lit(-1))).alias("answer"))
    joined = dealt.join(best, ["canonical", "at", "group"], "left")
    stored = F.col("answer.headers")
    tag, other = _strong(F.col("own")["etag"]), _strong(stored["etag"])
    date, since = F.trim(F.col("own")["last-modified"]), F.trim(stored["last-modified"])
    outcome = (
        F.when(F.col("at").isNull(), "missing")
        .when(tag.isNotNull() & other.isNotNull(), F.when(tag == other, "resolved").otherwise("changed"))
        .when(date.isNotNull() & since.isNotNull(), F.when(date == since, "resolved").otherwise("changed"))
        .otherwise("unverified")
    )
    joined = joined.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unverified")
    update = F.map_filter("own", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(update, k))
    return joined.select(
        "record_id", "canonical", "ts",
        F.when(good, F.col("answer.response_id")).alias("response_id"), "outcome",
        F.when(good, F.map_concat(kept, update)).otherwise(F.col("own")).alias("headers"),
        F.when(good, F.col("answer.payload")).alias("payload"),
    )
