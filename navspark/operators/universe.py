"""Queries of the product universe: search, facets, distributions, top lists, paging, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.functions.clean import INACTIVE, facet, strip_suffix
from navspark.sources.shared import once

# The columns that are searched, that pages sort by, and that searches sort by; the first of each is the default.
SEARCHED = ("ts_code", "code", "name", "management")
SORTABLE = ("issue_amount", "m_fee", "c_fee", "exp_return", "duration_year", "list_date", "found_date", "issue_date", "name")
SEARCH_SORTS = ("name", "code", "management", "found_date")


def terms(values: str | Sequence[str] | None) -> list[str]:
    """A multi-valued parameter: repeated or comma-separated, trimmed, without blanks."""
    given = [values] if isinstance(values, str) else list(values or ())
    return [t.strip() for v in given for t in v.split(",") if t.strip()]


def present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*(c for c in wanted if c in df.columns))


def search(products: DataFrame, keyword: str | None) -> DataFrame:
    """Products with the keyword, as it stands, in any searched column."""
    word = (keyword or "").strip().lower()
    if not word:
        return products
    hits = [F.contains(F.lower(c), F.lit(word)) for c in SEARCHED if c in products.columns]
    return products.where(_any(hits))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def options(products: DataFrame, column: str, text: str | None = None) -> DataFrame:
    """(label): a facet's values that hold the text, in any case; all of them without one."""
    labels = products.select(F.col(column).alias("label")).where("label is not null").distinct()
    wanted = (text or "").strip().lower()
    return labels.where(F.contains(F.lower("label"), F.lit(wanted))) if wanted else labels


def search_joined(products: DataFrame, keyword: str) -> DataFrame:
    """Products with the keyword in ``code name management`` written together."""
    text = F.lower(F.concat_ws(" ", "code", "name", F.coalesce("management", F.lit(""))))
    return products.where(F.contains(text, F.lit(keyword.strip().lower())))


def with_facets(products: DataFrame, chosen: dict[str, Sequence[str]]) -> DataFrame:
    """Products whose facets are among the chosen values, in any case; a facet without values does not filter."""
    for column, values in chosen.items():
        if values and column in products.columns:
            products = products.where(F.lower(facet(F.col(column))).isin(*(v.lower() for v in values)))
    return products


def with_facet_exact(products: DataFrame, dimension: str, values: Sequence[str]) -> DataFrame:
    """As ``with_facets`` but in the given case; no values give no rows, an unknown dimension all."""
    if dimension not in products.columns:
        return products
    return products.where(facet(F.col(dimension)).isin(*values)) if values else products.limit(0)


def is_active(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).rlike(INACTIVE)


def is_recent(date: Column, as_of: Column) -> Column:
    """Listed in the twelve months before ``as_of``, or after it."""
    return F.coalesce(date >= F.add_months(as_of, -12), F.lit(False))


def summary(products: DataFrame, as_of: Column) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return products.agg(
        F.count("*").alias("total"), count(is_active(F.col("status"))).alias("active"), F.countDistinct("management").alias("managers"),
        F.round(F.coalesce(F.sum("issue_amount"), F.lit(0.0)), 4).alias("total_issue"), F.round(F.avg("m_fee"), 6).alias("avg_m_fee"), F.round(F.avg("c_fee"), 6).alias("avg_c_fee"),
        F.round(F.avg("exp_return"), 6).alias("avg_exp_return"), F.round(F.avg("duration_year"), 6).alias("avg_duration"), F.round(F.median("issue_amount"), 6).alias("median_issue"),
        count(is_recent(F.col("list_date"), as_of)).alias("listed_last_year"),
    )


def distribution(products: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(name, value): rows by facet value, most first; ties by first appearance."""
    found = products.groupBy(facet(F.col(column)).alias("name")).agg(F.count("*").alias("value"), F.min("pos").alias("first_pos"))
    ordered = found.orderBy(F.desc("value"), "first_pos")
    return ordered.limit(top) if top else ordered


def grouped(products: DataFrame, column: str, order: Sequence[str], top: int | None = None) -> DataFrame:
    """Products and issued amount by a facet, ordered by the given figures, greatest first."""
    found = products.groupBy(facet(F.col(column)).alias("name")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("issue_amount"), F.lit(0.0)), 4).alias("issue"))
    ordered = found.orderBy(*(F.desc(c) for c in order), "name")
    return ordered.limit(top) if top else ordered


def fees(products: DataFrame, column: str) -> DataFrame:
    found = products.groupBy(facet(F.col(column)).alias("name")).agg(F.round(F.avg("m_fee"), 6).alias("m_fee"), F.round(F.avg("c_fee"), 6).alias("c_fee"))
    return found.orderBy(F.desc("m_fee"), "name")


def listings(products: DataFrame) -> DataFrame:
    """Products and issued amount by year of listing."""
    return products.where("list_date is not null").groupBy(F.year("list_date").alias("year")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("issue_amount"), F.lit(0.0)), 4).alias("issue"))


def page(products: DataFrame, sort_by: str = "issue_amount", descending: bool = True, number: int = 1, size: int = 20) -> DataFrame:
    """One page in the order of a sortable column, nulls last, ties in table order; Spark keeps only the rows up to its end.

    An unknown column sorts like the default; one that the table lacks leaves table order.
    """
    name = sort_by if sort_by in SORTABLE else SORTABLE[0]
    order = [F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()] if name in products.columns else []
    return products.orderBy(*order, "pos").offset((max(1, number) - 1) * size).limit(size)


def search_page(products: DataFrame, keyword: str | None, sort_by: str = "name", descending: bool = False, top: int | None = None, number: int = 1, size: int = 10) -> DataFrame:
    """One page of a search in ``code name management``, with the column total.

    Sorted as text, a missing value being the empty text; an unknown column
    sorts by name, and ties keep table order either way.  ``total`` counts all
    that the search finds; of these the ``top`` first, if given, are paged.  A
    page beyond the end is one row with nothing but the total.
    """
    found = search_joined(products, keyword or "")
    name = sort_by if sort_by in SEARCH_SORTS else SEARCH_SORTS[0]
    key = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in products.columns else F.lit("")
    ordered = found.orderBy(key.desc() if descending else key.asc(), "pos")
    first, last = (max(1, number) - 1) * size, max(1, number) * size
    if top is not None and top > 0:
        last = min(last, top)
    paged = ordered.offset(first).limit(max(0, last - first))
    total = found.agg(F.count("*").alias("total"))  # one row, beside a page at most
    return total.join(F.broadcast(paged), F.lit(True), "left").select(*products.columns, "total")


def fuzzy_top(products: DataFrame, text: str, k: int = 10) -> DataFrame:
    """The k products with the text earliest in ``code name``."""
    word = text.strip().lower()
    if not word:
        return products.orderBy("pos").limit(k).withColumn("score", F.lit(0.0))
    at = F.locate(word, F.lower(F.concat_ws(" ", "code", "name")))
    return products.where(at > 0).withColumn("score", (at - 1) + len(word) * 0.2).orderBy("score", "pos").limit(k)


#: Longest strings of characters that codes are indexed by.
GRAM = 6


def _grams(text: Column, size: Column) -> Column:
    """The distinct strings of ``size`` characters in a text; none if it is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def _first_by(products: DataFrame, key: Column) -> DataFrame:
    """(k, first): of each value of ``key`` the first product, (pos, ts_code, name)."""
    return products.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min(F.struct("pos", "ts_code", "name")).alias("first"))


def resolve(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Requested (req_code, req_name) with the product they mean.

    An exact code comes first, then a code without suffix, an exact name, and
    last a code that holds the requested one without its suffix; each time the
    first in table order.  All are equality joins with one product a key, so a
    name that many products have is met once by a request.  Only what a step
    leaves open goes to the next.
    """
    p = once(products.select("pos", "ts_code", "name"))
    asked = requests.select("req_code", "req_name").distinct().withColumn("bare", strip_suffix(F.col("req_code")))
    hit = lambda of, rank: F.when(F.col(of).isNotNull(), F.struct(F.lit(rank).alias("match_rank"), f"{of}.pos", f"{of}.ts_code", f"{of}.name"))

    def step(rows: DataFrame, wanted: str, key: Column, rank: int) -> DataFrame:
        joined = rows.join(_first_by(p, key), F.col(wanted) == F.col("k"), "left").withColumn("found", hit("first", rank))
        return joined.withColumn("m", F.coalesce("m", "found") if "m" in rows.columns else F.col("found")).drop("k", "first", "found")

    coded = once(step(step(asked, "req_code", F.col("ts_code"), 0), "bare", strip_suffix(F.col("ts_code")), 1))
    named = once(step(coded.where("m is null"), "req_name", F.col("name"), 2))
    open_ = named.where("m is null").drop("m")
    held = holding(open_.where("bare <> ''").select(F.col("bare").alias("part")).distinct(), p)
    last = open_.join(held, F.col("bare") == F.col("part"), "left").withColumn("m", hit("held", 3)).select(coded.columns)
    found = coded.where("m is not null").unionByName(named.where("m is not null")).unionByName(last)
    return found.select("req_code", "req_name", "m.match_rank", F.col("m.ts_code").alias("ts_code"), F.col("m.name").alias("name"))


def holding(parts: DataFrame, products: DataFrame) -> DataFrame:
    """(part, held): for each distinct text the first product whose code holds it, (pos, ts_code, name); none if there is none.

    Codes are indexed by the strings that are asked for: parts of GRAM
    characters at most, and the strings of GRAM characters of longer ones.  For
    a short part the index's first product is the answer.  A longer part is met
    with the codes that hold the rarest of its strings, and compared with those
    only.
    """
    parts = once(parts.select("part", F.least(F.length("part"), F.lit(GRAM)).alias("size")).where("size > 0"))
    # One row, with GRAM numbers at most.
    sizes = parts.agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    product = F.struct("pos", "ts_code", "name")
    long = parts.where(F.length("part") > GRAM).select("part", F.explode(_grams(F.col("part"), F.lit(GRAM))).alias("gram"))
    wanted = once(parts.where(F.length("part") <= GRAM).select(F.col("part").alias("gram")).unionByName(long.select("gram")).distinct())
    # The table is small beside its strings, so they are cut by all cores.
    spread = products.where("ts_code is not null").repartition(products.sparkSession.sparkContext.defaultParallelism)
    sized = spread.crossJoin(F.broadcast(sizes)).withColumn("size", F.explode("sizes")).where(F.length("ts_code") >= F.col("size"))
    starts = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("ts_code") - F.col("size") + 1)))
    strings = starts.select(F.substring("ts_code", F.col("at"), F.col("size")).alias("gram"), "pos", "ts_code", "name")
    indexed = strings.join(wanted, "gram", "left_semi").select("gram", product.alias("held"))
    index = once(indexed.groupBy("gram").agg(F.min("held").alias("held"), F.count("*").alias("n")))
    short = parts.where(F.length("part") <= GRAM).join(index, F.col("part") == F.col("gram")).select("part", "held")
    if long.isEmpty():
        return short
    # A string that no code has ends the search: it is the rarest, and meets nothing.
    rarest = long.join(index, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = rarest.join(indexed.where(F.length("gram") == GRAM), "gram").where(F.contains("held.ts_code", F.col("part")))
    return short.unionByName(near.groupBy("part").agg(F.min("held").alias("held")))


def lookup(products: DataFrame, identifier: str) -> DataFrame:
    """The product an identifier means: by ts_code, then code (each exact, without suffix, part), then name (exact, part)."""
    word = identifier.strip().lower()
    bare = word.split(".")[0]
    cascade: list[Column] = []
    for c in ("ts_code", "code"):
        text = F.lower(c)
        cascade.append(text == word)
        if bare and bare != word:
            cascade.append(F.substring_index(text, ".", 1) == bare)
        cascade.append(F.contains(text, F.lit(word)))
    cascade += [F.lower("name") == word, F.contains(F.lower("name"), F.lit(word))]
    rank = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(cascade)))
    return products.withColumn("match_rank", rank).where("match_rank is not null").orderBy("match_rank", "pos").limit(1)


def first_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row of each key, the first by ``order``; partial minima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return found.select(*keys, "r.*").select(df.columns)


def rank_within(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The n first rows of each group; Spark prunes by group before the shuffle."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
