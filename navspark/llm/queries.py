"""The corpus operators on their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm import bpe, decontaminate, html, labelled_pages, near, pieces, prints, quality, quotes, resample, substring, urls, variants, warc
from navspark.llm.oracles import OP12_SQL, OP13_SQL
from navspark.llm.shared import staged

#: The SentencePiece model of op5 and of the pipeline; NAVSPARK_PIECES overrides it.
PIECES = os.environ.get("NAVSPARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

#: The word tokenizer of op11; NAVSPARK_WORD_BPE overrides it.
WORD_BPE = os.environ.get("NAVSPARK_WORD_BPE", "/opt/tokenizers/word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_read(spark, sf_dir, "pages"), labelled_pages.train(), ["page_id", "url"])


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of the pages: each page's response, and a later revisit of its URL.

    The revisit's URL differs in case and fragment; a fifth of the revisits
    have an entity tag that the response never had, another fifth have none.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 8), F.lit('"'))
    n = F.col("page_id")
    response = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), n.cast("string"))
    own = F.when(n % 5 == 0, F.lit('"other"')).when(n % 5 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), tag))
    revisit = F.create_map(F.lit("Date"), (n + 2000).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("etag"), own)
    url = F.col("url")
    first = pages.select((2 * n).alias("record_id"), url, n.alias("ts"), F.lit("response").alias("kind"), response.alias("headers"), F.col("html").alias("payload"))
    again = F.concat(F.regexp_replace(F.regexp_replace(url, "^https://", "HTTPS://"), "#.*$", ""), F.lit("#again"))
    second = pages.select((2 * n + 1).alias("record_id"), again.alias("url"), (n + 2000).alias("ts"), F.lit("revisit").alias("kind"), revisit.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return first.unionByName(second)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolved(captures(_read(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "canonical", "ts", "response_id", "outcome",
        F.col("headers")["content-type"].alias("content_type"), F.col("headers")["etag"].alias("etag"), F.col("headers")["date"].alias("date"), F.col("headers")["content-length"].alias("content_length"),
        F.md5("payload").alias("payload_md5"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_windows(_read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(_read(spark, sf_dir, "documents").select("doc_id", "text"), pieces.model_bytes(PIECES))
    return found.select(
        "doc_id", F.size("piece ids").cast("bigint").alias("n_pieces"), F.md5(F.array_join(F.col("piece ids").cast("array<string>"), " ")).alias("ids_md5"),
        (F.col("piece text") == F.col("text")).alias("round_trip"), F.col("piece parity").alias("parity"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.scored(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    score = F.col("quality score")
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.representatives(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_docs", "class_texts", "is_kept", F.round("similarity", 9).alias("similarity"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_read(spark, sf_dir, "pages"), urls.train(), ["page_id"])


def mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: over each message the turn before it, quoted once, and the one before that, quoted twice.

    Rows that share (conv_id, turn) are quoted by the least of their texts; a null text quotes nothing.
    """
    said = conversations.where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    out = conversations.select("conv_id", "turn", "role", "text")
    for back in (2, 1):
        mark = ">" * back + " "
        quoted = F.concat(F.lit(mark), F.regexp_replace("said", r"\r?\n", "\n" + mark))
        out = out.join(said.select("conv_id", (F.col("turn") + back).alias("turn"), quoted.alias(f"quoted {back}")), ["conv_id", "turn"], "left")
    text = F.when(F.col("text").isNotNull(), F.concat_ws("\n", "quoted 2", "quoted 1", "text"))
    return out.select("conv_id", "turn", "role", text.alias("text"))


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.linked(staged(mail(_read(spark, sf_dir, "conversations")), "mail"))
    return found.withColumn("text_md5", F.md5("text")).drop("text")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.fingerprints(_read(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A null text is encoded as the empty one.
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = bpe.encoded(docs, bpe.model_bytes(WORD_BPE))
    ids = F.array_join(F.col("bpe ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("bpe ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bpe text", 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_read(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = [
    op1_html_extract, op2_warc_revisits, op3_decontaminate, op4_substring_dedup, op5_sentencepiece, op6_quality, op7_minhash_dedup, op8_url_filter,
    op9_quote_links, op10_fingerprints, op11_bpe, op12_spelling_variants, op13_resample, pipeline,
]

_CANONICAL = r"""regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[.]', '') AS h0,
  regexp_replace(regexp_replace(regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '[?&]+$', '') AS rest"""

OP2_SQL = rf"""WITH p AS (SELECT page_id AS n, url, html, '"' || substring(md5(coalesce(html, '')), 1, 8) || '"' AS tag FROM pages),
b AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM p),
c AS (SELECT *, {_CANONICAL} FROM b),
u AS (SELECT n, html, tag, regexp_replace(h0, ':(80|443)$', '') || regexp_replace(rest, '/$', '') AS canonical FROM c),
a AS (SELECT canonical, n AS at, max(n) AS top FROM u GROUP BY canonical, n),
r AS (SELECT n, canonical, n + 2000 AS ts, CASE WHEN n % 5 = 0 THEN '"other"' WHEN n % 5 = 1 THEN NULL ELSE 'W/' || tag END AS etag FROM u),
j AS (SELECT r.*, a.top FROM r ASOF LEFT JOIN a ON r.canonical = a.canonical AND r.ts > a.at),
k AS (SELECT j.*, u.n AS found, u.tag AS stored, u.html, CASE WHEN u.n IS NULL THEN 'missing' WHEN j.etag IS NULL THEN 'unverified'
  WHEN regexp_replace(j.etag, '^W/', '') = u.tag THEN 'resolved' ELSE 'changed' END AS outcome FROM j LEFT JOIN u ON j.top = u.n)
SELECT 2 * n + 1 AS record_id, canonical, ts, CASE WHEN outcome IN ('resolved', 'unverified') THEN 2 * found END AS response_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN 'text/html' END AS content_type, etag, CAST(ts AS VARCHAR) AS date,
  CASE WHEN outcome NOT IN ('resolved', 'unverified') THEN '0' END AS content_length, CASE WHEN outcome IN ('resolved', 'unverified') THEN md5(html) END AS payload_md5 FROM k"""

OP4_SQL = r"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT r, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
g AS (SELECT s.r, s.i, sha256(array_to_string(w.words[s.i:s.i + 34], ' ')) AS h FROM s JOIN w ON s.r = w.r),
b AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM b),
d AS (SELECT r, list(k) AS gone FROM c GROUP BY r)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(len(d.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN d.gone IS NULL THEN w.words ELSE list_transform(list_filter(list_zip(w.words, range(1, len(w.words) + 1)), lambda z: NOT list_contains(d.gone, z[2])), lambda z: z[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN d ON w.r = d.r"""

_UNIT = r"trim(regexp_replace(lower({}), '[ \t\r\n\f\x0B]+', ' ', 'g'))"
OP9_SQL = rf"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations),
s AS (SELECT r, conv_id, turn, string_split_regex(text, '\r?\n') AS ls FROM m WHERE text IS NOT NULL),
l AS (SELECT r, conv_id, turn, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM s),
v AS (SELECT * FROM (SELECT r, conv_id, turn, pos, line, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^(?:[ \t]*>)+', '') AS body FROM l) WHERE NOT regexp_matches(body, '{quotes.ATTRIBUTION}')),
own AS (SELECT r, regexp_replace(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g') AS cut FROM v GROUP BY r),
clean AS (SELECT m.*, CASE WHEN regexp_matches(m.text, '(?m)^(?:[ \t]*>)+') THEN coalesce(own.cut, '') ELSE m.text END AS said FROM m LEFT JOIN own ON m.r = own.r),
i AS (SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY pos) AS before FROM v)),
q AS (SELECT r, conv_id, turn, run, level, min(pos) AS pos, list(body ORDER BY pos) AS bodies FROM i WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
qu AS (SELECT r, conv_id, turn, run, level, pos, 0 AS rank, array_to_string(bodies, chr(10)) AS t FROM q
  UNION ALL SELECT r, conv_id, turn, run, level, pos, 1, unnest(string_split_regex(array_to_string(bodies, chr(10)), '\n[ \t]*\n')) FROM q
  UNION ALL SELECT r, conv_id, turn, run, level, pos, 2, unnest(bodies) FROM q),
qn AS (SELECT * FROM (SELECT r, conv_id, turn, run, level, pos, rank, {_UNIT.format("t")} AS t FROM qu) WHERE t <> ''),
ou AS (SELECT conv_id, turn, said AS t FROM clean UNION ALL SELECT conv_id, turn, unnest(string_split_regex(said, '\n[ \t]*\n')) FROM clean
  UNION ALL SELECT conv_id, turn, unnest(string_split_regex(said, '\r?\n')) FROM clean),
sought AS (SELECT DISTINCT t FROM qn),
o AS (SELECT u.conv_id, u.turn, u.t FROM (SELECT conv_id, turn, {_UNIT.format("t")} AS t FROM ou WHERE conv_id IS NOT NULL AND turn IS NOT NULL) u SEMI JOIN sought ON u.t = sought.t),
here AS (SELECT t, conv_id, min(turn) AS turn FROM o GROUP BY ALL),
first AS (SELECT t, min(row(conv_id, turn)) AS f FROM o GROUP BY t),
p AS (SELECT qn.r, qn.run, qn.level, qn.pos, qn.rank, length(qn.t) AS size,
  CASE WHEN here.turn < qn.turn THEN row(qn.conv_id, here.turn) WHEN first.f < row(qn.conv_id, qn.turn) THEN first.f END AS origin
  FROM qn LEFT JOIN here ON qn.t = here.t AND qn.conv_id = here.conv_id LEFT JOIN first ON qn.t = first.t),
b AS (SELECT r, run, level, pos, min(row(rank, -size, origin[1], origin[2])) AS best FROM p WHERE origin IS NOT NULL GROUP BY ALL),
par AS (SELECT r, count(*) AS n_linked, min(row(level, pos, best[3], best[4])) AS up FROM b GROUP BY r),
num AS (SELECT r, count(*) AS n_quotes FROM q GROUP BY r),
step AS (SELECT m.conv_id, m.turn, min(row(par.up[3], par.up[4])) AS up FROM par JOIN m ON par.r = m.r GROUP BY ALL),
walk AS (SELECT conv_id, turn, up, 1 AS depth FROM step UNION ALL SELECT walk.conv_id, walk.turn, step.up, walk.depth + 1 FROM walk JOIN step ON row(step.conv_id, step.turn) = walk.up),
root AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(up, depth) AS up FROM walk GROUP BY ALL),
done AS (SELECT c.conv_id, c.turn, c.role, CAST(coalesce(num.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(par.n_linked, 0) AS BIGINT) AS n_linked,
  par.up[3] AS parent_conv, par.up[4] AS parent_turn, coalesce(root.up[1], c.conv_id) AS thread_conv, coalesce(root.up[2], c.turn) AS thread_turn,
  CAST(coalesce(root.depth, 0) AS BIGINT) AS depth, c.said
FROM clean c LEFT JOIN num ON c.r = num.r LEFT JOIN par ON c.r = par.r LEFT JOIN root ON c.conv_id = root.conv_id AND c.turn = root.turn)
SELECT * EXCLUDE (said), md5(said) AS text_md5, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 0
  ELSE row_number() OVER (PARTITION BY thread_conv, thread_turn ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, said NULLS FIRST) - 1 END AS position FROM done"""

#: OP9_SQL on the conversations as mail.
OP9_MAIL_SQL = OP9_SQL.replace("FROM conversations)", r"""FROM (SELECT c.conv_id, c.turn, c.role, CASE WHEN c.text IS NOT NULL THEN concat_ws(chr(10),
    '>> ' || regexp_replace(b.said, '\r?\n', chr(10) || '>> ', 'g'), '> ' || regexp_replace(a.said, '\r?\n', chr(10) || '> ', 'g'), c.text) END AS text FROM conversations c
  LEFT JOIN (SELECT conv_id, turn + 1 AS turn, min(text) AS said FROM conversations WHERE text IS NOT NULL GROUP BY ALL) a ON c.conv_id = a.conv_id AND c.turn = a.turn
  LEFT JOIN (SELECT conv_id, turn + 2 AS turn, min(text) AS said FROM conversations WHERE text IS NOT NULL GROUP BY ALL) b ON c.conv_id = b.conv_id AND c.turn = b.turn))""", 1)

_SQL = {"op2_warc_revisits": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op9_quote_links": OP9_MAIL_SQL, "op12_spelling_variants": OP12_SQL, "op13_resample": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
