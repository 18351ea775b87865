"""SQL for the corpus operators that count hashed words."""

#: A row ``tab`` of 256 numbers, from which _CRC reads the CRC-32 of a text.
_TAB = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"""


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a column, unsigned; the query joins the row of _TAB."""
    digits = f"hex(encode({text}))"
    digit = "instr('123456789ABCDEF', substr(d, {}, 1))"
    octets = f"list_transform(list_transform(range(1, len({digits}), 2), lambda i: substr({digits}, i, 2)), lambda d: 16 * {digit.format(1)} + {digit.format(2)})"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


OP12_SQL = rf"""WITH RECURSIVE {_TAB},
r AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT coalesce(id, '') || ':' || run AS k, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc("k")} AS h FROM d, crc),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w),
v AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM x),
pairs AS (SELECT a.word, b.word AS other, b.n FROM v a JOIN v b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min(row(-n, other)) AS b FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
walk AS (SELECT word, form AS root, 1 AS depth FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form, depth + 1 FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN root ON f.word = root.word"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""WITH {_TAB},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
fd AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM d),
fi AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM i),
every AS (SELECT f FROM fd UNION SELECT f FROM fi),
b AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM every, crc),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN b ON fd.f = b.f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fi JOIN b ON fi.f = b.f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
  / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, sum(gain) AS total FROM fd JOIN b ON fd.f = b.f JOIN g ON b.bucket = g.bucket GROUP BY r),
c AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m ON d.r = m.r),
q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY words >= 20) AS fit FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM k"""
