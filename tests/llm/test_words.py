"""Word encoding, spelling variants and resampling against the library, brute force and the contracts' wording."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navspark.llm import bpe, html, labelled_pages, near, queries, resample, variants

ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two three four five six seven"), (None, None), (6, "x" * 300_000), (7, "the " * 40_000), (8, "spelling spelling Spelling")]
SCHEMA = "doc_id bigint, text string"


def clashing(df):
    """``df`` with columns named like those that the operators use inside."""
    return df.selectExpr("*", "1 AS word", "'n' AS n", "2 AS key", "3 AS bucket", "'r' AS rank", "0.5D AS row", "cast(null AS string) AS id", "1 AS words")


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ODD, SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Encoding.


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORD_BPE)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.model_bytes(queries.WORD_BPE))


LETTERS = "abcdefghinorst'stremvlld 09ÉéßİΣσς́ 　漢字🙂<|>\x1c\x00\x85KÅǅ١²½\n\t,."


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.text(LETTERS, max_size=40), st.text(max_size=20), st.text("eainrst", max_size=30)), max_size=6))
def test_bpe_equals_library(codec, library, texts):
    texts = [*texts, "<|endoftext|>", "a<|endoftext|>b <|startoftext|>́"]
    ids = codec.encode(pa.array(texts))
    theirs = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.to_pylist() == theirs
    assert codec.decode(ids).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in theirs]


def test_bpe_shares_prefixes(codec):
    trie = bpe.Trie(codec.model)
    words = sorted(["internal", "international", "internationally", "interned"])
    together = list(trie.insert(words))
    assert len(trie) - 1 == len({w[:i] for w in words for i in range(1, len(w))})  # one state for each proper prefix
    assert together == [next(bpe.Trie(codec.model).insert([w])) for w in words]


def test_bpe_forgets(codec, library, monkeypatch):
    monkeypatch.setattr(bpe.Codec, "NODES", 50)
    monkeypatch.setattr(bpe.Codec, "LONG", 9)
    for text in ("the quick brown fox jumps", "over extraordinarily lazy dogs", "the quick brown fox jumps"):
        assert codec.encode(pa.array([text])).to_pylist() == [library.encode(text, add_special_tokens=False).ids]


def toy(merges, suffix=None, **more):
    base = [c + s for c in bpe.byte_letters() for s in ({"", suffix or ""})]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys([*base, *(a + b for a, b in merges)]))}
    return {"type": "BPE", "vocab": vocabulary, "merges": [list(m) for m in merges], "end_of_word_suffix": suffix, **more}


def merged(word, model):
    """Lowest rank first, leftmost first."""
    rank = {tuple(m): i for i, m in reversed(list(enumerate(model["merges"])))}
    parts = list(word)
    parts[-1] += model["end_of_word_suffix"] or ""
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return [model["vocab"][p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(seed=st.integers(0, 10_000), words=st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=20, unique=True))
def test_bpe_of_random_merges(seed, words):
    """Merges of which some are shadowed by others, with and without word ends, against merging step by step."""
    rng = random.Random(seed)
    suffix = rng.choice([None, "</w>"])
    tokens, merges, made = [*"abc", *(["a</w>", "b</w>", "c</w>"] if suffix else [])], [], set("abc")
    for _ in range(12):
        a, b = rng.choice([t for t in tokens if not t.endswith("</w>")]), rng.choice(tokens)
        if a + b not in made and a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    model = toy(merges, suffix)
    assert list(bpe.Trie(bpe.Merges(model)).insert(sorted(words))) == [merged(w, model) for w in sorted(words)]


def test_bpe_refuses_other_models():
    with pytest.raises(ValueError, match="plain BPE"):
        bpe.Merges(toy([], dropout=0.1))
    with pytest.raises(ValueError, match="before those of its parts"):
        bpe.Merges(toy([("ab", "c"), ("a", "b")]))
    model = toy([])
    del model["vocab"]["a"]
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Merges(model)


def test_bpe_odd(spark, odd, empty, library):
    found = bpe.encoded(odd, bpe.model_bytes(queries.WORD_BPE)).collect()
    assert len(found) == len(ODD) and set(found[0].asDict()) == {*odd.columns, "bpe ids", "bpe text"}
    for r in found:
        theirs = None if r.text is None else library.encode(r.text, add_special_tokens=False).ids
        assert r["bpe ids"] == theirs and r["bpe text"] == (None if theirs is None else library.decode(theirs, skip_special_tokens=False))
    assert bpe.encoded(empty, bpe.model_bytes(queries.WORD_BPE)).count() == 0
    with pytest.raises(ValueError, match="bpe ids"):
        bpe.encoded(odd.withColumn("bpe ids", F.lit(1)), b"")
    ids = spark.createDataFrame([(1, [320, 1125]), (2, []), (3, None)], "k int, input_ids array<int>")
    assert [r["bpe text"] for r in bpe.decoded(ids, bpe.model_bytes(queries.WORD_BPE)).orderBy("k").collect()] == [library.decode([320, 1125], skip_special_tokens=False), "", None]


def test_op11_contract(spark, folder, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op11_bpe(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# Spelling variants.


def one_error(a, b):
    """Whether one error leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words):
    out = {}
    for w, n in words.items():
        all_near = [x for x in words if one_error(w, x)]
        form = min(all_near, key=lambda x: (-words[x], x), default=None)
        if form is not None and words[form] < 10 * n:
            form = None
        out[w] = (form, n, len(all_near), words[form] if form else None)
    roots = {}
    for w in words:
        root = w
        while out[root][0]:
            root = out[root][0]
        roots[w] = root
    return {w: (f, roots[w], n, k, m) for w, (f, n, k, m) in out.items()}


@settings(max_examples=150, deadline=None)
@given(words=st.lists(st.text("abé", max_size=7), max_size=40, unique=True))
def test_automaton_numbers_and_errors(words):
    words = sorted(words)
    forward, backward = variants.Automaton(words), variants.Automaton(sorted(w[::-1] for w in words))
    turned = sorted(w[::-1] for w in words)
    assert [forward.number(w) for w in words] == list(range(len(words))) and forward.number("zz") == -1
    for w in [*words[:6], "abab", "aaaa", ""]:
        all_near = sorted(x for x in words if one_error(w, x))
        assert sorted(words[i] for i in forward.near(w, 0, len(w), False)) == all_near  # each once
        half = len(w) // 2
        second = [words[i] for i in forward.near(w, half, len(w), False)]
        first = [turned[i][::-1] for i in backward.near(w[::-1], len(w) - half, len(w), True)] if half else []
        assert sorted(first + second) == all_near  # the halves share them out


def test_automaton_is_minimal():
    words = sorted(a + b for a in ("walk", "talk", "stalk") for b in ("", "s", "ed", "ing"))
    assert len(variants.Automaton(words).states) == len({tuple(sorted(w[i:] for w in words if w.startswith(w0[:i]))) for w0 in words for i in range(len(w0) + 1)})


@pytest.mark.parametrize("group", [4096, 8])
def test_linked_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(variants, "GROUP", group)  # 8: hot halves are halved again, several times
    monkeypatch.setattr(variants, "BUCKET", 64)
    rng = random.Random(3)
    words = {}
    while len(words) < 500:
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 9)))
        w = rng.choice(["abcabcab", ""]) + w if rng.random() < 0.5 else "aaaaaaa"[: rng.randint(3, 7)] + w[:5]
        if len(w) >= 7:
            words[w] = rng.choice([2, 3, 20, 21, 300, 4000, 50_000])
    found = variants.linked(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == by_hand(words) and len(found) == len(words)


def test_ties_and_chains(spark):
    words = {"spelling": 5000, "spellingg": 400, "speling": 30, "spelin": 2, "spellinga": 400, "xspelling": 40, "nothing": 9}
    found = {r.word: r for r in variants.linked(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert found["spelin"].form == "speling" and found["spelin"].root == "spelling"
    assert found["nothing"].form is None and found["nothing"].root == "nothing" and found["nothing"].n_near == 0
    assert found["xspelling"].form_n == 5000 and found["spelling"].n_near == 4


def test_vocabulary(spark, odd, empty):
    docs = [(7, "Größere größere WÖRTER Wörter-wörter ×÷abcdefg short élégances"), (8, "abcdefgh " * 200), (None, "abcdefgh"), (9, None)] * 3
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    found = {r.word: r.n for r in variants.vocabulary(clashing(spark.createDataFrame(docs, SCHEMA))).collect()}
    assert found == {w: n for w, n in count.items() if n >= 2}
    assert {r.word: r.n for r in variants.variants(odd).collect()} == {"spelling": 3} and variants.variants(empty).count() == 0


# Resampling.


def by_wording(docs, target):
    """The contract, step by step."""
    def features(text):
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [zlib.crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows, fit = [], []
    for i, text in docs:
        words, found = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in found)
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score))
        if len(words) >= 20:
            fit.append((-score, i is None, i or 0, len(found), weight))
    drawn = sorted(fit)[: 25 * len(fit) // 100]
    return sorted(rows, key=repr), [(k + 1, None if null else i, -score) for k, (score, null, i, *_) in enumerate(drawn)]


def check_resampled(spark, docs, target):
    frame = clashing(spark.createDataFrame(docs, SCHEMA))
    found = resample.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    rows, drawn = by_wording(docs, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in found), key=repr) == rows
    assert sorted((r["rank"], r.doc_id, r.score) for r in found if r["rank"]) == drawn


def test_resampled(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["Ärger", "the", "THE", "naïve", "9", "a_b", "漢字", "x"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(7, docs[7][1])] * 3 + [(None, docs[9][1])] * 5
    check_resampled(spark, docs, ["the naïve", "the the x", None, ""])
    check_resampled(spark, docs, [])


def test_resampled_odd(spark, empty):
    check_resampled(spark, ODD, ["one two three"])
    assert resample.resampled(empty, empty).count() == 0


def test_resampling_shuffles_no_features(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = resample.scored(docs, [0] * 10_000)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Generate|Python|Arrow", plan)
    plan = resample.totals(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "partial_count" in plan


# Later cases of earlier operators.


@pytest.fixture(scope="module")
def pages_model():
    return labelled_pages.train()


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("frame", ["{}", "<div>{}</div>", "<div class=content>{}</div>", "<main>{}</main>"])
@pytest.mark.parametrize("before,after", [("<nav><a href=/>Home</a></nav>", "<footer>All rights reserved.</footer>"), ("<button>Click</button>", ""), ("", "<footer>Imprint</footer>")])
def test_short_articles_stay(pages_model, n, frame, before, after):
    line = "The old river ran under a stone bridge that morning."
    page = f"<html><body>{before}{frame.format(f'<p>{line}</p>' * n)}{after}</body></html>"
    assert html.extract([page], pages_model)[0] == "\n".join([line] * n)


@pytest.mark.parametrize("gap", ["<!-->", "<!--->", "<!-- a --!>", "<!-- a > b -->", "<!---->", "<![CDATA[ a ]]>", "<![CDATA[ y ]>", "<!doctype x>", "<?php x ?>"])
def test_comments_end_as_in_the_standard(pages_model, gap):
    lines = ["A first line of the story that goes on for a while.", "And a second line of it, which is not much shorter."]
    page = f"<body><article><p>{lines[0]}</p>{gap}<p>{lines[1]}</p></article></body>"
    found = html.extract([page], pages_model)[0].split("\n")
    assert found[0] == lines[0] and found[-1] == lines[1] and len(found) <= 3


def test_cdata_in_svg_hides_end_tags(pages_model):
    line = "A line of the story that goes on for a while, and then some."
    page = f"<body><article><p>{line}</p><svg><style><![CDATA[ x ]]></style><![CDATA[ </svg> <p>no</p> ]]></svg><p>{line}</p></article></body>"
    assert html.extract([page], pages_model)[0] == f"{line}\n{line}"


def test_similarity_to_the_kept_text(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, docs[i][1].upper()) for i in range(5)] + [(200, "some other text of seven or more words here"), (201, None), (None, docs[0][1])]
    found = near.representatives(clashing(spark.createDataFrame(docs, SCHEMA))).collect()
    assert len(found) == len(docs) and "n_links" not in found[0].asDict()

    def counts(text):
        words = text.lower().split()
        return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    text = dict((i, t) for i, t in docs if i is not None)
    for r in found:
        if r.doc_id is None or text[r.doc_id] is None or r.class_id == r.doc_id:
            assert r.similarity == 1.0
        else:
            assert r.class_id == 0
            assert r.similarity == pytest.approx(near.weighted_jaccard(counts(text[r.doc_id]), counts(text[0])))
