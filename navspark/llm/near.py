"""Near-duplicate documents: DartMinHash signatures, banded stars, exact verification.

A document is the multiset of its five-word shingles.  DartMinHash (Christiani,
2020) throws hashed darts at the set's region of the (element, weight, rank)
space and keeps, for each coordinate of the signature, the dart of least rank.
Two signatures agree in a coordinate with the probability of the sets' weighted
Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.components import components, merged
from navspark.llm.shared import Scratch, staged
from navspark.llm.words import Words, content_hash, grams, mix, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Share of two sizes' sum that texts of SIMILARITY have in common.
SHARED = SIMILARITY / (1 + SIMILARITY)
#: A band's buckets get their star from one of so many orders of their members; a power of two.
ORDERS = 4
#: A bucket of so many texts may be compared pair by pair: at most SMALL / 2 pairs a text.
SMALL = 8
#: A mixed bucket gets so many typical texts as further centres.
TYPICAL = 4
#: Pairs of one centre that are verified in one group, and the most groups that a centre is copied to.
GROUP, GROUPS = 256, 4096


def multisets(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) rows, sorted; a text shorter than ``width`` words is one shingle."""
    hashed = grams(words.hashes, width, seed=11)
    whole = words.inside(width)[: len(hashed)]
    text = words.owners()[: len(hashed)][whole]
    keys = hashed[whole]
    short = np.flatnonzero((words.lengths < width) & (words.lengths > 0))
    if len(short):
        text = np.concatenate((text, short))
        keys = np.concatenate((keys, content_hash(words, 7)[short]))
    bits = max(1, int(len(words.lengths) - 1).bit_length())
    packed = (text.astype(np.uint64) << np.uint64(64 - bits)) | (mix(keys) >> np.uint64(bits))
    packed.sort()
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    # Which text is first is chance, so its number is taken off and all keep the same 40 bits.
    return (packed >> np.uint64(64 - bits)).astype(np.int64), (packed << np.uint64(bits)) >> np.uint64(16), weight.astype(np.float64)


def dart_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Signatures (n_texts, size) of weighted sets given as sorted (text, element, weight) rows.

    The weight axis is cut at powers of two.  In each cut of each element, darts
    arrive along the rank axis as a Poisson process whose rate is the cut's
    width; arrival, height and coordinate of a dart depend on element, cut and
    ordinal alone, so all sets see the same darts.  A dart counts for a set if
    its height is below the element's weight there.  About
    size * (ln(size) + 2) darts are needed; sets that leave a coordinate empty
    are thrown again with twice the reach.  A set without elements has zeros.
    """
    out = np.zeros((n_texts, size), np.uint64)
    if not len(text):
        return out
    total = np.bincount(text, weights=weight, minlength=n_texts)
    reach = np.divide(size * (np.log(size) + 2), total, out=np.zeros(n_texts), where=total > 0)
    cuts = np.maximum(np.ceil(np.log2(weight)).astype(np.int64), 0) + 1
    row = np.repeat(np.arange(len(text)), cuts)
    cut = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    low = np.where(cut == 0, 0.0, 2.0 ** (cut - 1))
    width = np.where(cut == 0, 1.0, low)
    with np.errstate(over="ignore"):
        cell = mix(element[row] ^ mix(cut.astype(np.uint64) + np.uint64(1 << 20)))
    owner, most = text[row], weight[row]
    todo = total > 0
    while todo.any():
        rank = np.full(n_texts * size, np.inf)
        kept = []
        live = np.flatnonzero(todo[owner])
        at = np.zeros(len(live))
        ordinal = 0
        while len(live):
            with np.errstate(over="ignore"):
                a = mix(cell[live] + np.uint64(3 * ordinal + 1))
                b = mix(a + np.uint64(0x51ED2701))
            at = at - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live]
            on = at < reach[owner[live]]
            live, at, a, b = live[on], at[on], a[on], b[on]
            height = low[live] + (b >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[live]
            hit = height < most[live]
            place = owner[live[hit]] * size + ((b[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(rank, place, at[hit])
            kept.append((place, at[hit], a[hit]))
            ordinal += 1
        place, at, dart = (np.concatenate(x) for x in zip(*kept))
        best = at == rank[place]
        flat = out.reshape(-1)
        flat[place[best]] = dart[best]
        empty = np.isinf(rank).reshape(n_texts, size).any(axis=1)
        todo &= empty
        reach[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes of a band and its ``rows`` coordinates; the lowest bits are the band's order."""
    keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(signatures), 1))
    with np.errstate(over="ignore"):
        for i in range(rows):
            keys = mix(keys ^ signatures[:, i::rows][:, :bands])
    return (keys & ~np.uint64(ORDERS - 1)) | (np.arange(bands) % ORDERS).astype(np.uint64)


def occurrences(text: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, element) rows of a set for each multiset: the k-th occurrence of a shingle is an element of its own.

    So the Jaccard similarity of the sets is the multisets' weighted one.
    """
    times = weight.astype(np.int64)
    row = np.repeat(np.arange(len(text)), times)
    again = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    out = element[row]
    more = again > 0
    with np.errstate(over="ignore"):
        out[more] = mix(out[more] ^ (again[more].astype(np.uint64) << np.uint64(48))) >> np.uint64(16)
    return text[row], out


def _raw(text: str) -> Column:
    return F.xxhash64(F.col(text))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw, h1, h2, size, k0, k1, ...) of each row.

    ``raw`` hashes the text as it is, ``h1, h2`` its word sequence; ``size`` is
    the number of shingles, 0 without words; ``k0, k1, ...`` are the keys of its bands.
    """
    names = ["doc_id", "raw", "h1", "h2", "size", *(f"k{i}" for i in range(BANDS))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), str.lower, unicode=True)
                text, element, weight = multisets(words)
                n = part.num_rows
                keys = band_keys(dart_minhash(text, element, weight, n, BANDS * ROWS), BANDS, ROWS).view(np.int64)
                size = np.bincount(text, weights=weight, minlength=n).astype(np.int64)
                hashed = [pa.array(content_hash(words, seed).view(np.int64)) for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("raw"), *hashed, pa.array(size), *(pa.array(keys[:, i].copy()) for i in range(BANDS))], names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _raw(text_col).alias("raw"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, ", ".join(f"{n} bigint" for n in names))


def weighted_jaccard(a: dict, b: dict) -> float:
    """Similarity of two multisets given as counts."""
    shared = sum(min(n, b[k]) for k, n in a.items() if k in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, elements) of texts (node, h1, text) whose word sequence has the hash ``h1``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), str.lower, unicode=True)
                text, element = occurrences(*multisets(words))
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=part.num_rows)))).astype(np.int32)
                sets = pa.ListArray.from_arrays(ends, element.view(np.int64))
                own = pa.array(content_hash(words, 1).view(np.int64) == part.column("h1").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], names=["node", "elements"]).filter(own)

    return texts.select("node", "h1", "text").mapInArrow(rows, "node bigint, elements array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of distinct node pairs (a, b, n), from the whole sets (node, elements).

    ``n`` is the size of the bucket that a is the centre of.  A centre's pairs
    are dealt to groups of about GROUP, and its set is copied to each group once,
    so the centre of a large bucket is no hot key.
    """
    groups = F.least(F.lit(GROUPS), F.ceil(F.col("n") / GROUP))
    dealt = pairs.withColumn("group", F.pmod(F.xxhash64("b"), groups).cast("int"))
    left = dealt.select("a", "group").distinct().join(sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a")), "a")
    right = dealt.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    score = shared / (F.size("of_a") + F.size("of_b") - shared)
    return right.join(left, ["a", "group"]).select("a", "b", score.alias("similarity"))


def _fits(a: str, b: str) -> Column:
    """Whether two sizes let their texts be similar."""
    return F.least(a, b) + 1e-6 >= SHARED * (F.col(a) + F.col(b))


def _apart(members: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets that hold several classes, with their class and the bucket's least size."""
    return _mixed(members.join(label, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component", "least"), scratch)


def _mixed(here: DataFrame, scratch: Scratch) -> DataFrame:
    buckets = here.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("size").alias("least"))
    buckets = scratch.staged(buckets.where("low <> high").select("key", "least"), "mixed")
    return scratch.staged(here.join(buckets, "key"), "apart")


def _pairs(here: DataFrame) -> DataFrame:
    """(a, b, n) in one bucket but in different classes that their sizes let be similar."""
    one = here.select("key", F.col("node").alias("a"), F.col("comp").alias("of"), F.col("size").alias("size_a"), "n")
    other = here.select("key", F.col("node").alias("b"), F.col("comp").alias("in"), F.col("size").alias("size_b"))
    return one.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("of") != F.col("in")) & _fits("size_a", "size_b")).select("a", "b", "n")


def _tokens(sets: DataFrame) -> DataFrame:
    """A row per element."""
    return sets.withColumn("element", F.explode("elements")).drop("elements")


def _prefixes(here: DataFrame, tokens: DataFrame, spread: DataFrame, own: DataFrame) -> DataFrame:
    """(node, element, before): the elements (node, element) that a similar text of a bucket may share first, in the order of rarity.

    Of two similar texts the rarest element that they share has, in either,
    all that they share at or behind it; so no more than the size without what
    must be shared stand ``before``.
    """
    texts = here.groupBy("node").agg(F.max("size").alias("size"), F.min("least").alias("least")).join(own, "node", "left")
    bounds = texts.select("node", F.coalesce("own", F.lit(0)).alias("own"), (F.col("size") - SHARED * (F.col("size") + F.col("least")) + 1e-6).alias("spare"))
    before = F.col("own") + F.row_number().over(Window.partitionBy("node").orderBy("df", "element")) - 1
    mine = tokens.join(spread.select("element", "df"), "element").join(bounds.where("own <= spare"), "node")
    return mine.withColumn("before", before).where("before <= spare").select("node", "element", "before")


def _by_rare(here: DataFrame, bands: DataFrame, prefixes: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, n) pairs that may join classes which share a bucket.

    Of two texts of different classes in a bucket at least one is outside the
    bucket's largest class.  If such a text x is similar to a text y of the
    bucket, what either does not share with the other are at most its size less
    SHARED * (size(x) + size(y)) elements.  So the rarest element that they
    share stands, in the order of rarity, behind no more than these in either:
    an equality join on such prefixes finds every such pair, and the further
    back an element stands, the closer the sizes must be.  A text with more
    elements of its own, on either side, drops out of the bucket, which may
    leave it with one class, or a greater least size.  Of the pairs that meet,
    those that share no bucket go.
    """
    here = here.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    for _ in range(2):
        here = here.where(F.col("own") <= F.col("size") - SHARED * (F.col("size") + F.col("least")) + 1e-6).drop("least")
        here = _mixed(here, scratch)
    sizes = scratch.staged(here.groupBy("key", "comp").agg(F.count("*").alias("k")), "sizes")
    largest = sizes.join(sizes.groupBy("key").agg(F.max("k").alias("k")), ["key", "k"]).groupBy("key").agg(F.min("comp").alias("main"))
    largest = scratch.staged(largest, "largest")
    rest = here.join(largest, "key").where(F.col("comp") != F.col("main")).select("node").distinct()
    every = scratch.staged(here.groupBy("node").agg(*(F.max(c).alias(c) for c in ("comp", "size")), F.min("least").alias("least")), "every")
    spare = F.col("size") - SHARED * (F.col("size") + F.col("least")) + 1e-6
    rare = scratch.staged(prefixes.join(every, "node").where(F.col("before") <= spare).drop("least"), "rare")
    mine = rare.join(rest, "node", "left_semi").select(F.col("node").alias("a"), F.col("comp").alias("in"), F.col("size").alias("size_a"), F.col("before").alias("before_a"), "element")
    need = SHARED * (F.col("size") + F.col("size_a")) - 1e-6
    can = (F.col("size_a") - F.col("before_a") >= need) & (F.col("size") - F.col("before") >= need)
    met = mine.join(rare.withColumnRenamed("node", "b"), "element").where((F.col("comp") != F.col("in")) & can)
    # Both ends of a pair may have found it.
    met = scratch.staged(met.select("a", "b").distinct(), "met")
    twice = met.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a > b")
    met = met.join(twice, ["a", "b"], "left_anti")
    keys = [bands.select(F.col("node").alias(end), F.col("keys").alias(f"keys_{end}")) for end in ("a", "b")]
    together = met.join(keys[0], "a").join(keys[1], "b").where(F.arrays_overlap("keys_a", "keys_b"))
    return together.select("a", "b").withColumn("n", F.lit(16 * GROUP))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, raw, h1, h2, class_id, class_docs, class_texts, n_links, is_kept.

    Texts that are equal word for word (case and white space aside) are one node.
    Nodes that share one of 20 bands of four minima and whose five-word shingle
    multisets have a weighted Jaccard similarity of at least 0.8 are linked;
    classes are the connected components, named by their least doc_id.  A bucket
    is never expanded into all its pairs: its members are compared with one of
    them; where they stay in different classes, with a few typical ones, those
    with least shingles of their own; and then texts of different classes
    where their rarest shingles meet, which every similar pair's do.  ``n_links``
    counts the other texts that the row's text was found similar to on this way.

    Null or wordless texts, and rows without doc_id, are classes of their own
    (class_id is their doc_id).  Repeated rows fall into one class and share
    ``is_kept``; ``is_kept`` marks the rows of least (doc_id, h1, h2) of a class.
    ``raw`` is xxhash64 of the text as it is.  Other input columns are ignored;
    an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(signatures(docs, "doc_id", "text"), "signatures")
    keys = [f"k{i}" for i in range(BANDS)]
    with Scratch() as scratch:
        put = scratch.staged
        same = signed.where("size > 0 and doc_id is not null").groupBy("h1", "h2")
        nodes = same.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min("raw").alias("raw"), *(F.max(c).alias(c) for c in ["size", *keys]))
        # Written once, so the numbers stay; they are as long as a hash is, and sort faster than two.
        nodes = put(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        members = nodes.select("node", "size", F.explode(F.array(*keys)).alias("key"))
        # The least of a bijective hash picks a bucket's centre; bands of one order pick alike.
        rank = F.xxhash64(F.col("key").bitwiseAND(ORDERS - 1), F.col("node"))
        shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", rank).alias("centre"), F.min_by("size", rank).alias("size_of_centre")).where("n > 1")
        shared = put(shared, "shared")
        members = put(members.join(shared, "key"), "members")
        wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("raw", "node", "h1")
        texts = docs.where("text is not null").groupBy(_raw("text").alias("raw")).agg(F.first("text").alias("text"))
        sets = put(shingle_sets(texts.join(wanted, "raw")), "sets")

        # First each bucket's members are compared with one of them.
        found = members.where((F.col("node") != F.col("centre")) & _fits("size", "size_of_centre"))
        tested = put(found.groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n")), "pairs")
        links = put(verified(tested, sets).where(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")
        label = components(links, "a", "b")

        # Of buckets that hold several classes, small ones are compared pair by pair, others with their most typical text.
        members = members.drop("centre", "size_of_centre")
        here = _apart(members, label, scratch)
        if not here.isEmpty():
            many = here.where(F.col("n") > SMALL)
            tokens = put(_tokens(sets.join(many.select("node").distinct(), "node", "left_semi")), "tokens")
            counted = put(tokens.groupBy("element").agg(F.count("*").alias("df"), F.min("node").alias("node")), "spread")
            own = put(counted.where("df = 1").groupBy("node").agg(F.count("*").alias("own")), "own")
            spread = counted.where("df > 1")
            few = F.floor(F.coalesce(F.col("own") / F.col("size"), F.lit(0.0)) * 20)
            ranked = put(many.join(own, "node", "left").withColumn("few", few).drop("own"), "ranked")
            least = put(ranked.groupBy("key").agg(F.min("few").alias("few")), "least")
            orders = [F.xxhash64(F.lit(i), F.col("key").bitwiseAND(ORDERS - 1), F.col("node")) for i in range(TYPICAL)]
            centres = ranked.join(least, ["key", "few"]).groupBy("key").agg(*(F.min_by(F.struct("node", "comp", "size"), o).alias(f"c{i}") for i, o in enumerate(orders)))
            centres = centres.select("key", F.explode(F.array_distinct(F.array(*(f"c{i}" for i in range(TYPICAL))))).alias("c"))
            centres = put(centres.select("key", F.col("c.node").alias("centre"), F.col("c.comp").alias("in"), F.col("c.size").alias("size_of_centre")), "typical")
            star = many.join(centres, "key").where((F.col("comp") != F.col("in")) & _fits("size", "size_of_centre"))
            found = star.select(F.col("centre").alias("a"), F.col("node").alias("b"), "n").unionByName(_pairs(here.where(F.col("n") <= SMALL)))
            found = found.groupBy("a", "b").agg(F.max("n").alias("n"))
            more = put(_untested(found, tested), "pairs")
            tested = tested.unionByName(more)
            new = put(verified(more, sets).where(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")
            label, links = put(merged(label, new, "a", "b"), "label"), links.unionByName(new)

            # What large buckets still hold apart is compared where its rarest shingles meet.
            here = _apart(many.drop("comp"), label, scratch)
            if not here.isEmpty():
                prefixes = put(_prefixes(here, tokens, spread, own), "prefixes")
                found = put(_untested(_by_rare(here, nodes.select("node", F.array(*keys).alias("keys")), prefixes, own, scratch), tested), "pairs")
                if not found.isEmpty():
                    new = put(verified(found, sets).where(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")
                    label, links = put(merged(label, new, "a", "b"), "label"), links.unionByName(new)

        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        degree = ends.select("e.*").distinct().groupBy("node").agg(F.count("*").alias("n_links"))
        named = nodes.select("node", "doc_id", "h1", "h2", "n").join(label, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = put(named.withColumn("n_links", F.coalesce("n_links", F.lit(0))), "named")
        least = named.groupBy("component").agg(F.min("doc_id").alias("least"), F.sum("n").alias("class_docs"), F.count("*").alias("class_texts"))
        classes = put(named.join(put(least, "least"), "component"), "classes")
        # Of one doc_id with several texts in a class, the least hash is kept.
        first = classes.where("doc_id = least").groupBy("component").agg(F.min(F.struct("h1", "h2")).alias("first"))
        classes = classes.join(put(first, "first"), "component").withColumn("is_first", (F.col("doc_id") == F.col("least")) & (F.struct("h1", "h2") == F.col("first")))
        classes = staged(classes.select("h1", "h2", "least", "class_docs", "class_texts", "n_links", "is_first"), "classes")
    linked = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    joined = signed.drop(*keys).withColumn("linked", linked).join(classes, ["h1", "h2"], "left")
    return joined.select(
        "doc_id", "raw", "h1", "h2",
        F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("linked"), F.col("class_docs")).otherwise(1).alias("class_docs"),
        F.when(F.col("linked"), F.col("class_texts")).otherwise(1).alias("class_texts"),
        F.when(F.col("linked"), F.col("n_links")).otherwise(0).alias("n_links"),
        F.when(F.col("linked"), F.col("is_first") & (F.col("doc_id") == F.col("least"))).otherwise(True).alias("is_kept"),
        (~F.col("linked")).alias("is_lone"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with "similarity": that of the row's text to the text that its class keeps, exactly, from the whole shingle sets.

    Membership and these links to one representative are the class's answer;
    its pairs are not listed, nor counted, so n_links is left out.  A kept text
    and its copies have 1, as have rows that are classes of their own.  Members
    may lie below the threshold from the representative: a chain links them.
    """
    found = staged(near_duplicates(docs, id_col, text_col).drop("n_links"), "classes")
    several = found.where("not is_lone and class_texts > 1")
    kept = several.where("is_kept").groupBy("class_id").agg(F.min("h1").alias("top1"), F.min("h2").alias("top2"))
    texts = staged(several.groupBy("class_id", "h1", "h2").agg(F.min("raw").alias("raw"), F.max("class_texts").alias("n")).withColumn("node", F.monotonically_increasing_id()), "texts")
    source = docs.where(F.col(text_col).isNotNull()).groupBy(_raw(text_col).alias("raw")).agg(F.first(text_col).alias("text"))
    sets = staged(shingle_sets(source.join(texts.select("raw", "node", "h1"), "raw")), "sets")
    top = texts.join(kept, "class_id").where((F.col("h1") == F.col("top1")) & (F.col("h2") == F.col("top2"))).select("class_id", F.col("node").alias("a"))
    pairs = texts.join(top, "class_id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"), "n")
    # Representatives of large classes are copied to groups, as centres of buckets are.
    scored = verified(pairs, sets).join(texts.select(F.col("node").alias("b"), "h1", "h2", F.col("class_id").alias("of")), "b").select("h1", "h2", "of", "similarity")
    same = (found["h1"] == scored["h1"]) & (found["h2"] == scored["h2"]) & (found["class_id"] == scored["of"])
    joined = found.join(scored, same, "left")
    return joined.select(*(found[c] for c in found.columns), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs that were not tested yet, in either direction."""
    turned = tested.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(tested.select("a", "b").unionByName(turned), ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class, all columns as they were.

    Null and wordless texts and rows without id all stay.  Of repeated rows, and
    of rows of one id whose texts differ in case or white space only, one stays.
    """
    found = near_duplicates(docs, id_col, text_col).where("is_kept")
    # Grouped by a struct, so that the join before, by the hashes, stays one that adaptive execution can split.
    kept = found.where("not is_lone").groupBy("doc_id", F.struct("h1", "h2").alias("node")).agg(F.min("raw").alias("raw"), F.count("*").alias("n"))
    lone = found.where("is_lone").select("doc_id", "raw").distinct().withColumn("n", F.lit(1))
    kept = staged(kept.select("doc_id", "raw", "n").unionByName(lone).toDF("id of kept", "raw of kept", "times"), "kept")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("id of kept")) & (_raw(text_col) == F.col("raw of kept"))
    out = docs.join(kept.where("times = 1"), same, "left_semi")
    if kept.where("times > 1").isEmpty():
        return out
    again = docs.join(kept.where("times > 1"), same, "left_semi").dropDuplicates([id_col, text_col])
    return out.unionByName(again)
