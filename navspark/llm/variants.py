"""Spelling variants: words at edit distance one, linked to far more frequent forms.

Near words share the first or the second half: an error lies in one half, and the
other is alike.  So words meet by halves, and within a bucket of such groups an
automaton over its words is walked: forward along the first half, or backward
along the second, exactly, then with one error in the other half.  Automata are
minimal and acyclic and number their words, so that counts are kept in arrays.

A pair of words has one place of error, the length of their common start, so
only one half, and one walk, reports it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.shared import Scratch, staged

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
#: Rows of one group beyond which its undecided half is halved again; of one bucket.
GROUP, BUCKET = 4096, 16_384

# What a word is made of.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word): each run of letters with A to Z lower-cased, a letter deleted from one run in 31 as id and run say; short ones left out."""
    found = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"{LETTERS}{{{min_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    run = F.col("run")
    # lower() is right, and much faster, where a run has nothing beyond ASCII.
    rows = rows.select("id", F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER)).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(run).alias("word")).where(F.char_length("word") >= min_letters)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_count`` occurrences; a word's rows are counted within each task first."""
    return runs(docs, id_col, text_col, min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """Minimal acyclic automaton over sorted distinct words; a word's number is its place among them.

    A state is a dict from letter to (state, words before that branch); ``ends``
    says where words end.  A state's own word comes before its branches.
    """

    def __init__(self, words: list[str]):
        self.states: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.sizes: list[int] = []
        self._register: dict[tuple, int] = {}
        # The states along the last word, not yet known to be like others: (ends here, finished branches).
        spine: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        earlier = ""
        for word in words:
            same = 0
            for a, b in zip(earlier, word):
                if a != b:
                    break
                same += 1
            self._close(spine, earlier, same)
            spine += [(False, []) for _ in word[same:]]
            spine[-1] = (True, spine[-1][1])
            earlier = word
        self._close(spine, earlier, 0)
        self.start = self._state(*spine[0])

    def _close(self, spine: list, word: str, depth: int) -> None:
        """Finish the states of ``word`` below ``depth``, deepest first, and hang each under its letter."""
        while len(spine) - 1 > depth:
            state = self._state(*spine.pop())
            spine[-1][1].append((word[len(spine) - 1], state))

    def _state(self, end: bool, branches: list[tuple[str, int]]) -> int:
        key = (end, *branches)
        found = self._register.get(key)
        if found is None:
            found = self._register[key] = len(self.states)
            before, table = int(end), {}
            for letter, state in branches:
                table[letter] = (state, before)
                before += self.sizes[state]
            self.states.append(table)
            self.ends.append(end)
            self.sizes.append(before)
        return found

    def walk(self, word: str, start: int, stop: int, state: int, number: int = 0) -> tuple[int, int]:
        """(state, words before) after the letters of ``word`` from ``start`` to ``stop``, or (-1, 0)."""
        states = self.states
        for at in range(start, stop):
            step = states[state].get(word[at])
            if step is None:
                return -1, 0
            state, before = step
            number += before
        return state, number

    def number(self, word: str) -> int:
        """The word's number, or -1."""
        state, number = self.walk(word, 0, len(word), self.start)
        return number if state >= 0 and self.ends[state] else -1

    def near(self, word: str, low: int, high: int, backward: bool) -> Iterator[int]:
        """Numbers of the words with one error at a place from ``low`` up to ``high``, the letters before ``low`` being alike.

        Of several places that give the same word the last counts, or, in an
        automaton of reversed words, the first, which is the last of the word
        as it reads.  An added letter stands before the place, ``high`` included
        if that is the end; backward, places of added letters are one further.
        """
        size, states = len(word), self.states
        state, number = self.walk(word, 0, low, self.start)
        for at in range(low, high + 1):
            if state < 0:
                return
            here = word[at : at + 1]
            beside = word[max(at - 1, 0) : at] if backward else word[at + 1 : at + 2]  # deleting either of two equal letters is one error
            own = beside if backward else here  # so is adding an equal letter before or after
            if at < high and beside != here:
                yield from self._ends(word, at + 1, state, number)
            add = at > low or low == 0 if backward else at < high or at == size
            for letter, (after, before) in states[state].items():
                if at < high and letter != here:
                    yield from self._ends(word, at + 1, after, number + before)
                if add and letter != own:
                    yield from self._ends(word, at, after, number + before)
            if at < size:
                state, number = self.walk(word, at, at + 1, state, number)

    def _ends(self, word: str, start: int, state: int, number: int) -> Iterator[int]:
        """The number of the word that the rest of ``word`` leads to, if it is one."""
        state, number = self.walk(word, start, len(word), state, number)
        if state >= 0 and self.ends[state]:
            yield number


def _zones(words: DataFrame) -> DataFrame:
    """(word, n, m, a, b): for queries of ``m`` letters whose error lies at a place from ``a`` up to ``b``; ``m`` is the word's length or one off."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.sequence(size - 1, size + 1)).alias("m"))
    half = F.expr("m div 2")
    return rows.select("word", "n", "m", F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("m").alias("b")))).alias("z")).select("word", "n", "m", "z.a", "z.b")


def _keyed(zones: DataFrame) -> DataFrame:
    """``zones`` with the hash of what a query's words must share: the letters before ``a`` and those from ``b`` on.

    A word too short to hold both can be no answer, and goes.
    """
    size, a, tail = F.char_length("word"), F.col("a"), F.col("m") - F.col("b")
    key = F.xxhash64("m", "a", "b", F.substring("word", F.lit(1), a), F.substring("word", size - tail + 1, tail))
    return zones.where(a + tail <= size).withColumn("key", key)


def _halved(zones: DataFrame) -> DataFrame:
    """Each zone as its two halves."""
    middle = F.expr("(a + b) div 2")
    halves = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    return zones.select("word", "n", "m", F.explode(halves).alias("z")).select("word", "n", "m", "z.a", "z.b")


FOUND = "word string, n_near bigint, form_n bigint, form string"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups in a row, in buckets: near words of those that ask, (word, n_near, n and text of the most frequent)."""
    left: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        left = table if left is None else pa.concat_tables([left, table])
        while left.num_rows > BUCKET:
            key = left.column("key").to_numpy()
            border = np.flatnonzero(key[1:] != key[:-1]) + 1
            if not len(border):
                break  # the group may go on
            cut = int(border[max(0, np.searchsorted(border, BUCKET, side="right") - 1)])
            yield from _bucket(left.slice(0, cut))
            left = left.slice(cut).combine_chunks()
    if left is not None and left.num_rows:
        yield from _bucket(left)


def _bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The answers of one bucket; groups of one row, or in which nobody asks, are passed over."""
    key = table.column("key").to_numpy()
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    text = table.column("word").to_pylist()
    length = np.fromiter(map(len, text), np.int64, len(text))
    m, a, b = (table.column(c).to_numpy() for c in "mab")
    asks = m == length
    group = np.repeat(np.arange(len(start)), size)
    useful = (size > 1) & (np.bincount(group, asks, len(start)) > 0)
    kept = np.flatnonzero(useful[group])
    n = table.column("n").to_numpy()
    out: list[tuple[str, int, int, str]] = []
    backward = m - b > a  # the longer of the two parts that are alike is walked exactly
    for side in (False, True):
        mine = kept[backward[kept] == side]
        if not len(mine):
            continue
        count = {text[i][::-1] if side else text[i]: int(n[i]) for i in mine}
        words = sorted(count)
        automaton = Automaton(words)
        counts = [count[w] for w in words]
        for i in mine[asks[mine]]:
            word, low, high = text[i], int(a[i]), int(b[i])
            if side:
                found = set(automaton.near(word[::-1], len(word) - high, len(word) - low, True))
            else:
                found = set(automaton.near(word, low, high, False))
            if found:
                most = max(counts[x] for x in found)
                ties = [words[x] for x in found if counts[x] == most]
                out.append((word, len(found), most, min(w[::-1] for w in ties) if side else min(ties)))
    if out:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): parts of each word's answer, to be added up and compared; ``words`` (word, n) are distinct and staged.

    Groups of more than GROUP rows take no part: their undecided half is halved
    again, and so on while letters are left, so that a task's groups stay small
    however many words share a half.
    """
    found, zones = None, _zones(words)
    with Scratch() as scratch:
        parts = []
        while True:
            keyed = _keyed(zones)
            hot = scratch.staged(keyed.where("b - a > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("key"), "hot")
            more = not hot.isEmpty()
            calm = keyed.join(hot, "key", "left_anti") if more else keyed
            dealt = calm.repartition("key").sortWithinPartitions("key")
            parts.append(staged(dealt.mapInArrow(_answers, FOUND), "near"))
            if not more:
                break
            zones = scratch.staged(_halved(keyed.join(hot, "key", "left_semi")), "zones")
        for part in parts:
            found = part if found is None else found.unionByName(part)
    return found


def _rooted(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links, by pointer doubling; counts rise tenfold along a link, so a few rounds do."""
    now = staged(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def linked(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    ``n_near`` counts the words at edit distance one; ``form`` is the most
    frequent of them, of equal ones the first by code points, if ``ratio``
    times as frequent as the word; ``root`` is where forms lead in the end.
    """
    words = staged(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    none = F.lit(None)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))).alias("best")
    every = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), none.cast("bigint").alias("form_n"), none.cast("string").alias("form"))
    every = every.unionByName(near_counts(words).withColumn("n", none.cast("bigint")))
    found = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    good = -F.col("best.less") >= ratio * F.col("n")
    found = staged(found.select("word", "n", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    roots = _rooted(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``linked`` words of whole texts.

    Null and empty texts have no words; repeated rows count each; a null id is
    the empty text in the rule of deletion.  Long texts and long words are read
    whole.  An empty table gives no rows; other columns are ignored.
    """
    return linked(vocabulary(docs, id_col, text_col))
