"""Byte-pair encoding by last-token states in a trie of distinct words.

A byte-pair encoder gives every prefix of a word one last token, and what
stands before that token is encoded as it is alone.  So a prefix is described by
its last token and by the prefix before it, and words that share a prefix share
its state: each is worked out once, when the word that first has it is inserted.

The last token of a prefix is the one token that ends there, encodes to itself
and does not merge across its border with the last token before it.  Borders are
judged on the merges' ranks alone, and each pair of tokens once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from navspark.llm.words import slices


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes their own, others those from 256 on, in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [table[b] for b in range(256)]


# The normaliser and the pattern of the public word tokenizer, for which ASCII has a shorter way.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
PLAIN = re.compile("[!-~]+").fullmatch


class Merges:
    """A byte-level BPE model: its tokens, how each is made, and which may stand side by side."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE models are supported: without dropout, continuing prefix, byte fallback or ignored merges")
        self.suffix = suffix = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        size = max(vocabulary.values()) + 1
        letters = byte_letters()
        missing = [c for c in letters if c not in vocabulary or c + suffix not in vocabulary]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.left, self.right = [-1] * size, [-1] * size
        self.made = [-1] * size
        self.rank: dict[int, int] = {}
        final = {vocabulary[c + suffix] for c in letters} if suffix else set()
        whole = {vocabulary[c] for c in letters} | {vocabulary[c + suffix] for c in letters}
        made = set(whole)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, new = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if not {x, y} <= made:
                raise ValueError(f"merge {rank} comes before those of its parts")
            self.rank.setdefault(x << 32 | y, rank)
            if new in made:
                continue  # made otherwise, by an earlier merge
            made.add(new)
            self.left[new], self.right[new], self.made[new] = x, y, rank
            if y in final:
                final.add(new)
        #: Tokens by their letters, apart for those that end a word; only those that encode to themselves.
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        by_rank = sorted(((self.made[i], text, i) for text, i in vocabulary.items() if i in whole or self.made[i] >= 0))
        for rank, text, i in by_rank:
            if rank >= 0:
                if not (self.left[i] in whole and self.right[i] in whole and self._border(self.left[i], self.right[i]) == rank):
                    continue
                whole.add(i)
            if i in final:
                self.last[text.removesuffix(suffix)] = i
            else:
                self.inner[text] = i
        if not suffix:
            self.last = self.inner
        self.longest = max(map(len, [*self.inner, *self.last]))
        self.fit: dict[int, bool] = {}

    def _border(self, a: int, b: int) -> int:
        """The rank of the first merge across the border of tokens ``a`` and ``b``, or -1.

        Inside ``a`` the token next to the border grows as the merges of its
        right edge come up, inside ``b`` as those of its left edge do; of equal
        ranks the leftmost comes first.
        """
        xs, ys = [a], [b]
        while self.left[xs[-1]] >= 0:
            xs.append(self.right[xs[-1]])
        while self.left[ys[-1]] >= 0:
            ys.append(self.left[ys[-1]])
        never = len(self.rank)
        while True:
            next_x = self.made[xs[-2]] if len(xs) > 1 else never
            next_y = self.made[ys[-2]] if len(ys) > 1 else never
            rank = self.rank.get(xs[-1] << 32 | ys[-1], never)
            if rank < next_x and rank <= next_y and rank < never:
                return rank
            if next_x == next_y == never:
                return -1
            if next_x <= next_y:
                xs.pop()
            else:
                ys.pop()

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow ``a``; answers are kept, up to a bound."""
        key = a << 32 | b
        found = self.fit.get(key)
        if found is None:
            if len(self.fit) >= 1 << 20:
                self.fit.clear()
            found = self.fit[key] = self._border(a, b) < 0
        return found


class Trie:
    """Prefixes of distinct words; a node holds the last token of its prefix and the node before that token.

    Only proper prefixes are nodes: the last letter may belong to a token that
    ends words, and its state serves that word alone.
    """

    def __init__(self, model: Merges):
        self.model = model
        self.edges: dict[int, int] = {}
        self.token, self.before = array("i", [-1]), array("i", [0])

    def __len__(self) -> int:
        return len(self.token)

    def insert(self, words: list[str]) -> Iterator[list[int]]:
        """The tokens of each of ``words``, which are sorted: so the trie is walked depth first, going back to where the next word leaves the last one."""
        edges, token, before, state = self.edges, self.token, self.before, self._state
        path, earlier = [0], ""
        for word in words:
            end, same = len(word) - 1, 0
            for a, b in zip(earlier, word):
                if a != b:
                    break
                same += 1
            del path[min(same, end) + 1 :]
            node = path[-1]
            for depth in range(len(path) - 1, end):
                key = node << 21 | ord(word[depth])
                node = edges.get(key)
                if node is None:
                    last, back = state(word, depth + 1, path)
                    edges[key] = node = len(token)
                    token.append(last)
                    before.append(back)
                path.append(node)
            last, node = state(word, end + 1, path)
            out = [last]
            while node:
                out.append(token[node])
                node = before[node]
            yield out[::-1]
            earlier = word

    def _state(self, word: str, stop: int, path: list[int]) -> tuple[int, int]:
        """(last token, node before it) of the first ``stop`` letters; ``path`` has the nodes of the shorter prefixes."""
        model, token = self.model, self.token
        known, fit = (model.last if stop == len(word) else model.inner).get, model.fit.get
        for start in range(max(0, stop - model.longest), stop):
            found = known(word[start:stop])
            if found is not None:
                node = path[start]
                if not node:
                    return found, 0
                good = fit(token[node] << 32 | found)
                if good or good is None and model.fits(token[node], found):
                    return found, node
        raise ValueError("no token ends here")  # cannot be: single bytes are tokens


class Codec:
    """A tokenizer file's normaliser and splitter, with this module's encoder; texts are worked on by distinct chunks between white space."""

    #: Trie nodes and letters of remembered chunks, beyond which a worker starts anew; longer words get a trie of their own.
    NODES, LETTERS, LONG = 700_000, 8 << 20, 1000

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(data)
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that are cut out of the text as they stand are supported")
        if not self._cuts_at_spaces(spec):
            raise ValueError("only tokenizers that drop white space between words are supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.normal, self.split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain = self._plain_words() if spec.get("normalizer") == NORMALIZER and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == PATTERN else None
        self.model = Merges(spec["model"])
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.joined = spec.get("decoder") is None  # then the tokens' names, with a space between
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        self.forget()

    @staticmethod
    def _cuts_at_spaces(spec: dict) -> bool:
        """Whether the first splitter keeps matches of a pattern that no white space takes part in, as the public one does."""
        splitter = spec.get("pre_tokenizer") or {}
        steps = splitter.get("pretokenizers", [splitter])
        first, rest = steps[0], steps[1:]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        parts = re.split(r"\|(?![^\[]*\])", pattern)
        bare = all(not re.search(r"\\[sSWDPX]|[ .]|\[\^", p) or p.startswith(r"[^\s") for p in parts)
        plain = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in rest)
        return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and bare and plain and len(rest) == 1

    def forget(self) -> None:
        self.trie = Trie(self.model)
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    @staticmethod
    def _plain_words():
        """PATTERN for printable ASCII, whose bytes are their own letters."""
        return re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall

    def _chunk(self, chunk: str) -> Iterator[str | int]:
        """The words of a chunk without white space, in letters of the vocabulary, and the ids of added tokens."""
        if self.plain and PLAIN(chunk) and "<" not in chunk:
            yield from self.plain(chunk.lower())
            return
        for part in self.cut.split(chunk) if self.cut and self.cut.search(chunk) else (chunk,):
            if part in self.added:
                yield self.added[part]
            elif part:
                for word, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part) if self.normal else part):
                    yield word

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """The places of the chunks in the memory; new words enter the trie in order, so that it grows depth first."""
        if self.held > self.LETTERS or len(self.trie) > self.NODES:
            self.forget()
        new = {c: list(self._chunk(c)) for c in chunks if c not in self.known}
        if new:
            trie = self.trie
            words = sorted({w for words in new.values() for w in words if isinstance(w, str)})
            short = [w for w in words if len(w) <= self.LONG]
            ids = dict(zip(short, trie.insert(short)))
            ids |= {w: next(Trie(self.model).insert([w])) for w in words if len(w) > self.LONG}
            found = [[i for w in words for i in (ids[w] if isinstance(w, str) else (w,))] for words in new.values()]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.flat = np.concatenate((self.flat, np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum()))))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
            self.held += sum(map(len, new))
        return np.fromiter((self.known[c] for c in chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; nulls stay null."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        place = self._learn(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        low, size = self.ends[place], self.ends[place + 1] - self.ends[place]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        tokens = self.flat[np.arange(total) + np.repeat(low - (stop - size), size)]
        edge = np.concatenate(([0], stop))[lists.offsets.to_numpy()]
        null = pc.is_null(texts)
        found = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(tokens, pa.int32()))
        return pc.if_else(null, pa.scalar(None, found.type), found) if pc.any(null).as_py() else found

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The texts of lists of ids, special tokens included; nulls stay null."""
        if not self.joined:
            read = self.tokenizer.decode_batch([x or [] for x in ids.to_pylist()], skip_special_tokens=False)
            return pc.if_else(pc.is_valid(ids), pa.array(read, pa.string()), pa.scalar(None, pa.string()))
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        edge = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), self.names.take(ids.flatten())), " ")
        return pc.if_else(pc.is_valid(ids), text, pa.scalar(None, pa.string()))


def model_bytes(path: str) -> bytes:
    """The content of a tokenizer file; read on the driver only."""
    with open(path, "rb") as f:
        return f.read()


_CACHE: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """The codec of this worker."""
    key = hash(data)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Codec(data)
    return _CACHE[key]


def encoded(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with "bpe ids" (array) and "bpe text" (their decoding), as the tokenizers library gives them without adding special tokens.

    ``model`` is a tokenizer file's content, a few megabytes, sent to the
    executors once.  Rows stay where they are: nothing is shuffled.  A null text
    has null ids and null text; an empty one, or one of white space, has no ids
    and an empty text.  Texts of any length are encoded whole, repeated rows
    each on their own; an empty table gives no rows.  Other columns are kept; a
    column named like one of the new ones is an error.
    """
    clash = {"bpe ids", "bpe text"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = tool.encode(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, tool.decode(ids)], names=[*part.schema.names, "bpe ids", "bpe text"])

    added = [T.StructField("bpe ids", T.ArrayType(T.IntegerType())), T.StructField("bpe text", T.StringType())]
    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *added]))


def decoded(ids: DataFrame, model: bytes, ids_col: str = "input_ids") -> DataFrame:
    """``ids`` with "bpe text", the decoding of a column of id arrays; null ids decode to null, empty ones to an empty text."""
    if "bpe text" in ids.columns:
        raise ValueError("column bpe text is there already")
    shared = ids.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, tool.decode(batch.column(ids_col))], names=[*batch.schema.names, "bpe text"])

    return ids.mapInArrow(rows, T.StructType([*ids.schema.fields, T.StructField("bpe text", T.StringType())]))
