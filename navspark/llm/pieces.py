"""SentencePiece models on the tokenizers library, with parity checks.

The model file is read from its protobuf wire format; normaliser, metaspace
marker, piece scores or merges, and byte fallback are rebuilt as one
``tokenizers.Tokenizer``.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from navspark.llm.words import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters and texts that both libraries get at once; they bound a worker's memory, not its result.
BATCH, BATCH_TEXTS = 1 << 18, 8192
#: Text bytes of a slice.
SLICE = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {kind} is not used by SentencePiece models")


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    mark_spaces: bool = True
    unknown: str = " \u2047 "


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            spec.pieces.append((piece[1].decode(), piece[2], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            spec.kind = trainer.get(3, UNIGRAM)
            spec.suffix_mark = bool(trainer.get(24, 0))
            spec.byte_fallback = bool(trainer.get(35, 0))
            spec.unknown = trainer[44].decode() if 44 in trainer else spec.unknown
        elif number == 3:
            normaliser = dict(_fields(value))
            spec.charsmap = normaliser.get(2, b"")
            spec.dummy_prefix = bool(normaliser.get(3, 1))
            spec.strip_spaces = bool(normaliser.get(4, 1))
            spec.mark_spaces = bool(normaliser.get(5, 1))
    if spec.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models have a twin in tokenizers")
    if spec.suffix_mark or not spec.mark_spaces:
        raise ValueError("only models that mark white space at the front of words are supported")
    return spec


def _merges(spec: Spec) -> list[tuple[str, str]]:
    """Merges in the order of the merged piece's score: each way to make a piece of two others."""
    rank = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in spec.pieces:
        if kind == NORMAL:
            for i in range(1, len(piece)):
                if piece[:i] in rank and piece[i:] in rank:
                    found.append((-score, rank[piece[:i]], rank[piece[i:]], piece[:i], piece[i:]))
    found.sort()
    return [(a, b) for *_, a, b in found]


def build(spec: Spec):
    """The ``tokenizers.Tokenizer`` of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), None)
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocabulary, _merges(spec), unk_token=None if unknown is None else spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    tokenizer = Tokenizer(model)
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if _cuts_at_marks(spec):  # no merge spans such a place; the library then caches words
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    end = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return tokenizer


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encodes and decodes slices of texts with one rebuilt tokenizer.

    If white space is kept as it is and no piece has a mark behind another
    character, no merge and no path of the model spans a space.  Then each
    distinct word is encoded once, in multithreaded batches, compared with
    SentencePiece's ids and kept for later slices; a text's ids are its words'.
    Texts with marks or runs of spaces, and all texts of other models, go to
    both libraries whole.
    """

    #: Characters of remembered words; beyond them a worker starts anew.
    MEMORY = 3 << 20

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        from tokenizers import decoders

        self.spec, self.threads = parse(data), threads
        self.tokenizer = build(self.spec)
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = _cuts_at_marks(self.spec) and self.spec.dummy_prefix and not (self.spec.charsmap or self.spec.strip_spaces)
        # A byte piece stands for its byte: bytes are joined first and read as text then.
        self.surface = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.spec.pieces], pa.binary())
        self.plain = np.array([kind in (NORMAL, USER, BYTE) for *_, kind in self.spec.pieces])
        self.special = {i: self.spec.unknown if kind == UNKNOWN else "" for i, (_, _, kind) in enumerate(self.spec.pieces) if kind in (UNKNOWN, CONTROL)}
        self.inner = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.equal, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool), 0

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, the number of each text's, whether SentencePiece agrees).

        Texts go to the libraries a batch at a time, as their encodings take many times the texts' memory.
        """
        flat, lengths, equal = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for batch in _batches(texts):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
            equal.append(np.array([a == b for a, b in zip(ids, self.theirs.encode(batch, num_threads=self.threads))], bool))
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(lengths[-1].sum())))
        return np.concatenate(flat), np.concatenate(lengths), np.concatenate(equal)

    def _learn(self, words: list[str]) -> np.ndarray:
        """The places of the words in the memory."""
        if self.held > self.MEMORY:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            flat, lengths, equal = self._whole(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.flat = np.concatenate((self.flat, flat))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
            self.equal = np.concatenate((self.equal, equal))
            self.held += sum(map(len, new))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.BooleanArray]:
        """(ids, parity) of each text; nulls stay null."""
        null = pc.is_null(texts).to_numpy(zero_copy_only=False)
        plain = pc.fill_null(texts, "").cast(pa.large_string())
        empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
        odd = ~empty if not self.by_word else pc.match_substring_regex(plain, f"^ |  | $|{MARK}").to_numpy(zero_copy_only=False)
        easy = np.flatnonzero(~odd & ~empty & ~null)
        hard = np.flatnonzero(odd & ~null)
        ids: list = [None if n else np.zeros(0, np.int32) for n in null]
        parity: list = [None if n else True for n in null]
        if len(easy):
            lists = pc.split_pattern(plain.take(pa.array(easy)), " ")
            words = lists.flatten().dictionary_encode()
            place = self._learn(words.dictionary.to_pylist())[words.indices.to_numpy()]
            ends, flat = self.ends, self.flat
            low, size = ends[place], ends[place + 1] - ends[place]
            stop = np.cumsum(size)
            tokens = flat[np.arange(stop[-1]) + np.repeat(low - (stop - size), size)]
            edge = lists.offsets.to_numpy()
            cut = np.concatenate(([0], stop))[edge]
            good = np.concatenate(([0], np.cumsum(~self.equal[place])))[edge]
            for k, text in enumerate(easy):
                ids[text], parity[text] = tokens[cut[k] : cut[k + 1]], bool(good[k + 1] == good[k])
        if len(hard):
            flat, size, same = self._whole(plain.take(pa.array(hard)).to_pylist())
            stop = np.cumsum(size)
            for text, low, high, e in zip(hard, stop - size, stop, same):
                ids[text], parity[text] = flat[low:high], bool(e)
        return pa.array(ids, pa.list_(pa.int32())), pa.array(parity, pa.bool_())

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The texts of lists of ids; nulls stay null."""
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        values = ids.flatten()
        plain = self.plain[values.to_numpy()]
        edge = np.concatenate(([0], np.cumsum(lengths)))
        odd = np.diff(np.concatenate(([0], np.cumsum(~plain)))[edge]) > 0
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), self.surface.take(values)), b"")
        try:
            text = joined.cast(pa.string())
        except pa.ArrowInvalid:  # some text has bytes that are no character
            read = [_text(x) for x in joined.to_pylist()]
            odd |= np.array([x is None for x in read])
            text = pa.array([x or "" for x in read], pa.string())
        if self.spec.dummy_prefix:
            text = pc.replace_substring_regex(text, "^ ", "")
        out = pc.if_else(pc.is_valid(ids), text, pa.scalar(None, pa.string()))
        if odd.any():
            at = np.flatnonzero(odd)
            lists = ids.take(pa.array(at)).to_pylist()
            texts = self.tokenizer.decode_batch(lists, skip_special_tokens=False)
            texts = [self._with_specials(x) if any(i in self.special for i in x) else t for x, t in zip(lists, texts)]
            out = pc.replace_with_mask(out, pa.array(odd), pa.array(texts, pa.string()))
        return out


    def _with_specials(self, ids: list[int]) -> str:
        """Decoding of ids among which are unknown pieces, which have a surface of their own, or control pieces, which have none."""
        out, opens = [], self.spec.dummy_prefix
        for special, run in groupby(ids, lambda i: i in self.special):
            text = "".join(self.special[i] for i in run) if special else self.inner.decode([self.spec.pieces[i][0] for i in run])
            if opens and text:
                text, opens = text if special else text.removeprefix(" "), False
            out.append(text)
        return "".join(out)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """The texts in batches of BATCH characters or BATCH_TEXTS texts; a longer text is a batch of its own."""
    batch, held = [], 0
    for text in texts:
        if batch and (held + len(text) > BATCH or len(batch) == BATCH_TEXTS):
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    if batch:
        yield batch


def _text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _cuts_at_marks(spec: Spec) -> bool:
    return all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p, _, kind in spec.pieces if kind in (NORMAL, USER))


_CACHE: dict[int, Codec] = {}


def codec(data: bytes, threads: int = 2) -> Codec:
    """The codec of this worker."""
    key = hash(data)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Codec(data, threads)
    return _CACHE[key]


def encoded(docs: DataFrame, model: bytes, text_col: str = "text", threads: int = 2) -> DataFrame:
    """``docs`` with "piece ids" (array), "piece text" (their decoding) and "piece parity".

    Parity says that the SentencePiece library gives the same ids.  ``model`` is
    the model file's content, about a megabyte; it is sent to the executors
    once.  A null text has null ids, text and parity; an empty one has no ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value, threads)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                ids, parity = tool.encode(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, tool.decode(ids), parity], names=[*part.schema.names, "piece ids", "piece text", "piece parity"])
        tool.forget()  # the worker may serve other stages next

    added = [T.StructField("piece ids", T.ArrayType(T.IntegerType())), T.StructField("piece text", T.StringType()), T.StructField("piece parity", T.BooleanType())]
    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *added]))


def decoded(ids: DataFrame, model: bytes, ids_col: str = "input_ids", threads: int = 2) -> DataFrame:
    """``ids`` with "piece text", the decoding of a column of id arrays; null ids decode to null."""
    shared = ids.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(shared.value, threads)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, tool.decode(batch.column(ids_col))], names=[*batch.schema.names, "piece text"])

    return ids.mapInArrow(rows, T.StructType([*ids.schema.fields, T.StructField("piece text", T.StringType())]))
