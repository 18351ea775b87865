"""Words of Arrow text columns as hashed NumPy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are tokenised at once; it bounds a task's memory, not its result.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 8192

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, the finaliser of SplitMix64."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach ``most`` bytes or SLICE_ROWS rows; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        stop = min(stop, start + SLICE_ROWS)
        yield batch.slice(start, stop - start)
        start = stop
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on, and their executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None


class Words:
    """All words of a column of texts, one text after another.

    ``codes[i]`` is the entry of ``dictionary`` for word i, ``hashes[i]`` the 64-bit
    hash of its normal form; ``starts[d]`` and ``lengths[d]`` place text d.
    A null text has no words.  Words are split at ASCII white space, or at any
    Unicode white space with ``unicode``; words whose normal form is empty go.
    """

    def __init__(self, texts: pa.Array, normal: Callable[[str], str] | None = None, unicode: bool = False, seed: int = 0):
        split = pc.utf8_split_whitespace if unicode else pc.ascii_split_whitespace
        lists = split(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = lists.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        self.dictionary = flat.dictionary
        forms = self.dictionary.to_pylist()
        if normal:
            forms = [normal(w) for w in forms]
        self.forms = forms
        table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in forms), np.uint64, len(forms))
        blank = np.fromiter((not w for w in forms), bool, len(forms))
        if blank.any():
            kept = ~blank[codes]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            lengths = np.bincount(owner[kept], minlength=len(lengths))
            codes = codes[kept]
        self.codes, self.hashes = codes, table[codes] if len(table) else np.zeros(0, np.uint64)
        self.lengths = lengths.astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def inside(self, width: int) -> np.ndarray:
        """Whether ``width`` words from this one on lie in one text."""
        left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(len(self.codes))
        return left >= width


def grams(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on, by doubling.

    A polynomial over 64-bit word hashes modulo 2^64; ``seed`` picks the base.
    The last ``width - 1`` positions have none, so the result is that much shorter.
    """
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    base = mix(np.array([seed], np.uint64))[0] | np.uint64(1)
    total, have = None, 0
    power, span, level = base, 1, hashes
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                if total is None:
                    total, have = level, span
                else:  # these ``span`` words come before the ``have`` words
                    n = min(len(level), len(total) - span)
                    total = level[:n] * _power(base, have) + total[span : span + n]
                    have += span
            if have == width:
                return total[: len(hashes) - width + 1]
            level = level[:-span] * power + level[span:]
            power, span = power * power, span * 2


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def content_hash(words: Words, seed: int) -> np.ndarray:
    """One 64-bit hash of each text's word sequence."""
    if not len(words.codes):
        return np.zeros(len(words.lengths), np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(len(words.codes)) - np.repeat(words.starts, words.lengths)
        each = mix(words.hashes ^ mix(place.astype(np.uint64) + np.uint64(seed)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
        return sums[words.starts + words.lengths] - sums[words.starts]
