"""Words, hashes and Arrow batches, shared by the operators that read texts in Python.

Texts are handled as UTF-8 bytes. bytes.split() cuts at the six ASCII white
space bytes, which never occur inside another character, so its words are those
of [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Words whose hashes a Python worker keeps.
CACHE_WORDS = 200_000


class WordHashes(dict):
    """64-bit hash of each word, computed when it is first asked for. Hashes of another seed are independent."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))

    def flat(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of some texts, one text after another, and the places where each begins, with the end."""
        edges = np.cumsum([0, *map(len, split)])
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), U, edges[-1]), edges


class Memo(dict):
    """make(key) of each text, computed when it is first asked for; of texts of more letters than `longest` each time.

    Two generations of `most` keys are kept at most: when the young one is full
    it becomes the old one, and of that what is asked for again stays.
    """

    def __init__(self, make: Callable[[str], object], most: int, longest: int) -> None:
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd(seed: int) -> np.uint64:
    """An odd multiplier for each seed."""
    return scramble(np.array([seed + 1], U) * U(0x9E3779B97F4A7C15))[0] | U(1)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Rows and bytes of text that are held as Python objects at a time; a longer text is held alone.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 19


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Shorter batches, so that few texts are held as Python objects at a time."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            held = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            to = max(at + 1, min(at + rows, held))
            yield batch.slice(at, to - at)
            at = to


def _trim() -> None:
    """Give free memory back: workers live on between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving back at the end of a task what memory it took."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return trimmed


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + count), one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, plane by plane, so that planes of zeros pack well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def numbers(data: bytes, n: int) -> np.ndarray:
    """What planes() packed."""
    rows = np.frombuffer(data, np.uint8).reshape(n, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :n] = rows.T
    return out.view("<u8").ravel()


def width_of(most: int) -> int:
    """Bytes that hold the numbers up to `most`."""
    return max(1, (most.bit_length() + 7) // 8)


def blank(schema: pa.Schema, rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of so many rows with these columns; the others are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)
