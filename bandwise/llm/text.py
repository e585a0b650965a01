"""Whole texts as byte arrays: words, their hashes and their documents, many documents at a time.

Arrow string columns are read without copying.  A word is a run of bytes of a given class; all classes used
here are unions of ASCII characters and "every byte of 0x80 and above", so runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer document is a block by itself.
BLOCK_BYTES = 1_500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLES: dict[str, np.ndarray] = {}


def byte_class(*ranges: tuple[int, int], high: bool = True) -> np.ndarray:
    """Membership table of a byte class; `high` adds every byte of 0x80 and above."""
    table = np.zeros(256, bool)
    for low, last in ranges:
        table[low : last + 1] = True
    if high:
        table[0x80:] = True
    return table


#: Everything but blanks (space and 0x09 to 0x0D).
NOT_BLANK = ~byte_class((0x09, 0x0D), (0x20, 0x20), high=False)
#: ASCII letters and digits, and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: ASCII letters and everything beyond ASCII.
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing, so that every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Mixed 64-bit values as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_TABLES.get(name, ())) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _TABLES[name] = np.multiply.accumulate(table)
    return _TABLES[name]


def _byte_values() -> np.ndarray:
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    return _TABLES["bytes"]


class Hasher:
    """Hashes of any slices of one byte array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * _powers("up", _BASE, len(data) + 1)[: len(data)], out=self.sums[1:])
        self.down = _powers("down", _INVERSE, len(data) + 1)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def string_hash(value: bytes) -> int:
    """The hash that `Hasher` gives this string as a slice."""
    data = np.frombuffer(value, np.uint8)
    return int(Hasher(data).slices(np.array([0]), np.array([len(data)]))[0])


@dataclass
class Block:
    """Some documents of a batch: their bytes, the offsets of each, and the rows they come from."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column (null: empty), cut into blocks between documents."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, raw, values = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


@dataclass
class Words:
    """Words of a block in order: byte ranges, and `first[d]:first[d + 1]` are those of document d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block, kind: np.ndarray, edges: np.ndarray | None = None) -> Words:
    """Runs of bytes of the class `kind`; no run crosses the border of a document."""
    n = len(block.data)
    inside = kind[block.data]
    edges = block.offsets if edges is None else edges
    edge = edges[(edges > 0) & (edges < n)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, block.offsets))


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` over the ranges between `first`, also of empty ranges."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def coded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts (null: none) with A-Z lower-cased, by kernels of Arrow:
    the row of each word, its number, and the distinct words by number."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=_NO_WORD)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.not_equal(pc.binary_length(flat), 0)  # splitting leaves empty strings at both ends of a text
    coded = pc.dictionary_encode(flat.filter(real))
    owner = owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    return owner, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
