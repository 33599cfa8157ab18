"""Vectorised work on Arrow string columns: words, lines and their hashes, straight from the UTF-8 buffer.

A batch of texts is one byte buffer with document offsets, so a NumPy call handles all documents of the batch
at once; nothing runs per word in Python. A null text counts as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text makes a chunk of its own. Bounds a worker's memory, not results.
CHUNK_BYTES = 4 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def mults(n: int, salt: int) -> np.ndarray:
    """n pseudo-random odd multipliers; entry i is the same for every n."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 40)) * _GOLD) | np.uint64(1)


_TABLES: dict[int, np.ndarray] = {}


def _table(n: int, salt: int) -> np.ndarray:
    if salt not in _TABLES or len(_TABLES[salt]) < n:
        _TABLES[salt] = mults(max(n, 4096), salt)
    return _TABLES[salt]


class Texts:
    """Texts as one uint8 buffer `data` with int64 offsets `at` (length n + 1)."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
        self.data, self.at, self.n = data[offsets[0] : offsets[-1]], offsets - offsets[0], n

    def rows(self) -> np.ndarray:
        """The row of each byte."""
        return np.repeat(np.arange(self.n), np.diff(self.at))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in a string column, whole rows always."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Pieces:
    """Maximal runs of bytes where `inside` is true, never across rows: `start`, `stop`, `row`, and `at`, the first run of each row."""

    def __init__(self, texts: Texts, inside: np.ndarray):
        n = len(inside)
        edge = np.zeros(n + 1, np.bool_)
        if n:
            edge[0] = inside[0]
            edge[1:n] = inside[1:] & ~inside[:-1]
            heads = texts.at[:-1][np.diff(texts.at) > 0]
            edge[heads] = inside[heads]
        self.start = np.flatnonzero(edge[:n])
        tail = np.zeros(n + 1, np.bool_)
        if n:
            tail[n] = inside[n - 1]
            tail[1:n] = inside[:-1] & ~inside[1:]
            tail[heads] |= np.concatenate(([False], inside))[heads]
        tail[0] = False
        self.stop = np.flatnonzero(tail)
        self.at = np.searchsorted(self.start, texts.at)
        self.row = np.repeat(np.arange(texts.n), np.diff(self.at))

    def __len__(self) -> int:
        return len(self.start)


def hashes(data: np.ndarray, p: Pieces, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each piece's bytes; pieces don't touch unless at a row's edge."""
    if not len(p):
        return np.zeros(0, np.uint64)
    lengths = p.stop - p.start
    table = _table(int(lengths.max()), salt)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    shift = np.repeat(p.start - first, lengths)
    pos = np.arange(total)
    inner = pos - np.repeat(first, lengths)
    out = np.add.reduceat((data[pos + shift].astype(np.uint64) + np.uint64(1)) * table[inner], first)
    return mix(out + lengths.astype(np.uint64) * _GOLD)


def counts(flags: np.ndarray, p: Pieces) -> np.ndarray:
    """How many bytes of each piece have the flag."""
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[p.stop] - run[p.start]


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many items of each row have the flag; row i owns items at[i] to at[i + 1]."""
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[at[1:]] - run[at[:-1]]


def repeats(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: its occurrence number among equal keys of its row, from 0, and whether its key occurs there twice or more."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.bool_)
    k = mix(keys + (row.astype(np.uint64) + np.uint64(1)) * _GOLD)
    order = np.argsort(k, kind="stable")
    s = k[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [n])))
    occurrence = np.empty(n, np.int64)
    occurrence[order] = np.arange(n) - np.repeat(first, size)
    twice = np.empty(n, np.bool_)
    twice[order] = np.repeat(size > 1, size)
    return occurrence, twice


#: Fixed: white space of the word contract, and the symbols it counts.
SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SYMBOL = np.zeros(256, np.bool_)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes of normalised words: ASCII letters and digits, and every byte of a character beyond ASCII.
WORDY = np.zeros(256, np.bool_)
WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(column: pa.Array) -> Texts:
    """The texts in lower case."""
    return Texts(pc.utf8_lower(column.cast(pa.large_string())))
