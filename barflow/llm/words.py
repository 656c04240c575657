"""Words of Arrow text columns as numpy arrays: bounds, hashes and hashes of word runs.

Used inside ``mapInArrow``: Spark deals the rows, these helpers look at one batch at a time without a Python object per
text or word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so powers can be undone modulo 2**64
_RUN_BASE = 0xD1342543DE82EF95

#: Bytes of one slice of a batch; numpy temporaries take about 40 times as much.
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _STEP)

#: Bytes that are part of a word when words end at ASCII white space only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes that are part of a word made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) > 1 << 22 and n < 1 << 20:  # a very long text has passed
            self.up = self.down = np.ones(1, U64)
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), 1 << 20))
            steps = np.full((2, size), 1, U64)
            steps[:, 1:] = np.array([[self.base], [self.inverse]], U64)
            self.up, self.down = np.cumprod(steps, axis=1, dtype=U64)
        return self.up[:n], self.down[:n]


_BYTES, _RUNS = _Powers(_BASE), _Powers(_RUN_BASE)


@dataclass
class Words:
    """Words of some texts. ``first[d] : first[d + 1]`` are the words of text d; starts and ends are byte positions in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        if not len(self.starts):
            return np.zeros(0, U64)
        up, down = _BYTES.upto(len(self.data))
        total = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE_CODE[self.data] * up, dtype=U64)))
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64) * _STEP)

    def text(self, word: int, last: int) -> bytes:
        """Words ``word .. last - 1`` of one text joined by one space."""
        raw = self.data.tobytes()
        return b" ".join(raw[a:b] for a, b in zip(self.starts[word:last], self.ends[word:last], strict=True))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME) -> Words:
    """Maximal runs of ``letters`` in each row, after mapping bytes by ``fold``."""
    data = fold[data] if fold is not SAME else data
    inside = letters[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``most`` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: workers live on, and executors share a bound."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive entries (k - 1 fewer results than entries)."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    up, down = _RUNS.upto(len(hashes))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * up, dtype=U64)))
    n = len(hashes) - k + 1
    return mix((total[k:] - total[:n]) * down[:n] + U64(k * int(_STEP) & (1 << 64) - 1))


def inner(first: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words fit into their text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return spread(first[:-1], counts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, .. (counts[i] of them), for all i."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a Spark BIGINT column."""
    return pa.array(x.view(np.int64))
