"""Whole texts as byte blocks inside Arrow batches, with hashes of any substring in constant time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_RNG = np.random.default_rng(20_240_607)
_BYTE_CODE = (_RNG.integers(1, 1 << 62, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    if count:
        factors[0] = 1
    return np.cumprod(factors)


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest block met."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            self.up, self.down = _powers(_BASE, count), _powers(_INVERSE, count)
        return self.up, self.down


_POWERS = _Powers()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Hasher:
    """64-bit hashes of substrings of a sequence, by prefix sums of powers."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self._down = _POWERS.get(len(codes) + 1)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each ``[start, end)``; equal contents give equal hashes wherever they stand."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of a fixed size."""
        count = max(0, len(self._sums) - size)
        return mix((self._sums[size : size + count] - self._sums[:count]) * self._down[:count])


@dataclass
class Block:
    """Consecutive texts of a batch: their bytes end to end and where each one begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of about ``limit`` bytes; a longer text is a block of its own.

    Null texts count as empty. Nothing is cut off: every byte is in exactly one block.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield Block(first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def code(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def solid(data: np.ndarray) -> np.ndarray:
    """Which bytes are not ASCII white space."""
    return ~_SPACE[data]


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, a run of bytes that are not ASCII white space.

    UTF-8 never uses those bytes inside a longer character, so the runs are the words of the text.
    """
    inner = solid(block.data)
    size = len(inner)
    fresh = np.zeros(size + 1, bool)
    fresh[block.offsets] = True
    before = np.zeros(size, bool)
    before[1:] = inner[:-1]
    start = np.flatnonzero(inner & (fresh[:size] | ~before))
    after = np.zeros(size, bool)
    after[:-1] = inner[1:]
    end = np.flatnonzero(inner & (fresh[1:] | ~after)) + 1
    return start, end, block.row_of(start)


def concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
