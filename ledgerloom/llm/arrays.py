"""Whole-batch text handling with numpy, for the operators that work on Arrow batches.

Texts of a batch lie one after the other in one byte buffer. Words are found and hashed for the whole buffer at once;
a hash of a short byte span is the difference of two prefix sums, so that words and prefixes cost the same; spans beyond
32 bytes are hashed by blocks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # text handled at once; bounds the memory of a task, not what it handles
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library


def release() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_kept: dict[str, Callable[[], None]] = {}


def keep_only(owner: str, clear: Callable[[], None]) -> None:
    """Say that ``owner`` keeps things in this worker, which ``clear`` drops; what others kept goes now.

    Workers live on from one operator to the next: without this the caches of all stages of a pipeline add up.
    """
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        release()
    _kept[owner] = clear


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LONG_SPAN = 32  # bytes; a polynomial modulo 2^64 loses bits on longer regular strings (Thue-Morse words)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=U64)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


class Texts:
    """A run of whole texts: ``data`` holds their bytes, text i is data[offsets[i]:offsets[i + 1]]; a null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        column = column.fill_null(b"") if column.null_count else column
        size = len(column)
        raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + size + 1]
        first, last = (int(raw[0]), int(raw[-1])) if size else (0, 0)
        buffer = column.buffers()[2]
        self.data = (np.frombuffer(buffer, dtype=np.uint8)[first:last] if buffer is not None and last > first
                     else np.empty(0, dtype=np.uint8))
        self.offsets = raw - first if size else np.zeros(1, dtype=np.int64)
        self._sums: np.ndarray | None = None
        self._padded: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, of: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the number of the first word (one more entry at the end).

        ``of``: which bytes words are made of."""
        inside = of[self.data]
        filled = self.offsets[:-1] < self.offsets[1:]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[self.offsets[:-1][filled]] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[self.offsets[1:][filled] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """64-bit hashes of byte spans, A-Z taken as a-z if ``lower`` (the same for all calls on one object)."""
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.data) + 1, dtype=U64)
                each = (_BYTE_LOWER if lower else _BYTE)[self.data]
                each *= _power(_BASE, len(self.data))
                np.cumsum(each, out=self._sums[1:])
            spans = (self._sums[ends] - self._sums[starts]) * _power(_INVERSE, len(self.data) + 1)[starts]
            out = mix(spans + (ends - starts).astype(U64) * U64(_ODD))
            long = np.flatnonzero(ends - starts > _LONG_SPAN)
            if len(long):
                out[long] = self._long_hashes(starts[long], ends[long], lower)
            return out

    def _long_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """Hashes of long spans: blocks of 8 bytes, each mixed with its place in the span, added up."""
        if self._padded is None:
            self._padded = np.concatenate([_LOWER[self.data] if lower else self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=self._padded, strides=(1,))
        blocks = (ends - starts + 7) // 8
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        at = np.repeat(starts, blocks) + 8 * place
        left = np.minimum(np.repeat(ends, blocks) - at, 8).astype(U64)
        found = eight[at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(found ^ mix((place + 1).astype(U64) * U64(_ODD))), first)
            return mix(total + (ends - starts).astype(U64) * U64(_ODD))


def hash_of(text: str | bytes) -> int:
    """The hash that ``Texts.hashes`` gives this span (lower-cased A-Z)."""
    raw = text.encode() if isinstance(text, str) else text
    texts = Texts(pa.array([raw], type=pa.large_binary()))
    return int(texts.hashes(np.array([0]), np.array([len(raw)]))[0])


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch with at most ``limit`` bytes of text each; a longer text makes a slice of its own."""
    texts = Texts(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(texts.offsets, texts.offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        part = batch.slice(start, stop - start)
        yield part, Texts(part.column(part.schema.get_field_index(column)))
        start = stop
    del texts
    release()


def sum_by(ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``ids`` in 0 .. n-1."""
    return np.bincount(ids, weights=values, minlength=n)
