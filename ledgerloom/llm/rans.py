"""Static range asymmetric numeral coding of token ids, vectorised over interleaved lanes.

All blocks share one frequency table, scaled to a power of two with at least 1 for every id, so that a block needs
nothing but the table to be decoded. In a block, id number i belongs to lane i % lanes; each lane has its own 64-bit
state, and the 32-bit words that the lanes shed share one stream. Every ``CHECK_STEPS`` steps the encoder keeps a
checkpoint (the states, and the place in the stream): decoding can begin at any of them.

A block is bytes, all integers little-endian: ``MAGIC``, header of eight 64-bit integers (ids, documents, lanes, steps
between checkpoints, number of checkpoints, words, crc32 of the ids, crc32 of all that follows the header), then the
document ids with a validity byte each, their lengths, the checkpoints' stream places, their states, the words.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"RANSIDS1"
LANES = 1024
CHECK_STEPS = 256
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


class Table:
    """Scaled frequencies of all ids."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        if int(self.freq.sum()) != 1 << self.bits or len(freq) and int(self.freq.min()) < 1:
            raise ValueError("frequencies must be positive and sum to a power of two")
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id of each slot."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to a power of two (at least four times the number of ids), each at least 1."""
    n, total = len(counts), int(counts.sum())
    size = 1 << max(16, (4 * n - 1).bit_length())
    if not total:
        counts, total = np.ones(n, dtype=np.int64), n
    share = counts.astype(np.float64) * (size - n) / total
    freq = 1 + np.floor(share).astype(np.int64)
    rest = size - int(freq.sum())
    freq[np.argsort(np.floor(share) - share, kind="stable")[:max(rest, 0)]] += 1
    if rest < 0:  # rounding of the products
        freq[int(np.argmax(freq))] += rest
    return freq


def encode(ids: np.ndarray, docs: list, lengths: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """One block. ``docs``: document ids (or None), ``lengths``: how many of the ids each has."""
    n = len(ids)
    steps = -(-n // lanes)
    grid = np.zeros(steps * lanes, dtype=np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    checks: list[tuple[int, np.ndarray]] = []
    shed = 0
    for step in range(steps - 1, -1, -1):
        row = grid[step]
        freq, start = table.freq[row], table.start[row]
        full = state >= (freq << top)
        if full.any():
            out = (state[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            words.append(out)
            shed += len(out)
            state[full] >>= _32
        quotient = state // freq
        state = (quotient << bits) + (state - quotient * freq) + start
        if step % CHECK_STEPS == 0:
            checks.append((shed, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, dtype=np.uint32)
    checks.reverse()
    valid = np.array([d is not None for d in docs], dtype=np.uint8)
    body = b"".join([
        np.array([0 if d is None else d for d in docs], dtype="<i8").tobytes(), valid.tobytes(),
        np.asarray(lengths, dtype="<i8").tobytes(),
        np.array([shed - c for c, _ in checks], dtype="<i8").tobytes(),
        b"".join(s.astype("<u8").tobytes() for _, s in checks), stream.astype("<u4").tobytes()])
    head = np.array([n, len(docs), lanes, CHECK_STEPS, len(checks), len(stream),
                     zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()), zlib.crc32(body)], dtype="<i8")
    return MAGIC + head.tobytes() + body


class Block:
    """An encoded block, opened."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        head = np.frombuffer(raw, dtype="<i8", count=8, offset=8)
        self.n, n_docs, self.lanes, self.every, n_checks, n_words, self.crc, body = map(int, head)
        if zlib.crc32(raw[72:]) != body:
            raise ValueError("checksum of a block is wrong")
        at = 72

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        ids, valid = take("<i8", n_docs), take("u1", n_docs)
        self.docs = [int(d) if v else None for d, v in zip(ids, valid)]
        self.lengths = take("<i8", n_docs)
        self.places = take("<i8", n_checks)
        self.states = take("<u8", n_checks * self.lanes).reshape(n_checks, self.lanes)
        self.words = take("<u4", n_words)

    def part(self, check: int, table: Table) -> np.ndarray:
        """The ids from one checkpoint to the next; parts can be decoded in any order, and in parallel."""
        first = check * self.every
        steps = min(self.every, -(-self.n // self.lanes) - first)
        out = np.empty((steps, self.lanes), dtype=np.uint32)
        state, at = self.states[check].astype(np.uint64), int(self.places[check])
        bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
        for step in range(steps):
            slot = state & mask
            row = table.slots[slot.astype(np.int64)]
            out[step] = row
            state = table.freq[row] * (state >> bits) + slot - table.start[row]
            low = state < _LOW
            need = int(np.count_nonzero(low))
            if need:
                state[low] = (state[low] << _32) | self.words[at:at + need]
                at += need
        return out.reshape(-1)[:self.n - first * self.lanes]

    def ids(self, table: Table) -> np.ndarray:
        """All ids, checked."""
        parts = [self.part(c, table) for c in range(len(self.places))]
        out = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("checksum of decoded ids is wrong")
        return out
