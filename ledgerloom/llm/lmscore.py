"""LM scoring with a log-frequency Bloom filter.

Counts are quantised to levels; an n-gram of level L is stored as L entries (n-gram, 1) .. (n-gram, L) in a Bloom
filter. A count is read back by probing (n-gram, 1), (n-gram, 2), ... until one is missing. The filter is cut into
segments by n-gram hash. Each segment is built by one task from the counts of its n-grams, and holds a bounded number of
entries. Segments are broadcast in parts that the driver fetches one after the other, up to ``broadcast_mb`` for one pass
over the texts; if there are more, texts are scored in several passes, each of which handles the tokens whose context lies in its segments, and the sums are added.

Smoothing is a bigram model over an add-``alpha`` unigram model,
``p(w | h) = (c(h w) + mu p(w)) / (c(h) + mu)``. Stored counts are lower bounds of their level and the context count is
an upper bound, so that the probabilities of a context never sum to more than 1 (up to false positives of the filter).

Defined results: a null text is empty and has only the end token; repeated rows are scored and counted each; with no
training rows every count is 0 and the probabilities are uniform over one unseen type; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrays import U64, chunks, mix, release, sum_by
from ledgerloom.llm.shared import fold, stored

ALPHA = 0.1
MU = 300.0
BITS = 9  # of the filter for each entry
HASHES = 6
SEGMENT_BYTES = 24 << 20  # text that one segment's n-grams come from
FLUSH_TOKENS = 1_500_000
BUILD_KEYS = 500_000  # whose entries are set at once
BROADCAST_MB = 256
PART_MB = 48  # of a broadcast; the driver holds no more than one at once
END, START = U64(0x5DEECE66D1234567), U64(0x2545F4914F6CDD1D)
_GROWTH = 1.2


def _levels() -> np.ndarray:
    """Smallest count of each level: steps of one, then of a fifth."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * _GROWTH)))
    return np.array(out, dtype=np.int64)


LEVELS = _levels()


def sequences(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text closed by END; hashes of the contexts; the text of each token."""
    starts, ends, first = texts.words()
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(first))
    token = np.full(len(starts) + n, END, dtype=U64)
    token[np.arange(len(starts)) + doc] = texts.hashes(starts, ends)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first[:-1] + np.arange(n)] = START
    return token, context, np.repeat(np.arange(n), np.diff(first) + 1)


def pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * U64(0xA24BAED4963EE407) + token)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> U64(33)) % U64(segments)).astype(np.int64)


def _start(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """The hash of an entry: its upper half picks a block of the segment, then nine bits pick each place in the block."""
    with np.errstate(over="ignore"):
        return mix(keys + np.asarray(level, dtype=U64) * U64(0x9FB21C651E98DF25))


def _block(hashed: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """First bit of the block of a hash, of a number of blocks below 2**32."""
    return ((((hashed >> U64(32)) * np.asarray(blocks, dtype=U64)) >> U64(32)) << U64(9)).astype(np.int64)


def _inner(hashed: np.ndarray) -> Iterator[np.ndarray]:
    """The places in a block of 512 bits, one cache line."""
    with np.errstate(over="ignore"):
        more = mix(hashed + U64(0x632BE59BD9B4E019))
    for i in range(HASHES):
        yield ((more >> U64(9 * i)) & U64(511)).astype(np.int64)


class Filter:
    """Segments of a log-frequency Bloom filter, laid out one after the other."""

    def __init__(self, bits: dict[int, tuple[int, bytes]], segments: int):
        self.segments, self.size, self.offset = segments, np.full(segments, 512, dtype=np.int64), np.zeros(segments, np.int64)
        parts, at = [], 0
        for s, (size, raw) in sorted(bits.items()):
            self.size[s], self.offset[s] = size, at
            parts.append(np.frombuffer(raw, dtype=np.uint8))
            at += len(raw) * 8
        self.held = np.zeros(segments, dtype=bool)
        self.held[list(bits)] = True
        self.bits = np.concatenate(parts) if parts else np.zeros(1, dtype=np.uint8)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key: the number of entries found before the first that is missing."""
        out = np.zeros(len(keys), dtype=np.int64)
        seg = segment_of(keys, self.segments)
        alive = np.flatnonzero(self.held[seg])
        blocks, offset = (self.size[seg[alive]] >> 9).astype(U64), self.offset[seg[alive]]
        j = 1
        while len(alive):
            hashed = _start(keys[alive], j)
            line = _block(hashed, blocks) + offset
            found = np.ones(len(alive), dtype=bool)
            for inner in _inner(hashed):
                inner += line
                found &= (self.bits[inner >> 3] >> (inner & 7).astype(np.uint8)) & 1 == 1
            alive, blocks, offset = alive[found], blocks[found], offset[found]
            out[alive] = j
            j += 1
        return out


def build_bits(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """The bits of one segment: (number of bits, packed bits)."""
    levels = np.searchsorted(LEVELS, counts, side="right").astype(np.uint8)
    size = (1 + BITS * int(levels.sum(dtype=np.int64)) // 512) * 512
    bits = np.zeros(size, dtype=bool)
    for at in range(0, len(keys), BUILD_KEYS):  # entries of some keys at once, so that the bits are the largest array
        level = levels[at:at + BUILD_KEYS].astype(np.int64)
        entry = np.repeat(keys[at:at + BUILD_KEYS], level)
        number = np.arange(len(entry)) - np.repeat(np.cumsum(level) - level, level) + 1
        hashed = _start(entry, number)
        line = _block(hashed, size >> 9)
        for inner in _inner(hashed):
            bits[line + inner] = True
    return size, np.packbits(bits, bitorder="little").tobytes()


def merged_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if not keys:
        return np.empty(0, U64), np.empty(0, np.int64)
    flat = np.concatenate(keys)
    order = np.argsort(flat)
    flat = flat[order]
    new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[new], np.add.reduceat(np.concatenate(counts)[order], new, dtype=np.int64)


def lower_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, LEVELS[np.maximum(level, 1) - 1], 0).astype(np.float64)


def upper_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, LEVELS[level] - 1, 0).astype(np.float64)


def _count(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush():
            for kind in (0, 1):
                keys, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                order = np.argsort(segment_of(keys, segments), kind="stable")
                keys, counts = keys[order], counts[order].astype(np.uint32)
                cut = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
                some = [s for s in range(segments) if cut[s] < cut[s + 1]]
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array(some, pa.int32()), "kind": pa.array([kind] * len(some), pa.int32()),
                    "keys": pa.array([keys[cut[s]:cut[s + 1]].tobytes() for s in some], pa.binary()),
                    "counts": pa.array([counts[cut[s]:cut[s + 1]].tobytes() for s in some], pa.binary())})
                held[kind].clear()

        n = 0
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                token, context, _ = sequences(texts)
                held[0].append(token)
                held[1].append(pair(context, token))
                # the start symbol is a context of every text
                held[0].append(np.full(len(texts), START, dtype=U64))
                n += len(token)
                if n >= FLUSH_TOKENS:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()
    return run


def _segment(table: pa.Table) -> pa.Table:
    kinds = np.array(table.column("kind").to_pylist())
    merged = []
    for kind in (0, 1):
        rows = np.flatnonzero(kinds == kind)
        keys = [np.frombuffer(table.column("keys")[int(r)].as_buffer(), dtype=U64) for r in rows]
        counts = [np.frombuffer(table.column("counts")[int(r)].as_buffer(), dtype=np.uint32) for r in rows]
        merged.append(merged_counts(keys, counts))
        del keys, counts
        release()
    (words, n_words), (pairs, n_pairs) = merged
    size, bits = build_bits(np.concatenate([words, pairs]), np.concatenate([n_words, n_pairs]))
    real = words != START
    release()
    return pa.table({
        "segment": pa.array([table.column("segment")[0].as_py()], pa.int32()), "size": pa.array([size], pa.int64()),
        "bits": pa.array([bits], pa.binary()), "words": pa.array([words[real].tobytes()], pa.binary()),
        "counts": pa.array([n_words[real].tobytes()], pa.binary()),
        "tokens": pa.array([int(n_words[real].sum())], pa.int64()), "types": pa.array([int(real.sum())], pa.int64()),
        "bytes": pa.array([len(bits) + 12 * len(words)], pa.int64())})


_COUNTED = "segment int, kind int, keys binary, counts binary"
_SEGMENTS = "segment int, size long, bits binary, words binary, counts binary, tokens long, types long, bytes long"


def train(docs: DataFrame) -> tuple[DataFrame, int]:
    """The filter's segments (with exact word counts) for the texts of ``docs``, and how many segments there are."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 + size // SEGMENT_BYTES
    counted = docs.select("text").mapInArrow(_count(segments), _COUNTED)
    return stored(counted.groupBy("segment").applyInArrow(_segment, _SEGMENTS), "lm-segments"), segments


def _level(parts: list, keys: np.ndarray) -> np.ndarray:
    """Level of each key, 0 where no part holds its segment; a segment is in one part."""
    out = np.zeros(len(keys), dtype=np.int64)
    for model, _, _ in parts:
        out += model.level(keys)
    return out


def _score(held: list, total_tokens: int, total_types: int, alpha: float, mu: float, final: bool):
    """One pass over the texts: add what the broadcast segments know to each token's levels (of word, context and pair)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x.value for x in held]
        scale = total_tokens + alpha * (total_types + 1)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                token, context, doc = sequences(texts)
                n = len(texts)
                column = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
                unique, place = np.unique(token, return_inverse=True)
                exact, mine = np.zeros(len(unique)), np.zeros(len(unique), dtype=bool)
                for model, words, counts in parts:
                    here = np.flatnonzero(model.held[segment_of(unique, model.segments)])
                    mine[here] = True
                    if len(words):
                        at = np.minimum(np.searchsorted(words, unique[here]), len(words) - 1)
                        found = words[at] == unique[here]
                        exact[here[found]] = counts[at[found]]
                base = np.where(mine, np.log10((exact + alpha) / scale), 0.0)[place]
                known = ((exact > 0) & mine)[place]
                grams, gram = np.unique(pair(context, token), return_inverse=True)
                heads, head = np.unique(context, return_inverse=True)
                levels = np.stack([_level(parts, unique)[place], _level(parts, heads)[head], _level(parts, grams)[gram]], axis=1)
                before = b"".join(column["levels"].to_pylist())
                if before:
                    levels = np.maximum(levels, np.frombuffer(before, dtype=np.uint8).reshape(-1, 3))
                lower = (lower_count(levels[:, 0]) + alpha) / scale
                seen = lower_count(levels[:, 2])
                above = np.maximum(upper_count(levels[:, 1]), seen)
                logp = np.log10((seen + mu * lower) / (above + mu))
                n_tokens = sum_by(doc, np.ones(len(token)), n).astype(np.int64)
                out = {
                    "doc_id": column["doc_id"], "held_out": column["held_out"], "n_tokens": pa.array(n_tokens),
                    "n_known": pa.array(sum_by(doc, known, n).astype(np.int64) + column["n_known"].to_numpy()),
                    "base_score": pa.array(sum_by(doc, base, n) + column["base_score"].to_numpy())}
                if final:
                    out["score"] = pa.array(sum_by(doc, logp, n))
                else:
                    cut = np.concatenate([[0], np.cumsum(n_tokens)])
                    packed = levels.astype(np.uint8)
                    out["levels"] = pa.array([packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
                    out["text"] = column["text"]
                yield pa.RecordBatch.from_pydict(out)
    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"


def _model(segments: DataFrame, number: int):
    """The filter of these segments and their exact word counts, fetched one partition at a time."""
    bits, words, counts = {}, [np.empty(0, U64)], [np.empty(0, np.uint32)]
    for r in segments.select("segment", "size", "bits", "words", "counts").toLocalIterator():
        bits[r["segment"]] = (r["size"], r["bits"])
        words.append(np.frombuffer(r["words"], dtype=U64))
        exact = np.frombuffer(r["counts"], dtype=np.int64)
        counts.append(exact.astype(np.uint32) if not len(exact) or exact.max() < 1 << 32 else exact)
    model = Filter(bits, number)
    bits.clear()
    known, number_of = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(known)
    return model, known[order], number_of[order]


def _broadcast(segments: DataFrame, number: int):
    held = segments.sparkSession.sparkContext.broadcast(_model(segments, number))
    release()
    return held


def _packed(rows: list, limit: int) -> list[list]:
    """Runs of ``rows`` of at most ``limit`` bytes; a larger row is a run of its own."""
    out, room = [[]], limit
    for r in rows:
        if out[-1] and r["bytes"] > room:
            out.append([])
            room = limit
        out[-1].append(r)
        room -= r["bytes"]
    return out


def score(docs: DataFrame, segments: DataFrame, number: int, alpha: float = ALPHA, mu: float = MU,
          broadcast_mb: int = BROADCAST_MB) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text, held_out): one pass for each ``broadcast_mb`` of filter.

    Levels found so far travel with the row from pass to pass; the last pass turns them into probabilities.
    """
    spark = docs.sparkSession
    sizes = segments.select("segment", "bytes", "tokens", "types").orderBy("segment").collect()  # a row per segment
    tokens, types = sum(r["tokens"] for r in sizes), sum(r["types"] for r in sizes)
    groups = [_packed(group, PART_MB << 20) for group in _packed(sizes, broadcast_mb << 20)]
    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text", F.lit(0).cast("long").alias("n_known"),
                       F.lit(0.0).alias("base_score"), F.lit(b"").alias("levels"))
    for i, group in enumerate(groups):
        final = i == len(groups) - 1
        held = [_broadcast(segments.filter(F.col("segment").isin([r["segment"] for r in part])), number) for part in group]
        rows = rows.mapInArrow(_score(held, tokens, types, alpha, mu, final),
                               _SCORED + (", score double" if final else ", levels binary, text string"))
        if not final:
            rows = stored(rows, "lm-pass")
            for x in held:
                x.unpersist()
    return rows.withColumn("train_tokens", F.lit(tokens).cast("long"))


def score_documents(docs: DataFrame, folds: int = 10, **options) -> DataFrame:
    """Train on the rows whose fold is not 0 and score all rows."""
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    segments, number = train(rows.filter(~F.col("held_out")))
    return score(rows, segments, number, **options)
