"""Cross-tokenizer alignment: which ids of one tokenizer (A, byte-level BPE) stand for which of another (B, pieces).

Texts are cut into groups at the byte offsets where tokens of both end. Most groups hold one token of each with the same
bytes; for these an array from A-id to the B-id of the same bytes is made beforehand (``identity``), so that they are counted
by A-id alone, in vectors as long as the vocabulary. Only the links of all other groups are counted as pairs, pre-aggregated
in each task and shuffled by pair.

Texts are split into units, a run of white space with the word after it, where both tokenizers always have a token end. Each
unit is aligned once per worker, many at once; a document is put together from its units. Texts where a unit isn't independent
(white space outside ASCII) are one unit.

Document sums need the corpus-wide counts of their links. Counts of exact links come from the vectors. Pairs that make up
at least 1 / HEAVY of all links, which are at most HEAVY pairs, go to the workers; the links of all other pairs are joined by
pair, and none of those has more than 1 / HEAVY of the links, so that no key of that join is hot.

Defined results: a null or empty text has no tokens, and so has a text whose bytes don't come back from both tokenizers (as
with U+2581 in it): zeros and ''. Repeated rows give a row each and count each; equal or null doc_ids are told apart by row;
ties for the highest count all are best; extra columns are left out; no rows give no rows. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrays import Texts, chunks
from ledgerloom.llm.shared import stored

HEAVY = 100_000  # pairs sent to all workers at most
CACHE_BYTES = 96 << 20  # of aligned units in a worker, about; beyond it the cache starts anew
HELD_PAIRS = 1 << 20  # different pairs a counting task holds before it passes them on
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
# White space that isn't ASCII, or that only some tokenizers take as such.
_ODD = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _byte_letters() -> dict[str, int]:
    """Letters of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    """Bytes of each id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.tokens)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.blob[at]


class Pair:
    """Both tokenizers, the identity map, and all units aligned so far. Lives as long as the worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        added = self.a.get_added_tokens_decoder()

        def of_a(i: int) -> bytes:
            token = self.a.id_to_token(i) or ""
            return token.encode() if i in added else bytes(letters[c] for c in token)

        def of_b(i: int) -> bytes:
            piece = self.b.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

        self.of_a = Vocabulary([of_a(i) for i in range(self.a.get_vocab_size())])
        self.of_b = Vocabulary([of_b(i) for i in range(self.b.get_piece_size())])
        by_bytes: dict[bytes, int] = {}
        for i in range(len(self.of_b)):  # a piece before the byte of the same content
            if self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i):
                continue
            by_bytes.setdefault(self.of_b.tokens[i], i)
        for i in range(len(self.of_b)):
            if self.b.is_byte(i):
                by_bytes.setdefault(self.of_b.tokens[i], i)
        self.identity = np.array([by_bytes.get(t, -1) for t in self.of_a.tokens], dtype=np.int64)
        self.blank = self.b.piece_to_id("▁")
        pieces = [t for i, t in enumerate(self.of_b.tokens) if not self.b.is_byte(i)]
        # Where a unit may begin: blanks that no piece has after something else, other white space that no piece has.
        self.begins = np.zeros(256, dtype=bool)
        self.begins[0x20] = not any(re.search(rb"[^ ] ", t) for t in pieces)
        for c in (0x09, 0x0A):
            self.begins[c] = not any(bytes([c]) in t for t in pieces)
        self.written = [str(i).encode() + s for i in range(len(self.of_a)) for s in (b",", b"|")]
        self.written += [str(i).encode() + s for i in range(len(self.of_b)) for s in (b",", b";")]
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.text: list[bytes] = []
        self.numbers = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, sound
        self.exact, self.exact_cut = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.irregular, self.irregular_cut = np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
        self.held = 0

    def _ids_of_b(self, units: list[str]) -> list[list[int]]:
        """B puts a blank before a text: units that begin with one lose it first, others lose that blank's token."""
        own = [u.startswith(" ") for u in units]
        ids = self.b.encode([u[1:] if o else u for u, o in zip(units, own)], num_threads=1)
        return [i if o and u != " " else [self.blank] if o else i[1:] for i, u, o in zip(ids, units, own)]

    def learn(self, keys: list[int], units: list[bytes]) -> None:
        texts = [u.decode("utf-8", "replace") for u in units]
        batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        ids = [[e.ids for e in batch(texts, add_special_tokens=False)], self._ids_of_b(texts)]
        size = np.array([len(u) for u in units], dtype=np.int64)
        sound = np.ones(len(units), dtype=bool)
        flat, count, joined = [], [], []
        for some, of in zip(ids, (self.of_a, self.of_b)):
            count.append(np.array([len(i) for i in some], dtype=np.int64))
            flat.append(np.fromiter(chain.from_iterable(some), dtype=np.int64, count=int(count[-1].sum())))
            unit = np.repeat(np.arange(len(units)), count[-1])
            sound &= np.bincount(unit, weights=of.length[flat[-1]], minlength=len(units)).astype(np.int64) == size
        for side, of in enumerate((self.of_a, self.of_b)):
            flat[side] = flat[side][np.repeat(sound, count[side])]
            count[side] = np.where(sound, count[side], 0)
            joined.append(of.joined(flat[side]))
        size = np.where(sound, size, 0)
        raw = np.frombuffer(b"".join(u for u, s in zip(units, sound) if s), dtype=np.uint8)
        wrong = np.flatnonzero((joined[0] != raw) | (joined[1] != raw))
        unit_end = np.cumsum(size)
        sound[np.searchsorted(unit_end, wrong, side="right")] = False
        a, b = flat
        end_a, end_b = np.cumsum(self.of_a.length[a]), np.cumsum(self.of_b.length[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        # Between two neighbouring token ends lies one token of each side: one link.
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        group = group_a[at_a]
        single = (np.bincount(group_a, minlength=len(common)) == 1) & (np.bincount(group_b, minlength=len(common)) == 1)
        exact = single[group] & (self.identity[a[at_a]] == b[at_b])
        unit = np.searchsorted(unit_end, ends)
        n = len(units)
        numbers = np.stack([count[0], count[1], np.bincount(np.searchsorted(unit_end, common), minlength=n),
                            np.bincount(unit, minlength=n), sound], axis=1)
        # Written form: the A ids of a group, then its B ids.
        last_a = np.append(group_a[1:] != group_a[:-1], True)[:len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        which = np.concatenate([2 * a + last_a, 2 * (len(self.of_a) + b) + last_b])[order].tolist()
        written = [self.written[i] for i in which]
        cut = np.concatenate([[0], np.cumsum(count[0] + count[1])]).tolist()
        text = [b"".join(written[i:j]) for i, j in zip(cut[:-1], cut[1:])]
        self.place.update(zip(keys, range(len(self.text), len(self.text) + n)))
        self.text += text
        self.numbers = np.concatenate([self.numbers, numbers])
        self.exact = np.concatenate([self.exact, a[at_a[exact]].astype(np.uint32)])
        self.exact_cut = np.concatenate([self.exact_cut, self.exact_cut[-1] + np.cumsum(np.bincount(unit[exact], minlength=n))])
        pairs = a[at_a[~exact]] * len(self.of_b) + b[at_b[~exact]]
        self.irregular = np.concatenate([self.irregular, pairs.astype(np.uint64)])
        self.irregular_cut = np.concatenate([self.irregular_cut,
                                             self.irregular_cut[-1] + np.cumsum(np.bincount(unit[~exact], minlength=n))])
        self.held += sum(map(len, text)) + 12 * len(ends) + 200 * n

    def spans(self, texts: Texts, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, and the number of each text's first unit; ``whole`` texts are one unit."""
        data, n = texts.data, len(texts)
        first = texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]]
        begin = np.zeros(len(data), dtype=bool)
        begin[1:] = self.begins[data[1:]] & ~_WHITE[data[:-1]]
        if whole.any():
            begin &= ~np.repeat(whole, np.diff(texts.offsets))
        begin[first] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data))[:len(starts)], np.searchsorted(starts, texts.offsets[:n + 1])

    def units_of(self, texts: Texts, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the cache of each unit, and the number of each text's first unit."""
        starts, ends, first = self.spans(texts, whole)
        unique, example, of = np.unique(texts.hashes(starts, ends, lower=False), return_index=True, return_inverse=True)
        if self.held > CACHE_BYTES:
            self.clear()
        keys = unique.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            raw = texts.data.tobytes()
            at = example[new]
            self.learn([keys[i] for i in new], [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        get = self.place.__getitem__
        return np.fromiter(map(get, keys), dtype=np.int64, count=len(keys))[of], first


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _taken(flat: np.ndarray, cut: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of the units ``at``, one after the other, and how long each is."""
    size = cut[at + 1] - cut[at]
    source = np.repeat(cut[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return flat[source], size


def _by_document(values: np.ndarray, doc: np.ndarray, n: int, kind: str) -> tuple[list[bytes], list[bytes]]:
    """For each document its different values in order, and how often it has each, as bytes."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(values))).astype("<u4").tobytes()
    raw = values[at].astype(kind).tobytes()
    cut = np.searchsorted(doc[at], np.arange(n + 1)).tolist()
    width = int(kind[-1])
    return ([raw[width * i:width * j] for i, j in zip(cut[:-1], cut[1:])], [times[4 * i:4 * j] for i, j in zip(cut[:-1], cut[1:])])


def _prefixed(text: pa.Array) -> pa.Array:
    """A blank before each text; null and empty texts are empty."""
    text = text.cast(pa.large_string()).fill_null("")
    return pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))


LINKS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "exact binary, exact_times binary, irregular binary, irregular_times binary")


def _aligning(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pair, row = _pair(a_path, b_path), TaskContext.get().partitionId() << 40
        kind = "<u4" if len(pair.of_a) * len(pair.of_b) < 1 << 32 else "<u8"
        for batch in batches:
            for part, _ in chunks(batch, "text"):
                column = _prefixed(part.column(part.schema.get_field_index("text")))
                texts, n = Texts(column), part.num_rows
                whole = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False).astype(bool)
                at, first = pair.units_of(texts, whole)
                doc = np.repeat(np.arange(n), np.diff(first))
                numbers = np.zeros((n, 4), dtype=np.int64)
                sound = np.ones(n, dtype=bool)
                sound[doc[pair.numbers[at, 4] == 0]] = False
                filled = first[:-1] < first[1:]
                if len(at):
                    numbers[filled] = np.add.reduceat(pair.numbers[at, :4], first[:-1][filled], axis=0)
                numbers[~sound] = 0
                exact, size = _taken(pair.exact, pair.exact_cut, at)
                exact_doc = np.repeat(doc, size)
                irregular, size = _taken(pair.irregular, pair.irregular_cut, at)
                irregular_doc = np.repeat(doc, size)
                if not sound.all():
                    keep = sound[exact_doc]
                    exact, exact_doc = exact[keep], exact_doc[keep]
                    keep = sound[irregular_doc]
                    irregular, irregular_doc = irregular[keep], irregular_doc[keep]
                written = list(map(pair.text.__getitem__, at.tolist()))
                cut = first.tolist()
                digest = [hashlib.sha256(b"".join(written[i:j])[:-1]).hexdigest() if good and i < j else ""
                          for i, j, good in zip(cut[:-1], cut[1:], sound.tolist())]
                exact_ids, exact_times = _by_document(exact, exact_doc, n, "<u4")
                pairs, pair_times = _by_document(irregular, irregular_doc, n, kind)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(np.arange(row, row + n)), "doc_id": part.column(part.schema.get_field_index("doc_id")),
                    **{name: pa.array(numbers[:, i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                    "groups_sha256": pa.array(digest, pa.string()), "exact": pa.array(exact_ids, pa.binary()),
                    "exact_times": pa.array(exact_times, pa.binary()), "irregular": pa.array(pairs, pa.binary()),
                    "irregular_times": pa.array(pair_times, pa.binary())})
                row += n
    return run


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: its numbers, the digest of its groups, and its links.

    ``exact``: A-ids of exact one-to-one groups, ``irregular``: all other links as A-id * (number of B-ids) + B-id; each with
    how often the document has it (little-endian unsigned numbers)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _aligning(a_path, b_path), LINKS)


def _read(batch: pa.RecordBatch, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    column = batch.column(batch.schema.get_field_index(name))
    texts = Texts(column)
    return np.frombuffer(texts.data.tobytes(), dtype=kind), np.diff(texts.offsets) // int(kind[-1])


def _counting(n_a: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(n_a, dtype=np.int64)
        keys, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def rows(k, t, exact):
            return pa.RecordBatch.from_pydict({"exact": pa.array(np.full(len(k), exact)), "key": pa.array(k, pa.int64()),
                                               "n": pa.array(t, pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, each = _read(part, "exact", "<u4")[0], _read(part, "exact_times", "<u4")[0]
                vector += np.bincount(ids, weights=each, minlength=n_a).astype(np.int64)  # below 2^53 in a part
                new, each = _read(part, "irregular", kind)[0], _read(part, "irregular_times", "<u4")[0]
                keys, of = np.unique(np.concatenate([keys, new.astype(np.int64)]), return_inverse=True)
                times = np.bincount(of, weights=np.concatenate([times, each]), minlength=len(keys)).astype(np.int64)
                if len(keys) > HELD_PAIRS:
                    yield rows(keys, times, False)
                    keys, times = keys[:0], times[:0]
        some = np.flatnonzero(vector)
        yield rows(some, vector[some], True)
        yield rows(keys, times, False)
    return run


def pair_counts(links: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key (A-id * number of B-ids + B-id), n: corpus-wide links of each pair, best: whether n is the highest of its B-id."""
    pair = _pair(a_path, b_path)
    n_b = len(pair.of_b)
    kind = "<u4" if len(pair.of_a) * n_b < 1 << 32 else "<u8"
    counted = stored(links.select("exact", "exact_times", "irregular", "irregular_times")
                     .mapInArrow(_counting(len(pair.of_a), kind), "exact boolean, key long, n long")
                     .groupBy("exact", "key").agg(F.sum("n").alias("n")), "link-counts")
    identity = links.sparkSession.createDataFrame(
        [(int(i), int(b)) for i, b in enumerate(pair.identity) if b >= 0], "key long, b long").coalesce(1)  # the vocabulary
    vector = (counted.filter("exact").join(F.broadcast(identity), "key")
              .select((F.col("key") * n_b + F.col("b")).alias("key"), "n"))
    total = (counted.filter("NOT exact").select("key", "n").union(vector).groupBy("key").agg(F.sum("n").alias("n"))
             .withColumn("b", F.col("key") % n_b))
    total = stored(total, "pair-counts")
    highest = total.groupBy("b").agg(F.max("n").alias("highest"))  # at most one row for each B-id
    return stored(total.join(F.broadcast(highest), "b").select("key", "n", (F.col("n") == F.col("highest")).alias("best")),
                  "best-counts")


def _lookup(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n, best = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "best"))
    order = np.argsort(key)
    return key[order].astype(np.int64), n[order].astype(np.int64), best[order].astype(bool)


def _find(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(among, keys), max(len(among) - 1, 0))
    return at, among[at] == keys if len(among) else np.zeros(len(keys), dtype=bool)


def _summing(total: np.ndarray, best: np.ndarray, heavy, kind: str, light: bool):
    """Sums of each document over its exact and heavy links; or, ``light``, its other links as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row = part.column(part.schema.get_field_index("row"))
                (key, size), (times, _) = _read(part, "irregular", kind), _read(part, "irregular_times", "<u4")
                key, times, doc = key.astype(np.int64), times.astype(np.int64), np.repeat(np.arange(len(row)), size)
                place, known = _find(key, heavy[0])
                if light:
                    yield pa.RecordBatch.from_pydict({"row": row.take(pa.array(doc[~known])), "key": pa.array(key[~known]),
                                                      "times": pa.array(times[~known])})
                    continue
                sums = np.zeros((2, len(row)), dtype=np.int64)
                place, times, doc = place[known], times[known], doc[known]
                np.add.at(sums[0], doc, times * heavy[2][place])
                np.add.at(sums[1], doc, times * heavy[1][place])
                (ids, size), (times, _) = _read(part, "exact", "<u4"), _read(part, "exact_times", "<u4")
                times, doc = times.astype(np.int64), np.repeat(np.arange(len(row)), size)
                np.add.at(sums[0], doc, times * best[ids])
                np.add.at(sums[1], doc, times * total[ids])
                yield pa.RecordBatch.from_pydict({
                    **{c: part.column(part.schema.get_field_index(c)) for c in
                       ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")},
                    "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})
    return run


def document_sums(links: DataFrame, counts: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``links`` with n_best and count_sum; both tables are read more than once, so from files."""
    pair = _pair(a_path, b_path)
    n_a, n_b = len(pair.of_a), len(pair.of_b)
    kind = "<u4" if n_a * n_b < 1 << 32 else "<u8"
    all_links = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * heavy >= F.lit(all_links)  # at most ``heavy`` pairs
    of_heavy = _lookup(counts.filter(often).toArrow())
    identity = links.sparkSession.createDataFrame(
        [(i * n_b + int(b),) for i, b in enumerate(pair.identity) if b >= 0], "key long").coalesce(1)
    key, n, is_best = _lookup(counts.join(F.broadcast(identity), "key").toArrow())  # at most one for each A-id
    total, best = np.zeros(n_a, dtype=np.int64), np.zeros(n_a, dtype=np.int64)
    total[key // n_b], best[key // n_b] = n, is_best
    sums = links.mapInArrow(
        _summing(total, best, of_heavy, kind, light=False),
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rare = (links.select("row", "irregular", "irregular_times")
            .mapInArrow(_summing(total, best, of_heavy, kind, light=True), "row long, key long, times long")
            .join(counts.filter(~often), "key").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best")))
    return sums.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def align_documents(docs: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document."""
    links = stored(align(docs, a_path, b_path), "links")
    return document_sums(links, pair_counts(links, a_path, b_path), a_path, b_path, heavy)
