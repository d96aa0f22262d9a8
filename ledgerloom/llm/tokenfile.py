"""Token files: texts to token ids, ids to coded blocks, and back.

``tokenize`` makes the ids, ``write_files`` puts them in ascending doc_id order into blocks of whole documents
(``rans``: shared frequencies, interleaved lanes, checkpoints, checksums) and writes a folder with three Parquet data
sets: ``blocks`` (one coded block a row), ``index`` (where each block begins) and ``table`` (the frequencies).
``read_files`` decodes them, each block on its own.

The tokenizer splits texts at white space before it merges, so that the ids of a text are those of its white-space units
one after the other. Units are told apart by hash for a whole batch; only units that a worker has not met are given to
the tokenizer, many at once. Texts where a unit isn't independent (white space outside ASCII, special token strings) go
through the tokenizer whole.

Defined results: a null text is empty; every document has the end id; repeated rows are written each; equal doc_ids lie
together in order of length and content; a null doc_id comes first; no rows make files without blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import rans
from ledgerloom.llm.arrays import U64, chunks, keep_only
from ledgerloom.llm.shared import scratch

END_ID = 2
BLOCK_IDS = 1 << 20
PARTITION_BYTES = 32 << 20  # of ids, for one task that codes blocks
CACHE_UNITS = 1_000_000  # of a worker; beyond it the cache starts anew
_SPACE = 0x20
_ODD_UNIT = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Units:
    """Ids of white-space units, by hash. Lives as long as the worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self._whole("\n")
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, dtype=U64)  # in order; a dictionary of as many numbers takes eight times the memory
        self.places = np.empty(0, dtype=np.uint32)
        self.start = np.empty(0, dtype=np.uint32)
        self.count = np.empty(0, dtype=np.int32)  # -1: not independent
        self.ids = np.empty(0, dtype=np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without places of the tokens
        return np.array(many([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def odd(self, unit: str) -> bool:
        return bool(_ODD_UNIT.search(unit)) or any(s in unit for s in self.special)

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        """Tokenize new units: words many at once with a newline between them, units of white space one by one."""
        ids: list[np.ndarray] = []
        count = np.zeros(len(units), dtype=np.int64)
        for at in range(0, len(units), 2000):
            some = units[at:at + 2000]
            odd = [self.odd(u) for u in some] if self.odd("\n".join(some)) else [False] * len(some)
            words = [i for i, (u, o) in enumerate(zip(some, odd)) if not o and not u.isspace()]
            found = self._whole("\n".join([some[i] for i in words])) if words else np.empty(0, dtype=np.uint32)
            cut = np.flatnonzero(found == self.newline[0])
            if len(words) == len(some) == len(cut) + 1 and len(self.newline) == 1:  # words alone, the usual case
                count[at:at + len(some)] = np.diff(np.concatenate([[-1], cut, [len(found)]])) - 1
                ids.append(np.delete(found, cut))
                continue
            joined = len(words) == len(cut) + 1 and len(self.newline) == 1  # else a vocabulary without a lone newline
            pieces = dict(zip(words, np.split(np.delete(found, cut), cut - np.arange(len(cut))))) if joined else {}
            for i, unit in enumerate(some):
                own = np.empty(0, dtype=np.uint32) if odd[i] else pieces[i] if i in pieces else self._whole(unit)
                count[at + i] = -1 if odd[i] else len(own)
                ids.append(own)
        size = np.maximum(count, 0)
        start = (len(self.ids) + np.cumsum(size) - size).astype(np.uint32)
        self.ids = np.concatenate([self.ids, *ids])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.places = np.insert(self.places, at, (len(self.start) + order).astype(np.uint32))
        self.start = np.concatenate([self.start, start])
        self.count = np.concatenate([self.count, count.astype(np.int32)])

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is new."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.places[at].astype(np.int64), -1)


@lru_cache(maxsize=2)
def _units(path: str) -> Units:
    return Units(path)


def unit_spans(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and for each text the number of its first one.

    Units: a word with the one blank before it, if there is one; of white space between words, all but its last byte,
    and that byte if it is no blank; white space at the end of a text.
    """
    starts, ends, first = texts.words()
    n_words = len(starts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    gap = texts.offsets[:-1][doc].copy()  # where the white space before each word begins
    if n_words:
        gap[1:] = np.where(doc[1:] == doc[:-1], ends[:-1], gap[1:])
    blank = np.zeros(n_words, dtype=bool)
    some = starts > gap
    blank[some] = texts.data[starts[some] - 1] == _SPACE
    tail = texts.offsets[:-1].copy()  # white space at the end of each text
    filled = first[1:] > first[:-1]
    tail[filled] = ends[first[1:][filled] - 1]
    word_from = starts - blank
    last = np.where(some & ~blank, starts - 1, starts)  # where a last byte of white space begins that stands alone
    many = word_from - gap > (~blank & some)
    pieces = [(word_from, ends, doc), (gap[many], np.where(blank, starts - 1, last)[many], doc[many])]
    alone = some & ~blank
    pieces.append((last[alone], starts[alone], doc[alone]))
    rest = tail < texts.offsets[1:]
    pieces.append((tail[rest], texts.offsets[1:][rest], np.flatnonzero(rest)))
    a, b, d = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(a, kind="stable")
    a, b, d = a[order], b[order], d[order]
    return a, b, np.searchsorted(d, np.arange(len(texts) + 1))


def ids_of(texts, units: Units, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each closed by ``end_id``; and how many each has."""
    start, end, first = unit_spans(texts)
    keys = texts.hashes(start, end, lower=False)
    unique, example, place = np.unique(keys, return_index=True, return_inverse=True)
    known = units.look_up(unique)
    new = np.flatnonzero(known < 0)
    if len(new):
        if len(units.keys) + len(new) > CACHE_UNITS:
            units.clear()
            new = np.arange(len(unique))
        raw = texts.data.tobytes()
        known[new] = np.arange(len(units.start), len(units.start) + len(new))
        units.learn(unique[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(
            start[example[new]].tolist(), end[example[new]].tolist())])
    at = known[place]
    count = units.count[at].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    odd = np.unique(doc[count < 0])
    count = np.where(count < 0, 0, count)
    if len(odd):
        whole = np.zeros(len(texts), dtype=bool)
        whole[odd] = True
        count = np.where(whole[doc], 0, count)
    # ids of the units, then room for the end id of each text
    total = np.concatenate([[0], np.cumsum(count)])
    per_doc = total[first[1:]] - total[first[:-1]]
    source = np.repeat(units.start[at].astype(np.int64) - total[:-1], count) + np.arange(total[-1])
    flat = units.ids[source] if len(source) else np.empty(0, dtype=np.uint32)
    if len(odd):
        raw = texts.data.tobytes()
        pieces = []
        for i in range(len(texts)):
            if whole[i]:
                pieces.append(units._whole(raw[texts.offsets[i]:texts.offsets[i + 1]].decode("utf-8", "replace")))
                per_doc[i] = len(pieces[-1])
            else:
                pieces.append(flat[total[first[i]]:total[first[i + 1]]])
        flat = np.concatenate(pieces)
    out = np.full(len(flat) + len(texts), end_id, dtype=np.uint32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), per_doc)] = flat
    return out, per_doc + 1


def _tokenizing(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("tokenfile", _units.cache_clear)
        units = _units(path)
        kind = "<u2" if max(units.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, count = ids_of(texts, units, end_id)
                cut = np.concatenate([[0], np.cumsum(count)]) * int(kind[-1])
                raw = ids.astype(kind).tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(part.schema.get_field_index("doc_id")), "n": pa.array(count, pa.int64()),
                    "ids": pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())})
    return run


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n (number of ids with the end id), ids (little-endian, 2 bytes each where the vocabulary allows)."""
    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(_tokenizing(tokenizer_path, end_id), "doc_id long, n long, ids binary"))


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for raw, n in zip(batch.column("ids"), batch.column("n")):
            found = np.bincount(_ids(raw.as_buffer(), n.as_py()))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), dtype=np.int64)])
            total[:len(found)] += found
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int64()), "count": pa.array(total[some], pa.int64())})


def _coding(freq: np.ndarray, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        table, number = rans.Table(freq), 0
        part = TaskContext.get().partitionId()
        docs, ids, lengths, held = [], [], [], 0

        def block():
            flat = np.concatenate(ids)
            raw = rans.encode(flat, docs, np.array(lengths), table)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()),
                "n_ids": pa.array([len(flat)], pa.int64()), "coded": pa.array([raw], pa.binary())})

        for batch in batches:
            for doc, n, raw in zip(batch.column("doc_id"), batch.column("n"), batch.column("ids")):
                docs.append(doc.as_py())
                lengths.append(n.as_py())
                ids.append(_ids(raw.as_buffer(), lengths[-1]).copy())  # else the whole batch stays
                held += lengths[-1]
                if held >= block_ids:
                    yield block()
                    number += 1
                    docs, ids, lengths, held = [], [], [], 0
        if docs:
            yield block()
    return run


def write_files(tokens: DataFrame, path: str, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
    """Code ``tokens`` (doc_id, n, ids; read more than once, so from a file) into the folder ``path``."""
    spark = tokens.sparkSession
    counts = np.zeros(vocabulary, dtype=np.int64)
    for row in tokens.select("n", "ids").mapInArrow(_histogram, "id long, count long").groupBy("id").agg(
            F.sum("count").alias("count")).collect():  # at most one row for each id of the vocabulary
        counts[row["id"]] = row["count"]
    freq = rans.scaled(counts)
    spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(freq)], "id long, freq long").coalesce(1).write.parquet(
        f"{path}/table")
    parts = max(1, int(2 * counts.sum()) // PARTITION_BYTES + 1)
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    (ordered.mapInArrow(_coding(freq, block_ids), "part int, block int, n_ids long, coded binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    base = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    (blocks.withColumn("ahead", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(base, "part")
     .select("part", "block", (F.col("base") + F.col("ahead")).alias("start")).write.parquet(f"{path}/index"))


def _decoding(freq: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for batch in batches:
            for raw, begin in zip(batch.column("coded"), batch.column("start")):
                block = rans.Block(raw.as_buffer().to_pybytes())
                ids = block.ids(table).astype("<u4")
                cut = np.concatenate([[0], np.cumsum(block.lengths)])
                pieces = [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
                out = {"doc_id": pa.array(block.docs, pa.int64()), "start": pa.array(cut[:-1] + begin.as_py(), pa.int64()),
                       "n_tokens": pa.array(block.lengths, pa.int64())}
                if digest:
                    out["ids_crc32"] = pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())
                else:
                    out["ids"] = pa.array(pieces, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
    return run


def read_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Decode a folder: doc_id, start, n_tokens and the ids (or, with ``digest``, their crc32)."""
    freq = np.array([r["freq"] for r in spark.read.parquet(f"{path}/table").orderBy("id").collect()])  # the vocabulary
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/index"), ["part", "block"])
    return blocks.select("coded", "start").mapInArrow(
        _decoding(freq, digest),
        "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))


def vocabulary_size(tokenizer_path: str, end_id: int = END_ID) -> int:
    from tokenizers import Tokenizer
    return max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write all documents to token files and give the digest of what is read back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    tokenize(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(f"{path}/tokens")
    write_files(spark.read.parquet(f"{path}/tokens"), path, vocabulary_size(tokenizer_path, end_id))
    return read_files(spark, path, digest=True)
