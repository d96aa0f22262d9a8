"""Toxicity of documents: disguised words are restored, then words and word beginnings are weighed.

Learned here, from all labelled rows outside the held-out fold: a character model of the words (for the Viterbi decoding),
weights of features, and a logistic curve. Features are whole words and their first 4, 5 and 6 bytes, by hash; a feature's weight is the lower bound of its log odds, and it is kept if that is
clear (at most ``FEATURES``, the clearest). A document is described by its largest weight, the number of words with a
weight, and the sum of those; the curve over these is fitted on the quarter of the labelled rows that the weights haven't seen,
with its sums added up in the tasks.
Labels and ids decide only which rows are learned from.

Defined results: a null text is empty and gets the score of a text without known words; a null doc_id is in the fold of an empty
text; labels that are null don't count, of several for a doc_id the largest does; without labels the score is 0 for
all; repeated rows are scored each; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrays import U64, Texts, chunks, keep_only, sum_by
from ledgerloom.llm.deobfuscate import CharModel, disguised, doubtful, one_word, pieces, reading, restore, trigrams
from ledgerloom.llm.shared import fold, stored

FEATURES = 50_000
PREFIXES = (4, 5, 6)
CLEAR = 1.0  # least lower bound of log odds
LEAST = 3  # toxic documents with a feature
MARKS, MOST_MARKS = 16, 1 << 27  # bits for each labelled id in the filter before the join, and in all
_MARK_BLOCK = 8 * 4096  # bits of a row of ``bitmap_construct_agg``
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _hashes(texts: Texts, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (a row for the word and each beginning; 0 where it is too short), and the text of each."""
    starts, ends, first = texts.words(of)
    whole = texts.hashes(starts, ends)
    rows = [whole] + [np.where(ends - starts > p, texts.hashes(starts, np.minimum(starts + p, ends)) ^ U64(p), U64(0))
                      for p in PREFIXES]
    return np.stack(rows), np.repeat(np.arange(len(texts)), np.diff(first))


@lru_cache(maxsize=4)
def _decoder(grams: tuple):
    keep_only("toxicity", _decoder.cache_clear)
    model = CharModel(dict(grams))
    cached = lru_cache(maxsize=100_000)
    return (cached(lambda word: restore(word, model)), cached(lambda word: reading(word, model)),
            cached(lambda *parts: one_word(parts, model)))


def word_features(texts: Texts, grams: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the restored forms of disguised ones, and the text of each."""
    found, doc = _hashes(texts, _WORD)
    decode, read, _ = _decoder(grams)
    hidden = [(d, decode(w.decode("utf-8", "replace")).encode()) for d, w in disguised(texts)]
    hidden += [(d, x.encode()) for d, w in doubtful(texts) if (x := read(w.decode("utf-8", "replace")))]
    if hidden:
        clear = Texts(pa.array([w for _, w in hidden], pa.large_binary()))
        more, which = _hashes(clear, _WORD)
        found = np.concatenate([found, more], axis=1)
        doc = np.concatenate([doc, np.array([d for d, _ in hidden])[which]])
    return found, doc


def joined_features(texts: Texts, grams: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes among ``keys`` (sorted) of pieces set apart that are one word to the character model, and the text of each."""
    may = np.zeros(1 << 20, dtype=bool)
    may[(keys >> U64(44)).astype(np.int64)] = True
    together = _decoder(grams)[2]
    raw, found, doc = texts.data.tobytes(), [], []
    for joined, begin, stop, word, n, head, owner, (starts, ends) in pieces(texts, _WORD):
        for p in (0, *PREFIXES):
            here = np.flatnonzero((stop - begin > p) & (head < p) if p else stop > begin)
            h = joined.hashes(begin[here], begin[here] + p if p else stop[here]) ^ U64(p)
            some = may[(h >> U64(44)).astype(np.int64)]
            here, h = here[some], h[some]
            some = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            for i, x in zip(here[some], h[some]):
                at = range(word[i], word[i] + n)
                if together(*(raw[starts[j]:ends[j]].decode("utf-8", "replace") for j in at)):
                    found.append(x)
                    doc.append(owner[i])
    return np.array(found, dtype=U64), np.array(doc, dtype=np.int64)


def _counting_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    for batch in batches:
        for _, texts in chunks(batch, "text"):
            starts, ends, _first = texts.words(_WORD)
            _, at, count = np.unique(texts.hashes(starts, ends), return_index=True, return_counts=True)
            raw = texts.data.tobytes()
            for i, n in zip(at, count):
                word = raw[starts[i]:ends[i]].decode("utf-8", "replace").lower()
                if word.isalpha():
                    words.update(dict.fromkeys(trigrams(word), int(n)))
    yield pa.RecordBatch.from_pydict({"gram": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})


def _counting_features(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                found, doc = word_features(texts, held.value)
                toxic = part.column(part.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False).astype(bool)
                size = found.shape[0]
                flat, owner = found.reshape(-1), np.tile(doc, size)
                real = flat != 0
                flat, owner = flat[real], owner[real]
                order = np.lexsort((owner, flat))
                flat, owner = flat[order], owner[order]
                new = np.ones(len(flat), dtype=bool)
                new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
                flat, owner = flat[new], owner[new]
                unique, place = np.unique(flat, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "feature": pa.array(unique.view(np.int64)), "n": pa.array(sum_by(place, np.ones(len(flat)), len(unique)).astype(np.int64)),
                    "toxic": pa.array(sum_by(place, toxic[owner], len(unique)).astype(np.int64))})
    return run


class Model:
    """What is learned: character trigrams, features with their weights, and the curve."""

    def __init__(self, grams: tuple, keys: np.ndarray, weights: np.ndarray, curve: np.ndarray | None = None):
        self.grams, self.keys, self.weights, self.curve = grams, keys, weights, curve

    def describe(self, texts: Texts) -> np.ndarray:
        """For each text: 1, largest weight, logarithm of the number of words with a weight, logarithm of their sum."""
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        if not len(self.keys):
            return out
        found, doc = word_features(texts, self.grams)
        weight = np.zeros(found.shape[1])
        for row in found:
            at = np.minimum(np.searchsorted(self.keys, row), len(self.keys) - 1)
            np.maximum(weight, np.where(self.keys[at] == row, self.weights[at], 0.0), out=weight)
        more, which = joined_features(texts, self.grams, self.keys)
        weight = np.concatenate([weight, self.weights[np.searchsorted(self.keys, more)]])
        doc = np.concatenate([doc, which])
        hit = weight > 0
        np.maximum.at(out[:, 1], doc[hit], weight[hit])
        out[:, 2] = np.log1p(sum_by(doc[hit], np.ones(int(hit.sum())), len(texts)))
        out[:, 3] = np.log1p(sum_by(doc[hit], weight[hit], len(texts)))
        return out

    def score(self, texts: Texts) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.describe(texts) @ self.curve, -30, 30)))


def _describing(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                x = held.value.describe(texts)
                yield pa.RecordBatch.from_pydict({
                    "toxic": part.column(part.schema.get_field_index("toxic")),
                    **{f"x{i}": pa.array(x[:, i]) for i in range(4)}})
    return run


def curve_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a Newton step needs of these rows: gradient and curvature of the likelihood at ``w``, in one array."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)])


def fit_curve(sums, size: int, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, with a small penalty on all but the constant; ``sums`` gives :func:`curve_sums`."""
    w = np.zeros(size)
    penalty = np.full(size, ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        total = sums(w)
        step = np.linalg.solve(total[size:].reshape(size, size) + np.diag(penalty), total[:size] - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _summing(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) * (len(w) + 1))
        for batch in batches:
            y, *x = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            total += curve_sums(np.stack(x, axis=1), y, w)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})
    return run


def labelled_only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``rows``, and one in ``MARKS`` of the others: a filter before a shuffle.

    Each id of ``rows`` sets a bit; the filter has a bounded number of bits and may let more pass, but holds none back that is in
    ``rows``.
    """
    blocks = min(MARKS * rows.count(), MOST_MARKS) // _MARK_BLOCK + 1
    place = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), F.lit(blocks * _MARK_BLOCK)) + 1).alias("place")
    marks = rows.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("marks"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))) != 0
    return docs.join(F.broadcast(marks), (F.bitmap_bucket_number(place) == F.col("bucket")) & known, "left_semi")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Learn from all labelled rows whose fold is not 0."""
    spark = docs.sparkSession
    rows = (labels.filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id"), folds) != 0)
            .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
            .withColumn("later", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)) == 0))
    rows = stored(rows, "labelled")
    # only texts that may have a label cross the shuffle
    texts = labelled_only(docs.select("doc_id", "text"), rows)
    texts = stored(texts.join(rows.hint("merge"), "doc_id"), "labelled-texts")
    early, later = texts.filter("not later").select("text", "toxic"), texts.filter("later").select("text", "toxic")
    grams = tuple((r["gram"], r["n"]) for r in early.select("text").mapInArrow(_counting_letters, "gram string, n long")
                  .groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").collect())  # three of 28 signs: bounded
    number = early.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    toxic, clean = F.lit(float(number[0])), F.lit(float(number[1]))
    held = spark.sparkContext.broadcast(grams)
    counted = (early.mapInArrow(_counting_features(held), "feature long, n long, toxic long")
               .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).filter(F.col("t") >= LEAST))
    t, c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (toxic + 1 - F.col("t"))) - F.log(c / (clean + 1 - (F.col("n") - F.col("t"))))
    weight = odds - 1.64 * F.sqrt(1 / t + 1 / c)
    clear = (counted.select("feature", weight.alias("weight")).filter(F.col("weight") > CLEAR)
             .orderBy(F.desc("weight"), "feature").limit(FEATURES).collect())
    keys = np.array([r["feature"] for r in clear], dtype=np.int64).view(U64)
    order = np.argsort(keys)
    model = Model(grams, keys[order], np.array([r["weight"] for r in clear])[order])
    held = spark.sparkContext.broadcast(model)
    shown = stored(later.mapInArrow(_describing(held), "toxic boolean, x0 double, x1 double, x2 double, x3 double"), "described")

    def sums(w: np.ndarray) -> np.ndarray:
        found = shown.mapInArrow(_summing(w), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        return np.array([r["v"] for r in found])

    if not shown.isEmpty():
        model.curve = fit_curve(sums, 4)
    return model


def _scoring(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield part.append_column(name, pa.array(held.value.score(texts)))
    return run


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """The rows of ``docs`` with the score of their ``text`` in a new column."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scoring(held, name), f"{fields}, `{name}` double")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    model = learn(docs, labels, folds)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    return with_score(rows, model, "score").select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that are scored below one half."""
    scored = with_score(docs, learn(docs, labels, folds), "__toxic")
    return scored.filter(F.col("__toxic") < 0.5).drop("__toxic")
