"""Language identification by bit-sliced Bloom filters of character n-grams.

Training documents are cut into words (runs of letters and marks, lower-cased), words into byte n-grams with word ends
(``GRAMS`` bytes), and n-grams are counted for each language over all training documents. An n-gram belongs to a language if
it makes up at least ``LEAST`` of the language's n-grams, and if its share there is at least ``AGAINST`` of its highest share
in any language. So a language has at most 1 / LEAST n-grams, whatever the number of documents: that bounds the filter.

The filter is cut in slices of one bit for each language: an n-gram's ``HASHES`` rows, joined by AND, give the mask of all
languages that contain it. The popcount of a language over a text's n-grams, less the hits expected by chance (the share of
set bits of its slice, to the power of the number of rows), is compared with the share of n-grams that a text of the language
has among its own; the highest quotient decides.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text where nothing could be learned;
ties go to the language first in order of code points; repeated rows count each and are returned each; a null doc_id counts as
the text '' in the fold; labels that are null teach nothing, an empty label is a language; extra columns are left out; no rows
give no rows. Texts of any length are read whole. Learning never sees held-out documents, and no prediction sees lang,
source or doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrays import U64, Texts, chunks, mix
from ledgerloom.llm.shared import fold, stored

GRAMS = (3, 4, 5)  # bytes of an n-gram, word ends included; at most 7
LEAST = 1e-5  # of a language's n-grams: a language has at most 100,000
AGAINST = 0.2  # of an n-gram's highest share in a language
BITS, HASHES = 12, 6  # rows of the filter for each n-gram of the largest language; rows probed
HELD_GRAMS = 1 << 20  # different n-grams a training task holds for all languages before it passes them on
UNKNOWN = "und"
_NOT_WORD = "[^\\pL\\pM]+"
_LETTER = "\\pL"


def words_only(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of each text with a blank around each, and which texts have a letter."""
    text = pc.utf8_lower(text.cast(pa.large_string()).fill_null(""))
    letters = pc.match_substring_regex(text, _LETTER).to_numpy(zero_copy_only=False).astype(bool)
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.replace_substring_regex(text, _NOT_WORD, " "), blank, none), letters


_IS_LETTER = np.ones(256, dtype=bool)
_IS_LETTER[0x20] = False


def distinct_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (with the blanks around) of one example of each word, each occurrence's word, and its text."""
    starts, ends, first = texts.words(_IS_LETTER)
    _, example, of = np.unique(texts.hashes(starts, ends, lower=False), return_index=True, return_inverse=True)
    return starts[example] - 1, ends[example] + 1, of, np.repeat(np.arange(len(texts)), np.diff(first))


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the spans as numbers (their bytes, and their length above those), and the span of each."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    found, spans = [], []
    for n in GRAMS:
        many = np.maximum(ends - starts - n + 1, 0)
        span = np.repeat(np.arange(len(starts)), many)
        at = starts[span] + np.arange(len(span)) - np.repeat(np.cumsum(many) - many, many)
        found.append((eight[at] & U64((1 << 8 * n) - 1)) | U64(n << 56))
        spans.append(span)
    return np.concatenate(found), np.concatenate(spans)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def rows():
        for lang, (keys, times) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()),
                                              "gram": pa.array(keys.astype(np.int64)), "n": pa.array(times, pa.int64())})
        held.clear()

    for batch in batches:
        for part, _ in chunks(batch, "text"):
            texts = Texts(words_only(part.column(part.schema.get_field_index("text")))[0])
            starts, ends, of, doc = distinct_words(texts)
            found, span = grams(texts.data, starts, ends)
            keys, gram = np.unique(found, return_inverse=True)
            names = part.column(part.schema.get_field_index("lang")).dictionary_encode()
            lang = names.indices.to_numpy(zero_copy_only=False)[doc]
            for i, name in enumerate(names.dictionary.to_pylist()):
                word = np.bincount(of[lang == i], minlength=len(starts))
                times = np.bincount(gram, weights=word[span], minlength=len(keys)).astype(np.int64)
                some = np.flatnonzero(times)
                old = held.get(name, (np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)))
                both, place = np.unique(np.concatenate([old[0], keys[some]]), return_inverse=True)
                held[name] = (both, np.bincount(place, weights=np.concatenate([old[1], times[some]]),
                                                minlength=len(both)).astype(np.int64))
        if sum(len(k) for k, _ in held.values()) > HELD_GRAMS:
            yield from rows()
    yield from rows()


def gram_counts(training: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``training`` (text, lang); pre-aggregated in each task."""
    return (training.filter("text IS NOT NULL AND lang IS NOT NULL")
            .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(_counting, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _rows_of(keys: np.ndarray, size: int) -> np.ndarray:
    """The filter rows of each n-gram, one column for each hash; ``size`` is a power of two."""
    one, two = mix(keys), mix(keys ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)
    with np.errstate(over="ignore"):
        return np.stack([((one + U64(i) * two) >> U64(11)) & U64(size - 1) for i in range(HASHES)], axis=1).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``slices``: rows x words of 64 languages each; by language: chance of a false hit, share of own n-grams known."""
    langs: list[str]
    slices: np.ndarray
    chance: np.ndarray
    own: np.ndarray

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits."""
        rows = _rows_of(keys, len(self.slices))
        out = self.slices[rows[:, 0]]
        for i in range(1, HASHES):
            out = out & self.slices[rows[:, i]]
        return out

    def hits(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """For one language after the other, which n-grams its filter contains (0 or 1)."""
        masks = self.masks(keys) if self.langs else None
        for i in range(len(self.langs)):
            yield ((masks[:, i // 64] >> U64(i % 64)) & U64(1)).astype(np.int64)


def _setting(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows_of(batch.column("gram").to_numpy().astype(U64), size)
            lang = np.repeat(batch.column("number").to_numpy(), HASHES)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(rows.ravel()), "word": pa.array((lang // 64).astype(np.int32)),
                "bits": pa.array((U64(1) << (lang % 64).astype(U64)).view(np.int64))})
    return run


def learn(training: DataFrame) -> Model:
    """The filter from all rows of ``training`` (text, lang)."""
    counts = stored(gram_counts(training), "gram-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted((r["lang"], r["total"]) for r in total.collect())  # a row for each language
    names = [name for name, _ in langs]
    spark = counts.sparkSession
    numbers = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(langs)], "number int, lang string, total long")
    share = counts.join(F.broadcast(numbers), "lang").withColumn("share", F.col("n") / F.col("total"))
    kept = share.filter(F.col("share") >= LEAST)  # at most 1 / LEAST of each language
    highest = kept.groupBy("gram").agg(F.max("share").alias("highest"))
    kept = stored(kept.join(highest, "gram").filter(F.col("share") >= AGAINST * F.col("highest"))
                  .select("gram", "number", "share"), "language-grams")
    each = {r["number"]: r for r in kept.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("own")).collect()}
    if not each:
        return Model([], np.zeros((1, 0), dtype=U64), np.zeros(0), np.zeros(0))
    size = 1 << (max(r["n"] for r in each.values()) * BITS - 1).bit_length()
    slices = np.zeros((size, (len(names) + 63) // 64), dtype=U64)
    bits = kept.select("gram", "number").mapInArrow(_setting(size), "row long, word int, bits long").groupBy("row", "word").agg(
        F.bit_or("bits").alias("bits")).toArrow()  # rows of the filter, whose size is bounded
    slices[bits["row"].to_numpy(), bits["word"].to_numpy()] = bits["bits"].to_numpy().view(U64)
    fill = np.array([((slices[:, i // 64] >> U64(i % 64)) & U64(1)).mean() for i in range(len(names))])
    own = np.array([each[i]["own"] if i in each else 0.0 for i in range(len(names))])
    return Model(names, slices, fill ** HASHES, own)


def corrected(hits: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Shares of n-grams that really are in each language, relative to what its own texts have; 0 or more."""
    chance, own = model.chance[None, :], np.maximum(model.own[None, :], 1e-9)
    real = (hits / np.maximum(n, 1)[:, None] - chance) / np.maximum(1 - chance, 1e-9)
    return np.maximum(real, 0) / own


def _predicting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part, _ in chunks(batch, "text"):
                column, letters = words_only(part.column(part.schema.get_field_index("text")))
                texts = Texts(column)
                starts, ends, of, doc = distinct_words(texts)
                found, span = grams(texts.data, starts, ends)
                some, place = np.unique(found, return_inverse=True)
                n = np.bincount(doc, weights=np.bincount(span, minlength=len(starts))[of], minlength=len(texts))
                hits = np.zeros((len(texts), len(model.langs)))
                for i, hit in enumerate(model.hits(some)):
                    of_word = np.bincount(span, weights=hit[place], minlength=len(starts))
                    hits[:, i] = np.bincount(doc, weights=of_word[of], minlength=len(texts))
                rate = corrected(hits, n, model)
                total = rate.sum(axis=1)
                best = rate.argmax(axis=1) if model.langs else np.zeros(len(texts), dtype=int)
                known = letters & bool(model.langs)
                top = np.take_along_axis(rate, best[:, None], axis=1)[:, 0] if model.langs else total
                score = np.where(known & (total > 0), top / np.where(total > 0, total, 1), 0.0)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(part.schema.get_field_index("doc_id")),
                    "held_out": part.column(part.schema.get_field_index("held_out")),
                    "lang_pred": pa.array(names[np.where(known, best, len(model.langs))].tolist(), pa.string()),
                    "score": pa.array(score)})
    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of ``docs`` (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the filter: at most 2 * BITS / LEAST rows
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _predicting(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def predict_documents(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the documents whose fold isn't ``held``, and predict the language of all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang",
                       (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    return predict(rows, learn(rows.filter(~F.col("held_out"))))
