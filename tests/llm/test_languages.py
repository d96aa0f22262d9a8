"""Language filters: counts and masks against brute force, held-out accuracy, and edge cases."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import languages

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams_by_hand(text):
    words = re.split(" +", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).strip())
    for word in words:
        if word:
            raw = b" " + word.encode() + b" "
            for n in languages.GRAMS:
                for i in range(len(raw) - n + 1):
                    yield raw[i:i + n]


def number(gram):
    return int.from_bytes(gram, "little") | len(gram) << 56


def odd_rows():
    rng = random.Random(4)
    words = {"en": ["the", "and", "of", "through"], "de": ["über", "und", "straße", "nicht"], "fr": ["été", "que", "où", "dans"]}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(rng.randint(1, 40))), l, "s", 1)
            for i in range(120) for l in [rng.choice(sorted(words))]]
    return rows + rows[:5] + [(500, None, "en", "s", 0), (501, "", "de", "s", 0), (502, "12 .. 34", "fr", "s", 0), (503, "the und", None, None, 0),
                              (None, "über", "de", "s", 0), (504, "nicht " * 20000, "de", "s", 0), (505, "x" * 30000, "en", "s", 0),
                              (506, "ÜBER Straßé", "de", "s", 0), (507, "日本語", "ja", "s", 0)]


def test_gram_counts_by_hand(spark, make):
    rows = odd_rows()
    want = Counter((l, number(g)) for _, t, l, *_ in rows if l is not None for g in grams_by_hand(t))
    got = {(r.lang, r.gram): r.n for r in languages.gram_counts(make(rows, DOCS)).collect()}
    assert got == dict(want)


def test_filter_holds_all_grams_of_each_language(spark, make):
    rows = [r for r in odd_rows() if r[2] is not None]
    model = languages.learn(make(rows, DOCS))
    counts = Counter((l, g) for _, t, l, *_ in rows for g in grams_by_hand(t))
    total = Counter()
    for (l, _), n in counts.items():
        total[l] += n
    share = {k: n / total[k[0]] for k, n in counts.items() if n / total[k[0]] >= languages.LEAST}
    highest = Counter()
    for (_, g), s in share.items():
        highest[g] = max(highest[g], s)
    kept = {k for k, s in share.items() if s >= languages.AGAINST * highest[k[1]]}
    every = sorted({g for _, g in counts})
    hits = list(model.hits(np.array([number(g) for g in every], dtype=np.uint64)))
    false = 0
    for i, lang in enumerate(model.langs):
        for g, hit in zip(every, hits[i]):
            assert hit or (lang, g) not in kept  # a Bloom filter misses none
            false += bool(hit) and (lang, g) not in kept
    assert false <= 0.02 * len(every) * len(model.langs)
    assert model.langs == sorted(model.langs) == ["de", "en", "fr", "ja"]
    assert model.own == pytest.approx([sum(s for k, s in share.items() if k in kept and k[0] == l) for l in model.langs])


def test_many_languages_take_more_words(spark, make):
    names = [f"l{i:03}" for i in range(70)]
    rows = [(i, f"wort{chr(97 + i // 26)}{chr(97 + i % 26)} " * 5, name, "s", 1) for i, name in enumerate(names)]
    docs = make(rows, DOCS)
    model = languages.learn(docs)
    assert model.slices.shape[1] == 2
    got = languages.predict(docs.withColumn("held_out", F.lit(False)), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == dict(enumerate(names))


def test_chance_is_taken_off():
    model = languages.Model(["a", "b"], np.zeros((2, 1), dtype=np.uint64), np.array([0.2, 0.0]), np.array([1.0, 0.5]))
    got = languages.corrected(np.array([[60, 20], [20, 0]]), np.array([100, 100]), model)
    assert got == pytest.approx(np.array([[0.5, 0.4], [0.0, 0.0]]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in languages.predict_documents(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(got[r.doc_id].lang_pred, r.lang) for r in rows if got[r.doc_id].held_out and re.search(r"[^\W\d_]", r.text or "")]
    assert len(held) > 200 and sum(p == l for p, l in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learning_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("t"))
    key = lambda df: sorted(map(tuple, languages.predict_documents(df).collect()))
    assert key(docs) == key(turned)


def test_language_edges(spark, make):
    assert languages.predict_documents(make([], DOCS)).collect() == []
    rows = odd_rows()
    got = languages.predict_documents(make(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (500, 501, 502))
    assert by_id[504].lang_pred == "de" and by_id[None].lang_pred == "de"
    nothing = languages.predict_documents(make([(1, "the und", None, "s", 1), (2, "x", None, "s", 1)], DOCS)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_words_are_runs_of_letters():
    column, letters = languages.words_only(pa.array(["It's 3 Örks!", "12", None, ""]))
    assert column.to_pylist()[0] == " it s örks " + " " and letters.tolist() == [True, False, False, False]
