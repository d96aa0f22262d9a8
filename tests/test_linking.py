"""Supplier links by the index of words against every name scored with every narration of its vendor."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions.text import narration_tokens, source_tokens, token_synonym
from ledgerloom.operators import linking

WORDS = ["acme", "traders", "sharma", "steelworks", "internationale", "shree", "ganesh", "electricals", "om", "a1", "pharmaceuticalsandlogistics"]


def spoiled(word, rng):
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(word) + 1)
        word = rng.choice([word[:at] + rng.choice("aehkz") + word[at:], word[:at] + word[at + 1:], word[:at] + rng.choice("aes") + word[at + 1:]])
    return word


def test_synonyms_find_all_alike_words(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(w,) for w in sorted({spoiled(w, rng) for w in WORDS for _ in range(12)})], "a string")
    right = spark.createDataFrame([(w,) for w in sorted({spoiled(w, rng) for w in WORDS for _ in range(12)})], "b string")
    left, right = left.filter("a <> ''"), right.filter("b <> ''")
    want = {(r.a, r.b) for r in left.crossJoin(right).filter(token_synonym("a", "b").isNotNull()).collect()}
    got = {(r.a, r.b) for r in linking.synonyms(left, right).collect()}
    assert got == want and any(len(a) > 18 and a != b for a, b in got)


def test_best_settlement_equals_all_pairs(spark):
    rng = random.Random(9)

    def name(k, noise):
        words = [spoiled(w, rng) if rng.random() < 0.4 else w for w in rng.sample(WORDS, k)]
        return " ".join(words + [noise] * rng.randrange(2))

    names = [(f"v{rng.randrange(3)}", name(rng.randrange(1, 9), "Pvt Ltd")) for _ in range(60)] + [("v0", "Pvt Ltd"), ("v1", None), (None, "acme")]
    paid = [(f"v{rng.randrange(3)}", f"p{i:03}", f"u{i}", i, rng.randrange(5), name(rng.randrange(1, 9), "NEFT 123")) for i in range(90)]
    paid += [(v, f"q{i:03}", f"w{i}", i, 9, " ".join([n, "IMPS"])) for i, (v, n) in enumerate(names[:20])]
    paid += [("v0", "e1", "x", 1, 1, "NEFT 99"), ("v1", "e2", None, 1, 1, "acme"), ("v1", "e3", "y", 1, 1, "")]
    invoices = spark.createDataFrame(names, "vendor_code string, supplier_legal_name string")
    settlements = spark.createDataFrame(paid, "vendor_code string, payout_id string, utr string, amount_paise long, ingested_epoch long, narration string")
    scored = linking.score_distinct_pairs(
        invoices.distinct().withColumn("a", source_tokens("supplier_legal_name"))
        .join(settlements.filter("utr IS NOT NULL AND narration <> ''").withColumn("b", narration_tokens("narration")), "vendor_code"), "a", "b")
    want = {(r.vendor_code, r.supplier_legal_name): (r.best.score, r.best.payout_id) for r in scored.filter("score >= 0.85").groupBy(
        "vendor_code", "supplier_legal_name").agg(F.max(F.struct("score", "ingested_epoch", "payout_id")).alias("best")).collect()}
    got = {(r.vendor_code, r.supplier_legal_name): (r.fuzzy_score, r.fuzzy_payout_id) for r in linking.best_settlement(invoices, settlements).collect()}
    assert got == want and len(got) > 15 and ("v0", "Pvt Ltd") in got
