"""Edge rows of the scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import checks, deductions, labels, money, pii, text
from ledgerloom.functions.sqlfuncs import register


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_rupees_to_paise(spark):
    values = ["104400.00", "1800", "0.5", "1,000", "1.239", "-1", "", "5\n", None, "99999999999999999999"]
    assert column(spark, values, money.rupees_to_paise) == [10440000, 180000, 50] + [None] * 7


def test_money_display(spark):
    values = [10489411400, 0, 5, 99999, 10000000, -150]
    assert column(spark, values, money.paise_to_rupees, "bigint") == ["104894114.00", "0.00", "0.05", "999.99", "100000.00", None]
    assert column(spark, values, money.format_inr, "bigint")[:5] == [
        "₹ 10,48,94,114.00", "₹ 0.00", "₹ 0.05", "₹ 999.99", "₹ 1,00,000.00"]
    assert column(spark, values, money.format_inr, "bigint")[5] == "₹ -2.50"
    assert column(spark, [-200000, 0], money.format_signed_inr, "bigint") == ["-₹ 2,000.00", "+₹ 0.00"]


def slow_soundex(word):
    """Letter-by-letter statement of the rule, for comparison."""
    table = dict(zip(text.SOUNDEX_LETTERS, text.SOUNDEX_DIGITS))
    out, last = "", None
    for i, digit in enumerate(table.get(c) for c in word):
        if digit is not None:
            if i > 0 and digit != last:
                out += digit
            last = digit
    return (word[0].upper() + out + "000")[:4]


def test_phonetic_codes(spark):
    words = ["tymczak", "nexus", "logistx", "logistics", "123", "145", "pfister", "ashcraft", "a", "tech", "lloyd"]
    assert column(spark, words, text.soundex_code) == [slow_soundex(w) for w in words]
    assert column(spark, ["tymczak"], text.soundex_code) == ["T520"]
    assert column(spark, ["e", "pf", "pfe", ""], text.nysiis_code) == [None] * 4
    assert column(spark, ["macdonald", "knight", "phase"], text.nysiis_code) == ["mcdana", "nagtaa", "faaaaa"]


@pytest.mark.parametrize("a,b,score", [
    (["tata", "motors"], ["tata", "steel"], 0.0), (["nexus", "logistx"], ["nexus", "logistics"], 1.0),
    (["a"], ["a", "b"], 0.5), ([], [], 1.0), ([], ["a"], 0.0), (["tech"], ["technologies"], 1.0),
    (["a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "e", "f", "g"], 0.8571)])
def test_token_set_score(spark, a, b, score):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(text.token_set_match("a", "b")["score"]).first()[0] == score
    register(spark)
    assert df.selectExpr("ll_token_set_match(a, b).score").first()[0] == score


def test_narration_trap(spark):
    """Words that the noise lists do not know turn a full match into containment."""
    rows = [("Nexus Logistics Pvt Ltd", "IMPS/90123/HDFC/MUMBAI/NEXUS LOGISTICS"),
            ("Nexus Logistics Pvt Ltd", "CREDIT/IMPS/300000000002/NEXUS LOGISTICS PVT LTD/INV-2026-0001")]
    df = spark.createDataFrame(rows, "s string, n string").select(
        text.source_tokens("s").alias("a"), text.narration_tokens("n").alias("b"))
    assert [r[0] for r in df.select(text.token_set_match("a", "b")["score"]).collect()] == [1.0, 0.5]
    wider = spark.createDataFrame(rows[1:], "s string, n string").select(
        text.source_tokens("s").alias("a"), text.narration_tokens("n", bank=text.BANK_NOISE + ("credit", "inv")).alias("b"))
    assert wider.select(text.token_set_match("a", "b")["score"]).first()[0] == 1.0


@pytest.mark.parametrize("gross,tds,section,status,flags", [
    ("100.00", "120.00", "194C", "NEGATIVE_NET_SETTLEMENT", ["NEGATIVE_NET_SETTLEMENT"]),
    ("1000", "20", "194C", "WATERFALL_CALCULATED", []), ("1000", "26", "194C", "WATERFALL_CALCULATED", ["TDS_RATE_ANOMALY"]),
    ("1000", "25", "194c", "WATERFALL_CALCULATED", []), ("1000", "210", "194J", "WATERFALL_CALCULATED", ["TDS_RATE_ANOMALY"]),
    ("1000", "100", "unknown", "WATERFALL_CALCULATED", []), ("1,000", "1", "194C", "INVALID_PAISE_CASTING", ["INVALID_PAISE_CASTING"])])
def test_waterfall(spark, gross, tds, section, status, flags):
    df = spark.createDataFrame([(gross, tds, 0, 0, section)], "grand_total_rupees string, tds_deducted_rupees string,"
                               " gateway_fees_paise bigint, gateway_tax_paise bigint, tds_section string")
    w = deductions.with_waterfall(df).first().waterfall
    assert (w.status, w.flags) == (status, flags)


def document(**changes):
    doc = {
        "metadata": {"source_file": "x"}, "supplier_details": {"legal_name": "S", "pan": "ABCDE1234F"}, "buyer_details": {},
        "reference_data": {"invoice_number": "I1", "document_type_code": "INV", "document_date": "2026-08-01"},
        "banking_details": {"account_number": "12345678901", "ifsc": "HDFC0000001"},
        "line_items": [{"line_number": 1, "description": "d", "quantity": 2, "unit": "NOS", "unit_price_paise": 1000,
                        "taxable_value_paise": 2000, "gst_rate": 18, "igst_paise": 360, "total_paise": 2360}],
        "financial_summary": {"subtotal_paise": 2000, "total_tax_paise": 360, "total_igst_paise": 360,
                              "tds_deduction_paise": 40, "grand_total_paise": 2360}}
    for path, value in changes.items():
        target, keys = doc, path.split("__")
        for key in keys[:-1]:
            target = target[int(key)] if isinstance(target, list) else target[key]
        if value is ...:
            del target[keys[-1]]
        else:
            target[keys[-1]] = value
    return doc


@pytest.mark.parametrize("changes,checksum,schema", [
    ({}, [], []),
    ({"line_items": []}, ["No line items found in invoice"], []),
    ({"line_items__0__quantity": "2.5"}, ["Line 1: taxable_value_paise 2000 != unit_price(1000) x qty(2.5) = 2500"], []),
    ({"line_items__0__quantity": 2.5}, ["Line 1: Invalid decimal value - 2.5"], []),
    ({"line_items__0__igst_paise": None},
     ["Line 1: Invalid decimal value - null", "Financial summary validation error: line item amount"], ["line_items[]"]),
    ({"financial_summary__grand_total_paise": ...},
     ["grand_total_paise 0 != subtotal(2000) + tax(360) - discount(0) + other(0) + rounding(0) = 2360"],
     ["financial_summary.grand_total_paise"]),
    ({"financial_summary__tds_deduction_paise": 5000}, ["tds_deduction_paise 5000 exceeds subtotal 2000"], []),
    ({"reference_data__document_date": "soon"}, [], ["reference_data.document_date"])])
def test_document_checks(spark, changes, checksum, schema):
    raw = spark.createDataFrame([(json.dumps(document(**changes)),)], "raw_text string")
    row = checks.with_document(raw).select(checks.checksum_errors(F.col("doc")).alias("c"),
                                           checks.schema_errors(F.col("doc")).alias("s")).first()
    assert (row.c, row.s) == (checksum, schema)


def test_integer_checks_agree_with_exact_ones(spark):
    """Plain documents are passed by integer arithmetic; the same document with ``plain`` unset goes through the exact checks."""
    lines = [("2", "1000", "2000"), (2, 1000, 2000), (" 2", "+1000", 2000), ("2.0", 1000, "2000.00"), (1, 3_000_000_000, 3_000_000_000),
             (2, 1000, 2001), (2, 1500, "3000\x7f"), ("2\x08", 1000, 2000), (-2, -1000, 2000), ("two", 1000, 2000), (2, "", 2000),
             (2, 10 ** 17, 2 * 10 ** 17), (None, 1000, 2000), (2.5, 800, 2000), (..., 1000, 0)]
    raw = spark.createDataFrame([(json.dumps(document(line_items__0__quantity=q, line_items__0__unit_price_paise=p,
                                                      line_items__0__taxable_value_paise=t), ensure_ascii=False),) for q, p, t in lines], "raw_text string")
    docs = checks.with_document(raw).coalesce(1)
    fast, exact = (docs.select(checks.checksum_errors(d).alias("c"), checks.schema_errors(d).alias("s")).collect() for d in (
        F.col("doc"), F.col("doc").withField("plain", F.lit(False))))
    assert fast == exact and fast[1].c == [] and fast[1].s == [] and fast[5].c


def test_parts_of_a_document(spark):
    """Only the named parts are read; a search for suspect numbers has no second alternative to try at every place of a text."""
    raw = spark.createDataFrame([(json.dumps(document()),)], "raw_text string")
    doc = checks.with_document(raw, parts=checks.PARTY_PARTS).first().doc
    assert set(doc.body.asDict()) == set(checks.PARTY_PARTS) and doc.body.supplier_details.pan
    whole = checks.with_document(raw).first().doc
    assert doc.body.supplier_details == whole.body.supplier_details and whole.plain
    texts = ['{"a": null}', '{"a":-1.5}', '{"a":1E3}', '{"a" :1}', '{"a":1}', '{"a":"null 1.5"}']
    assert [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(
        F.col("t").rlike(checks.SUSPECT_NUMBER)).collect()] == [True, True, True, True, False, False]
    assert not checks.SUSPECT_NUMBER.startswith('":')


def test_document_text_that_is_no_json(spark):
    raw = spark.createDataFrame([("sorry, no invoice",), ("```json\n" + json.dumps(document()) + "\n```",), ("```\n{}\n```",)], "raw_text string")
    rows = checks.with_document(raw).select(checks.schema_errors(F.col("doc")).alias("s")).collect()
    assert rows[0].s == ["not a JSON object"] and rows[1].s == [] and "line_items" in rows[2].s


def test_masking(spark):
    filler = "x" * 90
    rows = [(1, f"PAN abcde1234f and 27ABCDE1234F1Z5, account 123456789 ok {filler} 987654321 {filler} 1234 5678 9012")]
    df = pii.with_spans(spark.createDataFrame(rows, "id int, text string"))
    out = df.select(pii.masked_text().alias("m"), pii.vault_entries().alias("v")).first()
    assert out.m == (f"PAN [PAN_REDACTED] and [GSTIN_REDACTED], account [ACCOUNT_REDACTED] ok {filler} 987654321 {filler} "
                     "[AADHAAR_REDACTED]")
    assert [tuple(v) for v in out.v] == [("IN_PAN_1", "abcde1234f"), ("IN_GSTIN_1", "27ABCDE1234F1Z5"),
                                         ("BANK_ACCOUNT_1", "123456789"), ("IN_AADHAAR_1", "1234 5678 9012")]


def test_masked_document(spark):
    raw = spark.createDataFrame([(json.dumps(document()),), (json.dumps(document(banking_details__account_number="12")),)], "raw_text string")
    rows = checks.with_document(raw).select(pii.mask_document(F.col("doc.body")).alias("m")).collect()
    assert [r.m.banking_details.account_number_masked for r in rows] == ["XXXX-8901", "XXXX"]
    assert rows[0].m.supplier_details.pan == "[PAN_REDACTED]" and rows[0].m.banking_details.ifsc == "[IFSC_REDACTED]"


def test_document_gate(spark):
    rows = [(11 * 1024 * 1024, "image/png", ".png", "invoice", 0.9, True), (1, "image/png", ".jpg", "invoice", 0.9, True),
            (1, "image/jpeg", ".JPEG", "invoice", 0.79, True), (1, "application/pdf", ".pdf", "invoice", 0.8, False),
            (1, "application/pdf", ".pdf", "invoice", 0.8, True)]
    df = spark.createDataFrame(rows, "size bigint, mime string, ext string, label string, conf double, anchor boolean")
    got = [r[0] for r in df.select(labels.document_gate(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["FILE_TOO_LARGE", "UNSUPPORTED_FILE_TYPE", "INVALID_DOCUMENT_CLASSIFICATION", "INVALID_DOCUMENT_CLASSIFICATION", None]


def test_spans_of_many_hits_take_time_in_proportion(spark):
    """A text of very many hits, each of which is an account only by a word near it."""
    import time

    from ledgerloom.functions import pii

    def seconds(n):
        text = " ".join(f"account no {50100000000000 + i} x" if i % 2 else f"{'filler ' * 14}{70000000000 + i}" for i in range(n))
        start = time.time()
        row = pii.with_spans(spark.createDataFrame([(text,)], "text string")).select(
            F.expr("size(spans)").alias("n"), F.expr("size(filter(spans, s -> s.entity = 'BANK_ACCOUNT'))").alias("accounts"),
            F.length(pii.masked_text()).alias("length"), F.size(pii.vault_entries()).alias("entries")).first()
        assert row.n == n and row.accounts == row.entries
        return time.time() - start

    seconds(100)
    assert seconds(40_000) < 60


def test_words_beside_a_hit_are_found_across_other_hits(spark):
    from ledgerloom.functions import pii
    numbers = " ".join(str(700000000 + i) for i in range(20))
    row = pii.with_spans(spark.createDataFrame([(f"account {numbers} bank",)], "text string")).first()
    text = f"account {numbers} bank"
    for i, s in enumerate(row.spans):
        at = text.index(s.value)
        around = text[max(at - 80, 0):at + len(s.value) + 30]
        assert (s.entity == "BANK_ACCOUNT") == ("account" in around or "bank" in around), i
