"""Scalar functions over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import checks, dates, deductions, labels, money, text
from ledgerloom.operators import reads
from ledgerloom.plans.registry import query
from ledgerloom.plans.textsql import EDIT, PREFIX, SAME_NYSIIS, SAME_SOUNDEX, codes_sql, narration_sql, score_sql, \
    source_sql, tokens_sql


@query("h1_h3_rupees_to_paise", sql="""
t AS (SELECT o_orderkey AS k, CASE o_orderkey % 8
  WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN o_orderkey::varchar WHEN 2 THEN o_orderkey || '.5'
  WHEN 3 THEN '1,' || o_orderkey WHEN 4 THEN o_orderkey || '.239' WHEN 5 THEN '-' || o_orderkey WHEN 6 THEN ''
  ELSE o_orderkey || chr(10) END AS s FROM orders)
SELECT k, CASE WHEN regexp_full_match(s, '[0-9]+(\\.[0-9]{1,2})?')
  THEN round(s::decimal(20, 2) * 100)::bigint END AS paise FROM t""")
def _(fx):
    rows = fx.table("orders").selectExpr("o_orderkey AS k", """CASE o_orderkey % 8
      WHEN 0 THEN format_string('%.2f', o_totalprice) WHEN 1 THEN cast(o_orderkey AS string)
      WHEN 2 THEN concat(o_orderkey, '.5') WHEN 3 THEN concat('1,', o_orderkey) WHEN 4 THEN concat(o_orderkey, '.239')
      WHEN 5 THEN concat('-', o_orderkey) WHEN 6 THEN '' ELSE concat(o_orderkey, '\n') END AS s""")
    return rows.select("k", money.rupees_to_paise("s").alias("paise"))


@query("h2_paise_to_rupees", needs=["inv"], sql="""
SELECT k, CASE WHEN p >= 0 THEN (p // 100) || '.' || lpad((p % 100)::varchar, 2, '0') END AS rupees
FROM (SELECT k, grand_total_paise - CASE WHEN k % 9 = 0 THEN 100000000 ELSE 0 END AS p FROM inv)""")
def _(fx):
    p = fx.invoices().selectExpr("k", "grand_total_paise - CASE WHEN k % 9 = 0 THEN 100000000 ELSE 0 END AS p")
    return p.select("k", money.paise_to_rupees("p").alias("rupees"))


_GROUPED = """(CASE WHEN w < 1000 THEN w::varchar ELSE
  reverse(rtrim(regexp_replace(reverse((w // 1000)::varchar), '([0-9]{2})', '\\1,', 'g'), ',')) || ',' ||
  lpad((w % 1000)::varchar, 3, '0') END || '.' || lpad(c::varchar, 2, '0'))"""


@query("h4_indian_money", needs=["inv"], sql=f"""
SELECT k, '₹ ' || {_GROUPED} AS shown, CASE WHEN p < 0 THEN '-' ELSE '+' END || '₹ ' || {_GROUPED} AS signed
FROM (SELECT k, p, abs(p) // 100 AS w, abs(p) % 100 AS c FROM (
  SELECT k, grand_total_paise * (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (k % 1000 + 1) AS p FROM inv))""")
def _(fx):
    p = fx.invoices().selectExpr(
        "k", "grand_total_paise * (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (k % 1000 + 1) AS p")
    return p.select("k", money.format_inr(F.abs("p")).alias("shown"), money.format_signed_inr("p").alias("signed"))


@query("h5_h6_tokens_without_noise", needs=["bank"], sql=f"""
SELECT transaction_id, array_to_string({tokens_sql('narration')}, ' ') AS tokens,
  array_to_string({narration_sql('narration')}, ' ') AS normalized FROM bank""")
def _(fx):
    return fx.bank(named=True).select(
        "transaction_id", F.array_join(text.tokenize("narration"), " ").alias("tokens"),
        F.array_join(text.narration_tokens("narration"), " ").alias("normalized"))


@query("h7_h8_phonetic_codes", sql=f"""
words AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS t FROM documents),
{codes_sql('words')}
SELECT t AS word, sdx AS soundex_code, nys AS nysiis_code FROM code""")
def _(fx):
    words = fx.table("documents").select(F.explode(text.tokenize("text")).alias("word")).distinct()
    return words.select("word", text.soundex_code("word").alias("soundex_code"),
                        text.nysiis_code("word").alias("nysiis_code"))


_SETTLED_PAIR = ("FROM settle s JOIN invn i ON i.invoice_number = s.reference_id")


def _settled_pairs(fx):
    """Supplier and settlement narration as token arrays, each distinct pair once with its count."""
    s = fx.settlements(named=True).select("payout_id", "reference_id", "narration", "k")
    names = fx.suppliers()
    joined = s.join(names, "k", "left").withColumn(
        "supplier_legal_name", F.coalesce("supplier_legal_name", F.lit("unknown Pvt Ltd")))
    return joined.select("payout_id", text.source_tokens("supplier_legal_name").alias("a"),
                         text.narration_tokens("narration").alias("b"))


@query("h9_h10_token_synonyms", needs=["settle"], sql=f"""
ws AS (SELECT DISTINCT {source_sql('supplier_legal_name')} AS a, {narration_sql('narration')} AS b {_SETTLED_PAIR}),
pr AS (SELECT DISTINCT x, unnest(b) AS y FROM (SELECT unnest(a) AS x, b FROM ws)),
tk AS (SELECT x AS t FROM pr WHERE x IS NOT NULL UNION SELECT y FROM pr WHERE y IS NOT NULL),
{codes_sql('tk')},
cc AS (SELECT t, sdx AS s, nys AS n FROM code)
SELECT pr.x AS left_word, pr.y AS right_word, levenshtein(pr.x, pr.y) <= 2 AS near,
  CASE WHEN pr.x = pr.y THEN 'exact' WHEN {SAME_SOUNDEX.format(x='a', y='b')} THEN 'soundex'
    WHEN {SAME_NYSIIS.format(x='a', y='b')} THEN 'nysiis' WHEN {PREFIX.format(x='a', y='b')} THEN 'prefix'
    WHEN {EDIT.format(x='a', y='b')} THEN 'edit' END AS method
FROM pr JOIN cc a ON a.t = pr.x JOIN cc b ON b.t = pr.y""")
def _(fx):
    words = _settled_pairs(fx).select("a", "b").distinct()  # every word of a name with every word of its narration
    pairs = words.select(F.explode("a").alias("left_word"), "b").select("left_word", F.explode("b").alias("right_word")).filter(
        "left_word IS NOT NULL AND right_word IS NOT NULL").distinct()
    return pairs.select("left_word", "right_word",
                        text.edit_within(F.col("left_word"), F.col("right_word")).alias("near"),
                        text.token_synonym("left_word", "right_word").alias("method"))


@query("h11_h12_fuzzy_verdict", needs=["settle"], sql=f"""
pr AS (SELECT payout_id AS id, {source_sql('supplier_legal_name')} AS a, {narration_sql('narration')} AS b
  {_SETTLED_PAIR}),
{score_sql('pr')}
SELECT id AS payout_id, score, phonetic, CASE WHEN score >= 0.85 THEN 'ENTITY_RESOLVED' ELSE 'ENTITY_MISMATCH' END AS status,
  array_to_string(a, ' ') AS normalized_source, array_to_string(b, ' ') AS normalized_target
FROM scored JOIN pr USING (id)""")
def _(fx):
    from ledgerloom.operators.linking import fuzzy_verdict
    return fuzzy_verdict(_settled_pairs(fx), "a", "b").select(
        "payout_id", "score", "phonetic", "status", "normalized_source", "normalized_target")


@query("g5_token_set_algebra", needs=["settle"], sql=f"""
pr AS (SELECT payout_id, {source_sql('supplier_legal_name')} AS a, {narration_sql('narration')} AS b {_SETTLED_PAIR})
SELECT payout_id, array_to_string(list_filter(a, lambda q: list_contains(b, q)), ' ') AS both_sides,
  array_to_string(list_filter(a, lambda q: NOT list_contains(b, q)), ' ') AS left_only,
  array_to_string(list_filter(b, lambda q: NOT list_contains(a, q)), ' ') AS right_only FROM pr""")
def _(fx):
    return _settled_pairs(fx).select(
        "payout_id", F.array_join(F.array_intersect("a", "b"), " ").alias("both_sides"),
        F.array_join(F.array_except("a", "b"), " ").alias("left_only"),
        F.array_join(F.array_except("b", "a"), " ").alias("right_only"))


_SECTIONS = "'194C', '194J', '194I', '194h', '194A', '194B', '194D', '194DA', '194E', '194G', '999X', ''"
_RATES = ("CASE upper(section) WHEN '194C' THEN 200 WHEN '194J' THEN 1000 WHEN '194I' THEN 1000 WHEN '194H' THEN 1000 "
          "WHEN '194A' THEN 1000 WHEN '194B' THEN 3000 WHEN '194D' THEN 2000 WHEN '194DA' THEN 2000 "
          "WHEN '194E' THEN 3000 WHEN '194G' THEN 500 END")


@query("h13_h14_waterfall", needs=["inv"], sql=f"""
base AS (SELECT k, grand_total_paise AS g, grand_total_paise * (k % 130) // 100 AS tds,
  grand_total_paise // 200 AS fee, grand_total_paise // 1000 AS tax, [{_SECTIONS}][k % 12 + 1] AS section,
  k % 53 = 0 AS bad FROM inv),
calc AS (SELECT *, g - tds - fee - tax AS net, CASE WHEN bad THEN 'INVALID_PAISE_CASTING'
  WHEN g - tds - fee - tax < 0 THEN 'NEGATIVE_NET_SETTLEMENT' ELSE 'WATERFALL_CALCULATED' END AS status,
  {_RATES} AS rate FROM base)
SELECT k, status, CASE WHEN status = 'WATERFALL_CALCULATED' THEN net END AS net_paise,
  CASE WHEN status = 'WATERFALL_CALCULATED' THEN (net // 100) || '.' || lpad((net % 100)::varchar, 2, '0') END AS net_rupees,
  CASE WHEN status <> 'WATERFALL_CALCULATED' THEN status
    WHEN g > 0 AND (tds::hugeint * 5 > g OR coalesce(tds::hugeint * 40000 > g::hugeint * rate * 5, false))
    THEN 'TDS_RATE_ANOMALY' ELSE '' END AS flags FROM calc""")
def _(fx):
    rows = fx.invoices().withColumn("tds", F.expr("grand_total_paise * (k % 130) div 100")).withColumns({
        "grand_total_rupees": F.when(F.expr("k % 53 = 0"), F.lit("1,000")).otherwise(
            money.paise_to_rupees("grand_total_paise")),
        "tds_deducted_rupees": money.paise_to_rupees("tds"),
        "gateway_fees_paise": F.expr("grand_total_paise div 200"),
        "gateway_tax_paise": F.expr("grand_total_paise div 1000"),
        "tds_section": F.expr(f"element_at(array({_SECTIONS}), cast(k % 12 + 1 AS int))")})
    return deductions.with_waterfall(rows).select(
        "k", "waterfall.status", "waterfall.net_paise", "waterfall.net_rupees",
        F.array_join("waterfall.flags", ",").alias("flags"))


@query("d1_line_sums", needs=["lines"], sql="""
SELECT k, sum(taxable_value_paise)::bigint AS taxable_paise, sum(igst_paise)::bigint AS tax_paise, count(*) AS n_lines
FROM lines GROUP BY k""")
def _(fx):
    return fx.lines().groupBy("k").agg(F.sum("taxable_value_paise").alias("taxable_paise"),
                                       F.sum("igst_paise").alias("tax_paise"), F.count(F.lit(1)).alias("n_lines"))


_DOC_SQL = """
agg AS (SELECT k, sum(taxable_value_paise)::bigint AS sub, sum(igst_paise)::bigint AS tax,
  string_agg('Line ' || line_number || ': total_paise ' || total_paise || ' != taxable(' || taxable_value_paise ||
    ') + igst(' || igst_paise || ') + cgst(0) + sgst(0) = ' || (taxable_value_paise + igst_paise), ' | '
    ORDER BY line_number) FILTER (total_paise <> taxable_value_paise + igst_paise) AS line_errors
  FROM lines GROUP BY k),
d AS (SELECT invn.*, sub AS lines_sub, agg.tax, line_errors, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS off,
  CASE WHEN k % 41 = 0 THEN -1 ELSE tds_deduction_paise END AS tds FROM invn LEFT JOIN agg USING (k)),
e AS (SELECT *, CASE WHEN lines_sub IS NULL THEN 'No line items found in invoice' ELSE array_to_string(list_filter([
  line_errors,
  CASE WHEN off = 1 THEN 'subtotal_paise ' || (lines_sub + 1) || ' != sum of line item taxable values ' || lines_sub END,
  CASE WHEN off = 1 THEN 'grand_total_paise ' || (lines_sub + tax) || ' != subtotal(' || (lines_sub + 1) || ') + tax(' || tax
    || ') - discount(0) + other(0) + rounding(0) = ' || (lines_sub + 1 + tax) END,
  CASE WHEN tds < 0 THEN 'tds_deduction_paise is negative: ' || tds END,
  CASE WHEN tds > lines_sub + off AND lines_sub + off > 0 THEN
    'tds_deduction_paise ' || tds || ' exceeds subtotal ' || (lines_sub + off) END], lambda m: m IS NOT NULL), ' | ') END AS errors
  FROM d)"""


@query("h15_h16_h17_checksum", needs=["invn", "lines"], sql=_DOC_SQL + " SELECT document_id, errors FROM e")
def _(fx):
    docs = checks.with_document(fx.documents_json(), parts=checks.NUMBER_PARTS)
    return docs.select("document_id", F.array_join(checks.checksum_errors(F.col("doc")), " | ").alias("errors"))


@query("b6_b7_b8_h27_extraction", needs=["invn", "lines"], sql=_DOC_SQL + """
SELECT document_id, CASE WHEN k % 37 = 0 THEN 'FAILED' WHEN errors = '' THEN 'VALIDATED' ELSE 'EXCEPTION_FLAGGED' END AS status,
  CASE WHEN k % 37 = 0 THEN 'supplier_details.legal_name' ELSE '' END AS missing,
  invoice_number, CASE WHEN k % 6 = 0 THEN 'CRN' ELSE 'INV' END AS document_type_code, document_date::varchar AS document_date,
  CASE WHEN k % 37 <> 0 THEN supplier_legal_name END AS supplier_legal_name,
  coalesce(lines_sub + tax, 0) AS grand_total_paise, tds AS tds_deduction_paise FROM e""")
def _(fx):
    from ledgerloom.operators.extraction import extract_documents
    return extract_documents(fx.documents_json()).select(
        "document_id", "status", F.array_join("schema_errors", ",").alias("missing"), "invoice_number",
        "document_type_code", F.col("document_date").cast("string").alias("document_date"), "supplier_legal_name",
        "grand_total_paise", "tds_deduction_paise")


@query("h25_date_helpers", needs=["bank"], sql="""
SELECT bank.k, (document_date + 2)::varchar AS expected_date, (day_no + 2) * 86400 AS expected_epoch,
  abs(datediff('day', document_date, transaction_date)) AS days_apart FROM bank JOIN inv USING (k)""")
def _(fx):
    joined = fx.bank().select("k", "transaction_date").join(fx.invoices().select("k", "document_date"), "k")
    expected = dates.expected_bank_date(F.col("document_date"))
    return joined.select("k", expected.cast("string").alias("expected_date"),
                         dates.midnight_epoch(expected).alias("expected_epoch"),
                         dates.days_apart(F.col("transaction_date"), F.col("document_date")).cast("long").alias("days_apart"))


@query("h28_text_caps", sql="""
SELECT doc_id, text[:500] AS error_message, length(text[:500]) AS kept FROM documents""")
def _(fx):
    return fx.table("documents").select("doc_id", labels.capped_error(F.col("text")).alias("error_message"),
                                        F.length(labels.capped_error(F.col("text"))).cast("long").alias("kept"))


@query("h33_date_display", sql="""
SELECT event_id, strftime(ts, '%d %b %Y') AS shown_date, strftime(ts, '%d %b, %H:%M:%S') AS shown_time FROM events""")
def _(fx):
    return fx.table("events").select("event_id", dates.format_date(F.col("ts")).alias("shown_date"),
                                     dates.format_datetime(F.col("ts")).alias("shown_time"))


@query("b23_b29_vendor_records", sql="""
t AS (SELECT c_custkey AS k, '  vend' || CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '_' END || c_custkey || ' ' AS code,
  CASE WHEN c_custkey % 7 = 0 THEN ' x ' ELSE '  ' || c_name || chr(9) || '  Ltd ' END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN 'nobody' ELSE ' ' || c_name || '@Example.COM' END AS email FROM customer)
SELECT k, upper(trim(code)) AS vendor_code, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS vendor_name,
  array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'vendor_code' END, CASE WHEN k % 7 = 0 THEN 'vendor_name' END,
  CASE WHEN k % 11 = 0 THEN 'email' END], lambda m: m IS NOT NULL), ',') AS errors FROM t""")
def _(fx):
    rows = fx.table("customer").selectExpr(
        "c_custkey AS k", "concat('  vend', CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '_' END, c_custkey, ' ') AS code",
        "CASE WHEN c_custkey % 7 = 0 THEN ' x ' ELSE concat('  ', c_name, '\t', '  Ltd ') END AS name",
        "CASE WHEN c_custkey % 11 = 0 THEN 'nobody' ELSE concat(' ', c_name, '@Example.COM') END AS email")
    return rows.select("k", labels.normalize_vendor_code(F.col("code")).alias("vendor_code"),
                       labels.clean_name(F.col("name")).alias("vendor_name"),
                       F.array_join(labels.vendor_record_errors(F.col("code"), F.col("name"), F.col("email")), ","
                                    ).alias("errors"))


@query("b9_document_gate", sql="""
t AS (SELECT page_id, length(html) * 1024 AS size, CASE WHEN page_id % 17 = 3 THEN 'image/gif' ELSE
    ['application/pdf', 'image/jpeg', 'image/png', 'application/pdf'][page_id % 4 + 1] END AS mime,
  ['.PDF', '.jpg', '.jpeg', '.pdf'][page_id % 4 + 1] AS ext, CASE WHEN page_id % 9 = 0 THEN 'other' WHEN page_id % 23 <> 5 THEN 'invoice' END AS label,
  CASE WHEN page_id % 29 <> 3 THEN (page_id % 100) / 100 END AS confidence,
  CASE WHEN page_id % 31 <> 7 THEN regexp_matches(html, '(?i)(invoice|tax|amount due|total|balance)') END AS anchor FROM pages)
SELECT page_id, CASE WHEN size > 1048576 * 1 THEN 'FILE_TOO_LARGE'
  WHEN page_id % 17 = 3 OR page_id % 4 = 2 THEN 'UNSUPPORTED_FILE_TYPE'
  WHEN label IS NULL OR confidence IS NULL OR label <> 'invoice' OR confidence < 0.8 THEN 'INVALID_DOCUMENT_CLASSIFICATION'
  WHEN lower(ext) = '.pdf' AND anchor IS NOT TRUE THEN 'INVALID_DOCUMENT_CLASSIFICATION' END AS error_code FROM t""")
def _(fx):
    rows = fx.table("pages").selectExpr(
        "page_id", "length(html) * 1024 AS size", "html",
        "CASE WHEN page_id % 17 = 3 THEN 'image/gif' ELSE element_at(array('application/pdf', 'image/jpeg', 'image/png',"
        " 'application/pdf'), cast(page_id % 4 + 1 AS int)) END AS mime",
        "element_at(array('.PDF', '.jpg', '.jpeg', '.pdf'), cast(page_id % 4 + 1 AS int)) AS ext",
        "CASE WHEN page_id % 9 = 0 THEN 'other' WHEN page_id % 23 <> 5 THEN 'invoice' END AS label",
        "CASE WHEN page_id % 29 <> 3 THEN (page_id % 100) / 100 END AS confidence",
        "CASE WHEN page_id % 31 <> 7 THEN html END AS searched")
    return rows.select("page_id", labels.document_gate(
        F.col("size"), F.col("mime"), F.col("ext"), F.col("label"), F.col("confidence"),
        labels.has_anchor_word(F.col("searched")), max_mb=1).alias("error_code"))


@query("b11_quality_route", sql="""
t AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) AS x FROM embeddings)
SELECT vec_id, CASE WHEN list_sum(list_transform(x, lambda c: abs(c))) / 16.0 >= 100 AND len(list_filter(x, lambda c: c > 0)) * 100 / 46.0 >= 70
  THEN 'fast' ELSE 'fallback' END AS route FROM t""")
def _(fx):
    """Sharpness and confidence of a page from all components of its vector."""
    x = fx.table("embeddings").select("vec_id", F.expr("transform(embedding, c -> floor(256 * cast(c AS double)))").alias("x"))
    sharp = F.aggregate("x", F.lit(0).cast("bigint"), lambda acc, c: acc + F.abs(c)) / 16.0
    sure = F.size(F.filter("x", lambda c: c > 0)) * 100 / 46.0
    return x.select("vec_id", labels.quality_route(sharp, sure).alias("route"))


_CLASSES = tuple(f"class_{i}" for i in range(64))


@query("h31_softmax_label", sql="""
t AS (SELECT vec_id, embedding AS e, list_max(embedding) AS top FROM embeddings)
SELECT vec_id, 'class_' || (list_position(e, top) - 1) AS label,
  round(1.0 / list_sum(list_transform(e, lambda c: exp(c::double - top::double))), 6) AS confidence FROM t""")
def _(fx):
    top = fx.table("embeddings").select("vec_id", labels.softmax_label(F.col("embedding"), _CLASSES).alias("p"))
    return top.select("vec_id", "p.label", F.round("p.confidence", 6).alias("confidence"))


@query("b25_row_state", needs=["inv", "recs", "tickets"], sql="""
SELECT i.document_id, CASE WHEN r.utr_number IS NOT NULL THEN 'cleared' WHEN t.reason IS NOT NULL THEN 'review' ELSE 'processing' END AS state,
  CASE WHEN r.utr_number IS NOT NULL THEN net_settled_amount_paise ELSE grand_total_paise - tds_deduction_paise END AS shown_paise
FROM inv i LEFT JOIN recs r USING (document_id) LEFT JOIN (SELECT k, min(exception_reason) AS reason FROM tickets GROUP BY 1) t ON t.k = i.k""")
def _(fx):
    reasons = fx.tickets().groupBy("k").agg(F.min("exception_reason").alias("reason"))
    rows = fx.invoices().join(fx.reconciliations().select("document_id", "utr_number", "net_settled_amount_paise"),
                              "document_id", "left").join(reasons, "k", "left")
    state = labels.row_state(F.col("utr_number"), F.col("reason"))
    return rows.select("document_id", state.alias("state"), labels.shown_amount(
        state, F.col("net_settled_amount_paise"), reads.net_paise()).alias("shown_paise"))


@query("b26_exception_wording", needs=["tickets", "batches"], sql="""
SELECT ticket_id, CASE WHEN exception_reason IN ('NO_MATCH', 'AMBIGUOUS_COLLISION') THEN 'Ambiguous settlement for ' ||
    flagged_invoice_ids[1] || ' — routed to the Maker/Checker queue to prevent misallocation.'
  WHEN exception_reason = 'ENTITY_MISMATCH' THEN 'Supplier details for ' || flagged_invoice_ids[1] ||
    ' could not be fully confirmed — parked for manual review.'
  ELSE flagged_invoice_ids[1] || ' requires manual review (' || exception_reason || ').' END AS message,
  CASE WHEN exception_reason IN ('NO_MATCH', 'ENTITY_MISMATCH') THEN 'danger' WHEN exception_reason = 'AMBIGUOUS_COLLISION'
    THEN 'pending' ELSE 'neutral' END AS tone,
  CASE status WHEN 'OPEN' THEN 'danger' WHEN 'IN_REVIEW' THEN 'pending' WHEN 'RESOLVED' THEN 'success' ELSE 'neutral' END AS status_tone
FROM tickets""")
def _(fx):
    inv = F.col("flagged_invoice_ids")[0]
    return fx.tickets().select(
        "ticket_id", labels.exception_text(F.col("exception_reason"), inv).alias("message"),
        labels.reason_tone(F.col("exception_reason")).alias("tone"), labels.status_tone(F.col("status")).alias("status_tone"))


@query("b28_rule_violations", needs=["inv", "bank", "settle"], sql="""
SELECT document_id AS key, 'tds_non_negative' AS rule FROM inv WHERE tds_deduction_paise - 30000 < 0
UNION ALL SELECT transaction_id, 'amount_non_negative' FROM bank WHERE amount_paise - 5000000 < 0
UNION ALL SELECT transaction_id, 'type_known' FROM bank WHERE k % 23 = 0
UNION ALL SELECT payout_id, 'fees_non_negative' FROM settle WHERE fees_paise - 100000 < 0""")
def _(fx):
    inv = fx.invoices().withColumn("tds_deduction_paise", F.col("tds_deduction_paise") - 30000)
    bank = fx.bank().withColumn("amount_paise", F.col("amount_paise") - 5000000).withColumn(
        "closing_balance_paise", F.lit(None).cast("long")).withColumn(
        "transaction_type", F.when(F.col("transaction_type") == "DEBIT", "OTHER").otherwise(F.col("transaction_type")))
    settle = fx.settlements().withColumn("fees_paise", F.col("fees_paise") - 100000)
    return (checks.violations(inv, "document_id", checks.TABLE_RULES["extracted_invoices"])
            .unionByName(checks.violations(bank, "transaction_id", checks.TABLE_RULES["bank_transactions"]))
            .unionByName(checks.violations(settle, "payout_id", checks.TABLE_RULES["settlements"])))


@query("b10_anchor_scan", needs=["page_text"], sql="""
SELECT batch_id, bool_or(page_index < 3 AND regexp_matches(text, '(?i)(invoice|tax|amount due|total|balance)')) AS anchor_found
FROM page_text GROUP BY 1""")
def _(fx):
    hit = (F.col("page_index") < labels.ANCHOR_PAGES) & labels.has_anchor_word(F.col("text"))
    return fx.page_text().groupBy("batch_id").agg(F.bool_or(hit).alias("anchor_found"))


@query("j2_sql_functions", needs=["settle"], sql="""
SELECT payout_id, (amount_paise // 100) || '.' || lpad((amount_paise % 100)::varchar, 2, '0') AS rupees,
  amount_paise AS back, lower(split_part(regexp_replace(narration, '[^A-Za-z0-9]+', ' ', 'g'), ' ', 1)) AS first_token
FROM settle""")
def _(fx):
    from ledgerloom.functions.sqlfuncs import register
    register(fx.spark)
    return fx.settlements(named=True).selectExpr(
        "payout_id", "ll_paise_to_rupees(amount_paise) AS rupees",
        "ll_rupees_to_paise(ll_paise_to_rupees(amount_paise)) AS back", "ll_tokenize(narration)[0] AS first_token")
