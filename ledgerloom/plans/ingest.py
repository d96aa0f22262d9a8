"""Ingestion with replayed input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import ingest
from ledgerloom.plans.registry import query
from ledgerloom.scale import written
from ledgerloom.session import checkpoint_dir
from ledgerloom.sources import files

# Each feed is delivered once, and its rows with k % 7 = 0 a second time; every third key is already stored.
_DELIVERED = "(SELECT *, 1 AS delivery FROM {t} UNION ALL SELECT *, 2 FROM {t} WHERE k % 7 = 0)"


def _replayed(df):
    return df.withColumn("delivery", F.lit(1)).unionByName(df.filter("k % 7 = 0").withColumn("delivery", F.lit(2)))


@query("a1_settlement_ingest", needs=["settle"], sql=f"""
SELECT payout_id, amount_paise, vendor_code, delivery FROM {_DELIVERED.format(t='settle')}
WHERE k % 3 <> 0 AND amount_paise >= 0 QUALIFY row_number() OVER (PARTITION BY payout_id ORDER BY delivery) = 1""")
def _(fx):
    feed = ingest.valid_settlements(_replayed(fx.settlements()))
    stored = fx.settlements().filter("k % 3 = 0")
    return ingest.accepted(feed, stored, ingest.SETTLEMENT_KEY, [F.asc("delivery")]).select(
        "payout_id", "amount_paise", "vendor_code", "delivery")


@query("a2_settlement_status", needs=["settle"], sql=f"""
SELECT payout_id, delivery, CASE WHEN k % 3 = 0 OR delivery = 2 THEN 'duplicate' ELSE 'recorded' END AS ingest_status
FROM {_DELIVERED.format(t='settle')}""")
def _(fx):
    feed = ingest.valid_settlements(_replayed(fx.settlements()))
    stored = fx.settlements().filter("k % 3 = 0")
    return ingest.ingest_status(feed, stored, ingest.SETTLEMENT_KEY, [F.col("delivery")], F.col("payout_id")).select(
        "payout_id", "delivery", "ingest_status")


@query("a3_bank_ingest", needs=["bank"], sql=f"""
d AS (SELECT * FROM {_DELIVERED.format(t='bank')})
SELECT transaction_id, utr_number, transaction_date::varchar AS transaction_date, amount_paise, delivery FROM d
WHERE utr_number IS NULL UNION ALL
SELECT transaction_id, utr_number, transaction_date::varchar, amount_paise, delivery FROM d
WHERE utr_number IS NOT NULL AND k % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY utr_number, transaction_date, amount_paise ORDER BY delivery) = 1""")
def _(fx):
    bank = fx.bank().withColumn("closing_balance_paise", F.lit(None).cast("long"))
    return ingest.accepted(ingest.valid_bank(_replayed(bank)), fx.bank().filter("k % 3 = 0"), ingest.BANK_KEY,
                           [F.asc("delivery")]).select(
        "transaction_id", "utr_number", F.col("transaction_date").cast("string"), "amount_paise", "delivery")


@query("d11_ingest_summary", needs=["bank"], sql=f"""
SELECT vendor_code, count(*) FILTER (fresh) AS accepted, count(*) FILTER (NOT fresh) AS duplicates, 0::bigint AS rejected, count(*) AS total
FROM (SELECT vendor_code, utr_number IS NULL OR (k % 3 <> 0 AND delivery = 1) AS fresh FROM {_DELIVERED.format(t='bank')})
GROUP BY 1""")
def _(fx):
    status = ingest.ingest_status(_replayed(fx.bank()), fx.bank().filter("k % 3 = 0"), ingest.BANK_KEY,
                                  [F.col("delivery")], F.concat_ws(":", "transaction_id", "delivery"))
    return ingest.ingest_summary(status, ["vendor_code"], rejects=True)


# The settlement feed as a file: some lines are no JSON, have a text for an amount, a negative amount, or an array of two.
_FEED_ROWS = f"""
fr AS (SELECT payout_id, CASE k % 20 WHEN 1 THEN 'MALFORMED' WHEN 2 THEN 'WRONG_TYPE' WHEN 3 THEN 'RULE' END AS problem, k, delivery
  FROM {_DELIVERED.format(t='settle')}),
fs AS (SELECT CASE WHEN problem = 'MALFORMED' THEN NULL ELSE payout_id END AS payout_id, problem, CASE WHEN problem IS NOT NULL THEN 'rejected'
    WHEN k % 3 = 0 OR delivery = 2 THEN 'duplicate' ELSE 'recorded' END AS ingest_status FROM fr
  UNION ALL SELECT '', 'RULE', 'rejected' FROM fr WHERE k % 20 = 4)"""


def _feed_file(fx):
    """The feed, written and read again: every element with its status."""
    fields = ["payout_id", "fund_account_id", "amount_paise", "currency", "status", "utr", "reference_id", "narration", "fees_paise",
              "tax_paise", "mode", "purpose", "vendor_code", "event_created_at_epoch"]
    row = F.to_json(F.struct(*fields))
    other = F.to_json(F.struct(*[F.lit("").alias("payout_id") if c == "payout_id" else F.col(c) for c in fields]))
    kind = F.col("k") % 20
    line = (F.when(kind == 1, F.concat(F.lit("{broken "), "payout_id"))
            .when(kind == 2, F.regexp_replace(row, '"amount_paise":[0-9]+', '"amount_paise":"a lot"'))
            .when(kind == 3, F.regexp_replace(row, '"amount_paise":', '"amount_paise":-'))
            .when(kind == 4, F.concat(F.lit("["), row, F.lit(","), other, F.lit("]"))).otherwise(row))
    path = f"{checkpoint_dir(fx.spark)}/feed-{uuid.uuid4().hex}"
    _replayed(fx.settlements()).select(line.alias("value")).write.text(path)
    # The status needs the feed for its first rows, all rows and the rejected ones: parsed once, in narrow files.
    feed = written(ingest.checked(files.read_settlements(fx.spark, path), ingest.SETTLEMENT_RULE).select(
        "payout_id", "problem", F.monotonically_increasing_id().alias("place")))
    stored = fx.settlements().filter("k % 3 = 0")
    return ingest.feed_status(feed, stored, ingest.SETTLEMENT_KEY, [F.col("place")], F.col("place"))


@query("a1_a11_feed_file", needs=["settle"], sql=_FEED_ROWS + " SELECT payout_id, problem, ingest_status FROM fs")
def _(fx):
    return _feed_file(fx).select("payout_id", "problem", "ingest_status")


@query("d11_feed_totals", needs=["settle"], sql=_FEED_ROWS + """
SELECT count(*) FILTER (ingest_status = 'recorded') AS accepted, count(*) FILTER (ingest_status = 'duplicate') AS duplicates,
  count(*) FILTER (ingest_status = 'rejected') AS rejected, count(*) AS total FROM fs""")
def _(fx):
    return ingest.ingest_summary(_feed_file(fx), rejects=True)


@query("c16_new_events", sql="""
SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0""")
def _(fx):
    e = fx.table("events").select("event_id", "user_id")
    replay = e.withColumn("delivery", F.lit(1)).unionByName(e.filter("event_id % 5 = 0").withColumn("delivery", F.lit(2)))
    return ingest.new_events(replay, e.filter("event_id % 3 = 0"), [F.asc("delivery")]).select("event_id", "user_id")


@query("c17_new_pages", needs=["items"], sql="""
SELECT batch_id, row_number AS page_index FROM items WHERE k % 4 <> 0""")
def _(fx):
    items = fx.items()
    pages = items.select("batch_id", F.col("row_number").alias("page_index"))
    return ingest.new_pages(pages, items.filter("k % 4 = 0")).select("batch_id", "page_index")


@query("c18_invoice_gate", needs=["inv"], sql="""
c AS (SELECT document_id, 1 AS delivery, vendor_code, invoice_number, CASE WHEN k % 3 = 0 THEN 'IRN' || (k // 6) END AS irn, k FROM inv
  UNION ALL SELECT document_id || 'x', 2, vendor_code, invoice_number, NULL, k FROM inv WHERE k % 7 = 0),
n AS (SELECT *, k % 5 = 0 OR row_number() OVER (PARTITION BY vendor_code, invoice_number ORDER BY delivery, document_id) > 1 AS dup FROM c),
s AS (SELECT DISTINCT irn FROM c WHERE k % 5 = 0 AND irn IS NOT NULL AND delivery = 1)
SELECT document_id, CASE WHEN dup OR (irn IS NOT NULL AND (irn IN (SELECT irn FROM s) OR row_number() OVER (
  PARTITION BY dup, irn ORDER BY delivery, document_id) > 1)) THEN 'duplicate_invoice' END AS error_type FROM n""")
def _(fx):
    rows = fx.invoices().selectExpr(
        "document_id", "1 AS delivery", "vendor_code", "invoice_number", "CASE WHEN k % 3 = 0 THEN concat('IRN', k div 6) END AS irn", "k")
    again = rows.filter("k % 7 = 0").selectExpr("concat(document_id, 'x') AS document_id", "2 AS delivery", "vendor_code",
                                                "invoice_number", "cast(NULL AS string) AS irn", "k")
    return ingest.invoice_gate(rows.unionByName(again), rows.filter("k % 5 = 0"),
                               [F.col("delivery"), F.col("document_id")]).select("document_id", "error_type")


@query("a13_page_fan_out", needs=["items"], sql="""
SELECT batch_id, row_number AS page_index, batch_id || ':' || row_number AS partition_key,
  'evt_outbox_' || sha256(batch_id || ':' || row_number) AS event_id FROM items""")
def _(fx):
    return ingest.fan_out_pages(fx.batches()).select("batch_id", "page_index", "partition_key", "event_id")


@query("a14_vendor_upsert", sql="""
SELECT 'VEND_' || c_custkey AS vendor_code, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS vendor_name,
  c_custkey % 4 = 0 AND c_custkey % 5 <> 0 AS user_added FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def _(fx):
    c = fx.table("customer").selectExpr("c_custkey", "concat('VEND_', c_custkey) AS vendor_code", "c_name AS vendor_name")
    stored = c.filter("c_custkey % 2 = 0").drop("c_custkey")
    update = c.filter("c_custkey % 3 = 0").withColumn("vendor_name", F.upper("vendor_name")).drop("c_custkey")
    users = c.filter("c_custkey % 5 = 0").select("vendor_code")
    new_users = ingest.insert_or_ignore(users, c.filter("c_custkey % 4 = 0").select("vendor_code"), "vendor_code")
    table = ingest.upsert(stored, update, "vendor_code")
    return table.join(new_users.withColumn("__u", F.lit(True)), "vendor_code", "left").select(
        "vendor_code", "vendor_name", F.coalesce("__u", F.lit(False)).alias("user_added"))


@query("b13_page_triage", needs=["items", "batches"], sql="""
SELECT batch_id, row_number AS page_index, CASE WHEN k % 10 = 0 THEN 'skipped' WHEN k % 11 = 0 THEN 'batch_not_found'
  WHEN k % 13 = 0 THEN 'tenant_mismatch' WHEN k % 17 = 0 THEN 'file_not_found' WHEN k % 19 = 0 THEN 'image_decode_failed'
  ELSE 'process' END AS outcome
FROM (SELECT k, CASE WHEN k % 11 = 0 AND k % 10 <> 0 THEN 'no-' || batch_id ELSE batch_id END AS batch_id, row_number FROM items)""")
def _(fx):
    items = fx.items()
    events = items.selectExpr(
        "k", "CASE WHEN k % 11 = 0 AND k % 10 <> 0 THEN concat('no-', batch_id) ELSE batch_id END AS batch_id",
        "row_number AS page_index", "CASE WHEN k % 13 = 0 THEN 'VEND_OTHER' ELSE vendor_code END AS vendor_code",
        "concat('/pages/', k) AS file_path")
    manifest = fx.invoices().filter("k % 17 <> 0").selectExpr("concat('/pages/', k) AS file_path", "k % 19 <> 0 AS readable")
    return ingest.triage_pages(events, fx.batches(), items.filter("k % 10 = 0"), manifest).select(
        "batch_id", "page_index", "outcome")


@query("a15_k10_record_extractions", needs=["items", "inv", "lines", "invn"], sql="""
agg AS (SELECT k, sum(taxable_value_paise) AS sub, bool_or(l_partkey % 10 = 0) AS line_bad FROM lines GROUP BY k),
st AS (SELECT i.batch_id, i.row_number, inv.document_id, inv.k, inv.invoice_number,
  CASE WHEN inv.k % 37 = 0 THEN 'FAILED' WHEN a.k IS NULL OR line_bad OR inv.k % 7 = 0 OR inv.k % 41 = 0
    OR inv.tds_deduction_paise > sub THEN 'EXCEPTION_FLAGGED' ELSE 'VALIDATED' END AS status
  FROM items i JOIN inv ON inv.k = i.k LEFT JOIN agg a ON a.k = i.k)
SELECT batch_id, row_number, CASE WHEN status <> 'FAILED' THEN document_id END AS document_id,
  CASE WHEN status <> 'FAILED' THEN invoice_number END AS invoice_number, status,
  CASE WHEN status = 'FAILED' THEN 'supplier_details.legal_name' END AS error_message
FROM st WHERE status <> 'FAILED' OR k % 2 <> 0""")
def _(fx):
    from ledgerloom.operators.extraction import extract_documents
    items = fx.items().select("k", "batch_id", F.col("row_number").alias("page_index"))
    # Results are delivered once and read by both outputs: every document is parsed and checked once.
    extracted = written(extract_documents(fx.documents_json()).join(items, "k").drop("checksum_errors"))
    again = extracted.filter("status = 'FAILED' AND k % 3 = 0")
    stored = items.filter("k % 2 = 0 AND k % 37 = 0").selectExpr("batch_id", "page_index AS row_number", "'FAILED' AS status")
    _, rows = ingest.record_extractions(extracted.unionByName(again), stored)
    return rows.select("batch_id", "row_number", "document_id", "invoice_number", "status", "error_message")


@query("b12_event_routing", sql="""
SELECT event_id, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'batch_started' WHEN 'purchase' THEN
  CASE WHEN user_id % 5 = 0 THEN 'extracted_single' ELSE 'extracted_batch' END ELSE 'ignored' END AS route FROM events""")
def _(fx):
    e = fx.table("events").selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN 'batch.page.ingestion' WHEN 'click' THEN 'batch.processing.started'"
        " WHEN 'purchase' THEN 'invoice.extracted' ELSE event_type END AS type",
        "CASE WHEN user_id % 5 <> 0 THEN user_id END AS batch_id")
    return ingest.route_events(e).select("event_id", "route")
