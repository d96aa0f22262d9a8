"""Reads, predicates, joins and top-k reports over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import reads
from ledgerloom.plans.registry import query
from ledgerloom.scale import ordinal

VENDOR = "VEND_000042"


@query("b1_b4_net_positive", needs=["inv"], sql="""
SELECT document_id, vendor_code, grand_total_paise - tds_deduction_paise AS net_paise FROM inv
WHERE grand_total_paise - tds_deduction_paise > 0""")
def _(fx):
    return reads.positive_net(fx.invoices()).select("document_id", "vendor_code", reads.net_paise().alias("net_paise"))


@query("b2_tenant_scope", needs=["inv"], sql=f"""
SELECT vendor_code, document_id, invoice_number FROM inv WHERE vendor_code = '{VENDOR}'""")
def _(fx):
    return reads.tenant(fx.invoices(), VENDOR).select("vendor_code", "document_id", "invoice_number")


@query("b3_run_list_status", needs=["inv"], sql="""
SELECT processing_status, count(*) AS n FROM inv WHERE processing_status IN ('VALIDATED', 'EXCEPTION_FLAGGED') GROUP BY 1""")
def _(fx):
    return reads.run_list(fx.invoices()).groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


@query("b5_optional_filters", needs=["tickets"], sql="""
SELECT ticket_id, status, exception_reason FROM tickets WHERE status = 'OPEN'""")
def _(fx):
    return reads.optional_filter(fx.tickets(), status="OPEN", exception_reason=None).select(
        "ticket_id", "status", "exception_reason")


@query("c1_unmatched_credits", needs=["credits"], sql="""
SELECT transaction_id, vendor_code, utr_number, amount_paise, transaction_date::varchar AS transaction_date FROM credits""")
def _(fx):
    return reads.unmatched_credits(fx.bank(), fx.reconciliations()).select(
        "transaction_id", "vendor_code", "utr_number", "amount_paise", F.col("transaction_date").cast("string"))


@query("c2_open_invoices", needs=["open_inv"], sql="""
SELECT document_id, vendor_code, invoice_number, supplier_legal_name,
  grand_total_paise - tds_deduction_paise AS net_paise FROM open_inv""")
def _(fx):
    return fx.open_invoices(named=True).select(
        "document_id", "vendor_code", "invoice_number", "supplier_legal_name", reads.net_paise().alias("net_paise"))


@query("c3_batch_feed_list", needs=["items", "open_inv"], sql="""
SELECT batch_id, items.row_number, items.document_id, open_inv.invoice_number,
  grand_total_paise - tds_deduction_paise AS net_paise
FROM items JOIN open_inv USING (document_id) WHERE grand_total_paise - tds_deduction_paise > 0""")
def _(fx):
    return reads.batch_open_invoices(fx.items(), fx.open_invoices()).select(
        "batch_id", "row_number", "document_id", "invoice_number", reads.net_paise().alias("net_paise"))


@query("c3_batch_run_list", needs=["items", "inv"], sql="""
SELECT batch_id, items.row_number, items.document_id, processing_status FROM items JOIN inv USING (document_id)
WHERE processing_status IN ('VALIDATED', 'EXCEPTION_FLAGGED')""")
def _(fx):
    return reads.batch_run_list(fx.items(), fx.invoices()).select(
        "batch_id", "row_number", "document_id", "processing_status")


@query("c5_f5_items_of_batch", needs=["items", "batches"], sql="""
SELECT i.batch_id, i.row_number, i.invoice_number, i.status, b.status AS batch_status
FROM items i JOIN batches b ON b.batch_id = i.batch_id AND b.vendor_code = i.vendor_code""")
def _(fx):
    return reads.by_row_number(reads.items_with_batch(fx.items(), fx.batches()).select(
        "batch_id", "row_number", "invoice_number", "status", "batch_status"))


@query("c6_runnable_batches", needs=["batches", "runs"], sql="""
SELECT batch_id, vendor_code, total_invoices, completed_epoch FROM batches
WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM runs WHERE runs.batch_id = batches.batch_id)
ORDER BY completed_epoch NULLS LAST, batch_id LIMIT 5""")
def _(fx):
    return reads.runnable_batches(fx.batches(), fx.runs()).select(
        "batch_id", "vendor_code", "total_invoices", "completed_epoch")


@query("c7_b20_anchor_and_target", needs=["settle", "open_inv"], sql="""
best AS (SELECT * FROM settle WHERE status = 'processed' QUALIFY row_number() OVER (
  PARTITION BY vendor_code, reference_id ORDER BY ingested_epoch DESC, payout_id DESC) = 1)
SELECT o.invoice_number, o.vendor_code, b.payout_id AS anchor_payout_id, b.utr AS anchor_utr,
  CASE WHEN b.utr IS NOT NULL THEN b.amount_paise END AS anchor_amount_paise, b.fees_paise + b.tax_paise AS anchor_gateway_paise,
  CASE WHEN b.utr IS NOT NULL AND b.amount_paise <> 0 THEN b.amount_paise
    ELSE greatest(0, grand_total_paise - tds_deduction_paise) END AS target_paise
FROM open_inv o LEFT JOIN best b ON b.vendor_code = o.vendor_code AND b.reference_id = o.invoice_number""")
def _(fx):
    invoices = fx.open_invoices().withColumn("net_paise", reads.net_paise())
    return reads.with_anchor(invoices, fx.settlements()).select(
        "invoice_number", "vendor_code", "anchor_payout_id", "anchor_utr", "anchor_amount_paise",
        "anchor_gateway_paise", "target_paise")


@query("c8_three_way_chain", needs=["settle", "open_inv", "credits"], sql="""
best AS (SELECT * FROM settle WHERE status = 'processed' QUALIFY row_number() OVER (
  PARTITION BY vendor_code, reference_id ORDER BY ingested_epoch DESC, payout_id DESC) = 1)
SELECT o.invoice_number, b.payout_id AS anchor_payout_id, c.transaction_id, c.amount_paise AS credit_amount_paise
FROM open_inv o JOIN best b ON b.vendor_code = o.vendor_code AND b.reference_id = o.invoice_number
JOIN credits c ON c.vendor_code = o.vendor_code AND c.utr_number = b.utr""")
def _(fx):
    invoices = fx.open_invoices().withColumn("net_paise", reads.net_paise())
    credits = reads.unmatched_credits(fx.bank(), fx.reconciliations())
    return reads.three_way_chain(reads.with_anchor(invoices, fx.settlements()), credits).select(
        "invoice_number", "anchor_payout_id", "transaction_id", "credit_amount_paise")


@query("c15_onboarded_vendors", needs=["settle"], sql="""
SELECT vendor_code IN (SELECT 'VEND_' || lpad(c_custkey::varchar, greatest(6, length(c_custkey::varchar))::int, '0') FROM customer WHERE c_acctbal >= 0) AS onboarded,
  count(*) AS n, sum(amount_paise)::bigint AS amount_paise FROM settle GROUP BY 1""")
def _(fx):
    vendors = fx.table("customer").filter("c_acctbal >= 0").selectExpr(
        "concat('VEND_', lpad(cast(c_custkey AS string), greatest(6, length(cast(c_custkey AS string))), '0')) AS vendor_code")
    kept, rejected = reads.onboarded_only(fx.settlements(), vendors)
    return kept.withColumn("onboarded", F.lit(True)).unionByName(rejected.withColumn("onboarded", F.lit(False))).groupBy(
        "onboarded").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("amount_paise"))


@query("c19_already_committed", needs=["inv", "recs"], sql="""
SELECT document_id, document_id IN (SELECT document_id FROM recs) AS already_committed FROM inv""")
def _(fx):
    return reads.with_reconciled_flag(fx.invoices(), fx.reconciliations()).select("document_id", "already_committed")


@query("c20_b27_batch_summary", needs=["batches", "runs"], sql="""
SELECT b.batch_id, b.vendor_code, b.status, b.total_invoices, r.status AS run_status, r.matched_count,
  r.status IS NULL OR r.status IN ('SEALED', 'RUNNING') AS run_active
FROM batches b LEFT JOIN runs r ON r.batch_id = b.batch_id AND r.vendor_code = b.vendor_code""")
def _(fx):
    return reads.batch_summary(fx.batches(), fx.runs()).select(
        "batch_id", "vendor_code", "status", "total_invoices", "run_status", "matched_count", "run_active")


@query("e6_latest_batch", needs=["batches"], sql="""
SELECT vendor_code, batch_id, status FROM batches
QUALIFY row_number() OVER (PARTITION BY vendor_code ORDER BY created_epoch DESC, batch_id) = 1""")
def _(fx):
    return reads.latest_batch(fx.batches()).select("vendor_code", "batch_id", "status")


@query("e6_latest_completed_batch", needs=["batches"], sql="""
SELECT vendor_code, batch_id, completed_epoch FROM batches WHERE status = 'COMPLETED'
QUALIFY row_number() OVER (PARTITION BY vendor_code ORDER BY completed_epoch DESC NULLS LAST, created_epoch DESC, batch_id) = 1""")
def _(fx):
    return reads.latest_completed_batch(fx.batches()).select("vendor_code", "batch_id", "completed_epoch")


@query("e6_lead_user", sql="""
SELECT 'NATION_' || c_nationkey AS vendor_code, lower(c_name) AS email, CASE WHEN c_custkey % 11 = 3 THEN 'ADMIN' ELSE 'STAFF' END AS role
FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 11 = 3 THEN 0 ELSE 1 END,
  round(c_acctbal)::bigint, lower(c_name)) = 1""")
def _(fx):
    users = fx.table("customer").selectExpr(
        "concat('NATION_', c_nationkey) AS vendor_code", "lower(c_name) AS email",
        "CASE WHEN c_custkey % 11 = 3 THEN 'ADMIN' ELSE 'STAFF' END AS role",
        "cast(round(c_acctbal) AS bigint) AS created_epoch")
    return reads.lead_user(users).select("vendor_code", "email", "role")


@query("e7_newest_settlements", needs=["settle"], sql="""
SELECT vendor_code, payout_id, utr, amount_paise FROM settle WHERE utr IS NOT NULL AND narration <> ''
QUALIFY row_number() OVER (PARTITION BY vendor_code ORDER BY ingested_epoch DESC, payout_id DESC) <= 20""")
def _(fx):
    return reads.newest_narrated_settlements(fx.settlements(named=True)).select(
        "vendor_code", "payout_id", "utr", "amount_paise")


@query("f1_newest_tickets", needs=["tickets"], sql="""
SELECT ticket_id, status, exception_reason, created_epoch FROM tickets WHERE status = 'OPEN'
ORDER BY created_epoch DESC, ticket_id LIMIT 50""")
def _(fx):
    return reads.newest_tickets(fx.tickets(), status="OPEN", limit=50).select(
        "ticket_id", "status", "exception_reason", "created_epoch")


@query("f4_stale_runs", needs=["runs"], sql="""
SELECT batch_id, vendor_code, run_type FROM runs WHERE status IN ('SEALED', 'RUNNING')
  AND (started_epoch IS NULL OR started_epoch < 1000000000 - 900) ORDER BY created_epoch, batch_id LIMIT 5""")
def _(fx):
    return reads.stale_runs(fx.runs(), 1_000_000_000).select("batch_id", "vendor_code", "run_type")


@query("b24_batch_id_format", needs=["batches"], sql="""
SELECT id, regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS valid
FROM (SELECT batch_id AS id FROM batches UNION ALL SELECT DISTINCT vendor_code FROM batches)""")
def _(fx):
    ids = fx.batches().select(F.col("batch_id").alias("id")).union(fx.batches().select("vendor_code").distinct())
    return ids.select("id", reads.is_uuid(F.col("id")).alias("valid"))


@query("f9_numeric_page_order", sql="""
SELECT file_name, page_index, row_number() OVER (ORDER BY page_index) AS position FROM (
SELECT 'page_' || page_id || '.jpg' AS file_name, page_id AS page_index FROM pages)""")
def _(fx):
    files = fx.table("pages").select(F.concat(F.lit("page_"), "page_id", F.lit(".jpg")).alias("file_name")).withColumn(
        "page_index", F.regexp_extract("file_name", r"page_(\d+)\.", 1).cast("bigint")).withColumn("g", F.lit(0))
    return ordinal(files, ["g"], F.expr("page_index div 4096"), [F.col("page_index")], "position").drop("g")
