"""Posting, ledger and review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import envelopes, money
from ledgerloom.operators import exceptions, posting, reads
from ledgerloom.plans.registry import query
from ledgerloom.scale import ordinal, previous_value
from ledgerloom.sources.fixtures import KEY_BUCKET


def _nets(fx):
    return fx.invoices().withColumn("net_paise", reads.net_paise())


@query("b15_g4_ledger_guard", needs=["open_inv"], sql="""
SELECT document_id, CASE WHEN k % 10 = 1 THEN 'NOT_MATCHED' WHEN k % 10 = 2 THEN 'UTR_DIFFERS' WHEN k % 10 = 3 THEN 'INVOICES_DIFFER'
  WHEN k % 10 = 4 THEN 'INVOICE_NOT_IN_PROOF' WHEN k % 10 = 5 THEN 'INVALID_PAISE_CASTING' WHEN k % 10 = 6 THEN 'AMOUNT_DIFFERS' END AS guard_reason
FROM open_inv""")
def _(fx):
    rows = fx.open_invoices().withColumn("net_paise", reads.net_paise()).selectExpr(
        "document_id", "CASE WHEN k % 10 = 4 THEN 'INV-X' ELSE invoice_number END AS invoice_number",
        "CASE WHEN k % 10 = 1 THEN 'NO_MATCH' ELSE 'SUBSET_MATCHED' END AS subset_status",
        "'U1' AS matched_utr", "CASE WHEN k % 10 = 2 THEN 'U2' ELSE 'U1' END AS request_utr",
        "array(invoice_number, 'INV-OTHER') AS matched_invoices",
        "CASE WHEN k % 10 = 3 THEN array(invoice_number) ELSE array('INV-OTHER', invoice_number, 'INV-OTHER') END AS request_invoices",
        "net_paise AS proof_paise", "k", "net_paise")
    rows = rows.withColumn("request_amount", F.when(F.expr("k % 10 = 5"), "1,000").when(
        F.expr("k % 10 = 6"), money.paise_to_rupees(F.col("net_paise") + 1)).otherwise(money.paise_to_rupees("net_paise")))
    return posting.ledger_guard(rows).select("document_id", "guard_reason")


@query("b16_amounts_guard", needs=["inv"], sql="""
SELECT document_id, CASE WHEN k % 7 = 1 THEN 'INVOICE_DIFFERS' WHEN k % 7 IN (2, 3) THEN 'AMOUNTS_DIFFER' END AS guard_reason FROM inv""")
def _(fx):
    rows = fx.invoices().withColumns({
        "claimed_invoice": F.expr("CASE WHEN k % 7 = 1 THEN 'INV-X' ELSE invoice_number END"),
        "claimed_grand_total": money.paise_to_rupees(F.expr("grand_total_paise + CASE WHEN k % 7 = 2 THEN 1 ELSE 0 END")),
        "claimed_tds": money.paise_to_rupees(F.expr("tds_deduction_paise + CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END"))})
    return posting.amounts_guard(rows).select("document_id", "guard_reason")


def _proofs(fx):
    """One proof for every two neighbouring invoices of a vendor, and for one that is left over.

    Of every fifth vendor the total is wrong, of every 13th the UTR is missing."""
    inv = ordinal(_nets(fx), ["custkey"], F.expr(f"k div {KEY_BUCKET}"), [F.col("k")], "place").withColumn(
        "half", F.expr("(place - 1) div 2"))
    both = inv.groupBy("vendor_code", "custkey", "half").agg(
        F.array_sort(F.collect_list("invoice_number")).alias("matched_invoices"), F.sum("net_paise").alias("total"))
    return both.selectExpr(
        "concat('proof_', custkey, '_', half) AS proof_id", "vendor_code", "matched_invoices",
        "CASE WHEN custkey % 13 <> 0 THEN concat('U', custkey) END AS matched_utr", "concat('pout_', custkey) AS payout_id",
        "total + CASE WHEN custkey % 5 = 0 THEN 1 ELSE 0 END AS proof_paise")


_PROOFS = """
pk AS (SELECT *, (row_number() OVER (PARTITION BY custkey ORDER BY k) - 1) // 2 AS half FROM inv),
pf AS (SELECT vendor_code, custkey, 'proof_' || custkey || '_' || half AS proof_id,
    list((invoice_number, document_id, grand_total_paise - tds_deduction_paise)) AS ms,
    CASE WHEN custkey % 13 = 0 OR custkey % 5 = 0 THEN 'PREREQUISITE_FAILED'
      WHEN bool_or(document_id IN (SELECT document_id FROM recs)) THEN 'DUPLICATE_EVENT' ELSE 'LEDGER_COMMITTED' END AS status
  FROM pk GROUP BY vendor_code, custkey, half),
pd AS (SELECT proof_id, vendor_code, custkey, unnest(ms) AS m FROM pf WHERE status = 'LEDGER_COMMITTED')
"""


@query("k6_c14_posting", needs=["inv", "recs"], sql=_PROOFS + """
SELECT 'evt_' || sha256(m[2] || '|' || 'U' || custkey) AS idempotency_event_id, m[2] AS document_id, m[1] AS invoice_number, vendor_code,
  'U' || custkey AS utr_number, 'pout_' || custkey AS payout_id, m[3] AS net_settled_amount_paise FROM pd""")
def _(fx):
    posted, _ = posting.post_matches(_proofs(fx), _nets(fx), fx.reconciliations(), F.col("proof_id"))
    return posted


@query("k6_posting_status", needs=["inv", "recs"], sql=_PROOFS + "SELECT proof_id, status AS posting_status FROM pf")
def _(fx):
    _, statuses = posting.post_matches(_proofs(fx), _nets(fx), fx.reconciliations(), F.col("proof_id"))
    return statuses.select("proof_id", "posting_status")


@query("k6_contested_posting", needs=["inv", "recs"], sql="""
o AS (SELECT *, grand_total_paise - tds_deduction_paise AS n, lead(document_id) OVER w AS next_id,
    lead(grand_total_paise - tds_deduction_paise) OVER w AS next_n FROM inv WINDOW w AS (PARTITION BY custkey ORDER BY k)),
p AS (SELECT custkey, k, document_id AS a, coalesce(next_id, document_id) AS b, row_number() OVER (PARTITION BY custkey ORDER BY k % 5, k) AS turn FROM o),
run AS (SELECT custkey, 0 AS turn, []::varchar[] AS used, NULL::bigint AS k, false AS posted FROM (SELECT DISTINCT custkey FROM p)
  UNION ALL SELECT p.custkey, p.turn::int, CASE WHEN x.free THEN run.used || [p.a, p.b] ELSE run.used END, p.k, x.free
  FROM run JOIN p ON p.custkey = run.custkey AND p.turn = run.turn + 1, LATERAL (SELECT NOT list_contains(run.used, p.a) AND NOT list_contains(run.used, p.b)
    AND p.a NOT IN (SELECT document_id FROM recs) AND p.b NOT IN (SELECT document_id FROM recs) AS free) x)
SELECT 'pc_' || k AS proof_id, CASE WHEN posted THEN 'LEDGER_COMMITTED' ELSE 'DUPLICATE_EVENT' END AS posting_status FROM run WHERE k IS NOT NULL""")
def _(fx):
    """Each invoice with the next of its customer is one proof, so that every proof contends with its neighbours."""
    inv, keys = _nets(fx), ["custkey"]
    after = previous_value(inv, keys, -F.expr(f"k div {KEY_BUCKET}"), [-F.col("k")], F.struct("invoice_number", "net_paise"), "after")
    proofs = after.selectExpr(
        "concat('pc_', k) AS proof_id", "k", "vendor_code", "CASE WHEN after IS NULL THEN array(invoice_number) ELSE array(invoice_number, after.invoice_number) END AS matched_invoices",
        "concat('U', k) AS matched_utr", "concat('pout_', k) AS payout_id", "net_paise + coalesce(after.net_paise, 0) AS proof_paise")
    _, statuses = posting.post_matches(proofs, inv, fx.reconciliations(), F.struct(F.expr("k % 5").alias("m"), F.col("k").alias("k")))
    return statuses.select("proof_id", "posting_status")


@query("h24_completed_events", needs=["inv", "recs"], sql=_PROOFS + """
SELECT 'reconciliation.completed.events' AS topic, vendor_code AS key,
  '{"specversion":"1.0","type":"invoice.reconciled","source":"/layer2/agent","id":"evt_' || sha256(m[2] || '|' || 'U' || custkey) ||
  '","time":null,"data":{"vendor_code":"' || vendor_code || '","matched_invoices":["' || m[1] || '"],"razorpay_payout_id":"pout_' || custkey ||
  '","bank_utr_number":"U' || custkey || '","total_reconciled_amount":"' || (m[3] // 100) || '.' || lpad((m[3] % 100)::varchar, 2, '0') || '"}}' AS value
FROM pd""")
def _(fx):
    posted, _ = posting.post_matches(_proofs(fx), _nets(fx), fx.reconciliations(), F.col("proof_id"))
    return posting.completed_events(posted)


def _completed(fx):
    """Completed events for the reconciliations, some broken, every seventh delivered twice."""
    r = fx.reconciliations()
    broken = r.withColumns({
        "vendor": F.expr("CASE WHEN k % 20 = 1 THEN '' ELSE vendor_code END"),
        "list": F.expr("CASE WHEN k % 20 = 2 THEN array() WHEN k % 20 = 3 THEN array(invoice_number, '') ELSE array(invoice_number) END"),
        "total": F.expr("CASE WHEN k % 20 = 4 THEN 'x' END"),
        "debit": F.expr("CASE WHEN k % 20 = 5 THEN '9.00' END")})
    data = F.struct(F.col("vendor").alias("vendor_code"), F.col("list").alias("matched_invoices"),
                    F.col("payout_id").alias("razorpay_payout_id"), F.col("utr_number").alias("bank_utr_number"),
                    F.coalesce("total", money.paise_to_rupees("net_settled_amount_paise")).alias("total_reconciled_amount"),
                    F.col("debit").alias("debit_amount"))
    text = broken.select("k", F.to_json(F.struct(F.lit("/layer2/agent").alias("source"),
                                                 F.col("idempotency_event_id").alias("id"), data.alias("data"))).alias("value"))
    # numbers where texts belong, an explicit null amount, and an amount as a number, which is allowed
    text = text.withColumn("value", F.expr("""CASE k % 20 WHEN 6 THEN regexp_replace(value, '"vendor_code":"[^"]*"', '"vendor_code":77')
      WHEN 7 THEN regexp_replace(value, '"bank_utr_number":"[^"]*"', '"bank_utr_number":123') WHEN 8 THEN regexp_replace(value, '"matched_invoices":."[^"]*".', '"matched_invoices":[55]')
      WHEN 9 THEN replace(value, '}}', ',"debit_amount":null}}')
      WHEN 10 THEN regexp_replace(value, '"total_reconciled_amount":"([0-9.]+)"', '"total_reconciled_amount":$1') ELSE value END"""))
    return text.unionByName(text.filter("k % 7 = 0"))


_PARSED = """
pe AS (SELECT *, CASE WHEN utr_number IS NULL OR k % 20 IN (1, 2, 3, 6, 7, 8, 9) THEN 'MALFORMED_PAYLOAD' WHEN k % 20 = 4 THEN 'INVALID_PAISE_CASTING'
  WHEN k % 20 = 5 THEN 'ORPHANED_DEBIT_CREDIT_MISMATCH' END AS error_code FROM recs),
good AS (SELECT * FROM pe WHERE error_code IS NULL AND k % 9 <> 0)
"""


def _records(fx):
    parsed = posting.parse_completed(_completed(fx))
    processed = fx.reconciliations().filter("k % 9 = 0").select(F.col("idempotency_event_id").alias("event_id"))
    return posting.new_records(parsed, processed)


@query("b14_completed_validation", needs=["recs"], sql=_PARSED + """
SELECT idempotency_event_id AS event_id, error_code, count(*) * CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS deliveries FROM pe GROUP BY 1, 2, k""")
def _(fx):
    return posting.parse_completed(_completed(fx)).groupBy("event_id", "error_code").agg(F.count(F.lit(1)).alias("deliveries"))


@query("h32_g1_ledger_lines", needs=["recs"], sql=_PARSED + """
SELECT sha256(idempotency_event_id) AS batch_id, t.account_type, CASE WHEN t.entry_type = 'DEBIT' THEN t.account_name || vendor_code ELSE t.account_name END AS account_name,
  t.entry_type, net_settled_amount_paise AS amount_paise, utr_number, invoice_number AS cleared FROM good,
  (VALUES ('LIABILITY', 'Accounts Payable - ', 'DEBIT'), ('ASSET', 'HDFC Corporate Current Account', 'CREDIT')) t(account_type, account_name, entry_type)""")
def _(fx):
    return posting.ledger_lines(_records(fx)).select(
        "batch_id", "account_type", "account_name", "entry_type", "amount_paise", "utr_number",
        F.array_join("cleared_invoice_ids", ",").alias("cleared"))


@query("c13_d9_headers_with_lines", needs=["recs"], sql=_PARSED + """
SELECT sha256(idempotency_event_id) AS batch_id, vendor_code, net_settled_amount_paise AS total_reconciled_amount_paise, net_settled_amount_paise AS debit_paise,
  net_settled_amount_paise AS credit_paise, 0::bigint AS imbalance_paise, 2::int AS n_lines FROM good""")
def _(fx):
    records = _records(fx)
    return posting.headers_with_lines(posting.ledger_headers(records), posting.ledger_lines(records)).select(
        "batch_id", "vendor_code", "total_reconciled_amount_paise", "debit_paise", "credit_paise", "imbalance_paise",
        F.size("lines").alias("n_lines"))


@query("d10_ledger_totals", needs=["recs"], sql=_PARSED + """
SELECT count(*) AS batches, sum(net_settled_amount_paise)::bigint AS debit_paise, sum(net_settled_amount_paise)::bigint AS credit_paise, 0::bigint AS imbalance_paise FROM good""")
def _(fx):
    records = _records(fx)
    return posting.ledger_totals(posting.headers_with_lines(posting.ledger_headers(records), posting.ledger_lines(records)))


@query("f2_newest_headers", needs=["recs"], sql=_PARSED + """
SELECT sha256(idempotency_event_id) AS batch_id, vendor_code, utr_number, reconciled_epoch AS created_epoch FROM good
ORDER BY created_epoch DESC, batch_id LIMIT 50""")
def _(fx):
    headers = posting.ledger_headers(_records(fx)).join(
        fx.reconciliations().select("idempotency_event_id", F.col("reconciled_epoch").alias("created_epoch")), "idempotency_event_id")
    return reads.newest_headers(headers).select("batch_id", "vendor_code", "utr_number", "created_epoch")


@query("a9_fatal_side_output", needs=["recs"], sql=_PARSED + """
SELECT 'ledger.fatal.dlq.events' AS topic, error_code AS key, error_code, idempotency_event_id AS event_id, true AS whole
FROM pe WHERE error_code IS NOT NULL""")
def _(fx):
    parsed = posting.parse_completed(_completed(fx).dropDuplicates(["value"]))
    part = lambda path: F.get_json_object("value", path)
    return posting.fatal_events(parsed).select(
        "topic", "key", part("$.data.error_code").alias("error_code"), part("$.data.details.event_id").alias("event_id"),
        (F.get_json_object(part("$.data.original_event"), "$.id") == part("$.data.details.event_id")).alias("whole"))


def _reviews(fx):
    return fx.open_invoices().withColumn("utr", fx._utr()).selectExpr(
        "k", "vendor_code", "document_id", "invoice_number", "utr",
        "element_at(array('NO_MATCH', 'AMBIGUOUS_COLLISION', '  '), cast(k % 3 + 1 AS int)) AS review_reason",
        "CASE k % 4 WHEN 0 THEN concat(k, '.5') WHEN 1 THEN 'garbage' WHEN 2 THEN '-5' END AS variance",
        "CASE WHEN k % 6 <> 0 THEN concat('review ', invoice_number) END AS message")


_TICKETS = """
rv AS (SELECT *, CASE k % 3 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'AMBIGUOUS_COLLISION' ELSE 'REASON_UNSPECIFIED' END AS reason FROM open_inv)
"""


@query("k7_h26_tickets_from_review", needs=["open_inv"], sql=_TICKETS + """
SELECT 'evt_' || sha256(document_id || '|' || reason) AS source_event_id, vendor_code, utr AS bank_utr_number, invoice_number AS flagged,
  reason AS exception_reason, CASE WHEN k % 4 = 0 THEN k * 100 + 50 END AS variance_delta_paise,
  CASE WHEN k % 6 <> 0 THEN 'review ' || invoice_number ELSE 'No message provided.' END AS human_readable_message
FROM rv WHERE k % 9 <> 0""")
def _(fx):
    events = exceptions.exception_events(_reviews(fx))
    replay = events.unionByName(events.filter("length(value) % 2 = 0"))
    done = _reviews(fx).filter("k % 9 = 0").select(envelopes.event_id(
        F.col("document_id"), F.coalesce(F.nullif(F.trim("review_reason"), F.lit("")), F.lit("REASON_UNSPECIFIED"))).alias("event_id"))
    return exceptions.new_tickets(exceptions.tickets_from_dlq(replay), done).select(
        "source_event_id", "vendor_code", "bank_utr_number", F.array_join("flagged_invoice_ids", ",").alias("flagged"),
        "exception_reason", "variance_delta_paise", "human_readable_message")


@query("g2_tickets_both_sources", needs=["open_inv", "recs"], sql=_PARSED.rstrip() + "," + _TICKETS + """
SELECT source_topic, exception_reason, count(*) AS n, sum(variance)::bigint AS variance_paise FROM (
  SELECT 'reconciliation.dlq.events' AS source_topic, reason AS exception_reason, CASE WHEN k % 4 = 0 THEN k * 100 + 50 END AS variance FROM rv
  UNION ALL SELECT 'ledger.fatal.dlq.events', error_code, CASE WHEN error_code LIKE 'ORPHANED%' THEN 900 - net_settled_amount_paise END
  FROM pe WHERE error_code IS NOT NULL) GROUP BY 1, 2""")
def _(fx):
    fatal = exceptions.tickets_from_fatal(posting.parse_completed(_completed(fx)))
    both = exceptions.tickets_from_dlq(exceptions.exception_events(_reviews(fx))).unionByName(fatal)
    none = fx.spark.createDataFrame([], "event_id string")
    return exceptions.new_tickets(both, none).groupBy("source_topic", "exception_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("variance_delta_paise").alias("variance_paise"))


@query("b22_ticket_moves", needs=["tickets"], sql="""
m AS (SELECT *, CASE WHEN k % 5 <> 4 THEN ['OPEN', 'IN_REVIEW', 'RESOLVED', 'CLOSED'][k // 4 % 4 + 1] END AS new_status FROM tickets),
j AS (SELECT *, coalesce((status = 'OPEN' AND new_status = 'IN_REVIEW') OR (status = 'IN_REVIEW' AND new_status IN ('RESOLVED', 'CLOSED')), false) AS ok FROM m)
SELECT ticket_id, CASE WHEN ok THEN new_status ELSE status END AS status,
  CASE WHEN new_status IS NOT NULL THEN CASE WHEN ok THEN 'allowed' ELSE 'rejected' END END AS move_result,
  CASE WHEN ok AND new_status IN ('RESOLVED', 'CLOSED') THEN 'user_' || k ELSE resolved_by END AS resolved_by,
  CASE WHEN ok AND new_status IN ('RESOLVED', 'CLOSED') THEN created_epoch + 60 ELSE resolved_epoch END AS resolved_epoch FROM j""")
def _(fx):
    t = fx.tickets()
    moves = t.filter("k % 5 <> 4").selectExpr(
        "ticket_id", "element_at(array('OPEN', 'IN_REVIEW', 'RESOLVED', 'CLOSED'), cast(k div 4 % 4 + 1 AS int)) AS new_status",
        "concat('user_', k) AS moved_by", "created_epoch + 60 AS moved_epoch")
    return exceptions.move_tickets(t, moves).select("ticket_id", "status", "move_result", "resolved_by", "resolved_epoch")


@query("b18_exception_guard", needs=["open_inv"], sql="""
SELECT k % 4 = 0 AS refused, count(*) AS n FROM open_inv GROUP BY 1""")
def _(fx):
    from ledgerloom.tools import route
    reviews = _reviews(fx).withColumn("subset_status", F.expr("CASE WHEN k % 4 = 0 THEN 'SUBSET_MATCHED' ELSE 'NO_MATCH' END"))
    events, refused = route(reviews)
    return events.select(F.lit(False).alias("refused")).unionByName(refused.select(F.lit(True).alias("refused"))).groupBy(
        "refused").agg(F.count(F.lit(1)).alias("n"))


@query("b19_exception_reason", needs=["inv"], sql="""
SELECT document_id, CASE WHEN k % 5 = 0 THEN 'NO_MATCH' WHEN k % 5 = 1 THEN 'AMBIGUOUS_COLLISION' WHEN k % 3 = 0 THEN 'ENTITY_MISMATCH'
  WHEN k % 2 = 0 THEN 'NEGATIVE_NET_SETTLEMENT' ELSE 'REASON_UNSPECIFIED' END AS reason FROM inv""")
def _(fx):
    from ledgerloom.functions.labels import exception_reason
    rows = fx.invoices().selectExpr(
        "document_id", "CASE k % 5 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'AMBIGUOUS_COLLISION' WHEN 2 THEN 'SUBSET_MATCHED' END AS s",
        "CASE WHEN k % 3 = 0 THEN 'ENTITY_MISMATCH' WHEN k % 3 = 1 THEN 'ENTITY_RESOLVED' END AS f",
        "CASE WHEN k % 2 = 0 THEN 'NEGATIVE_NET_SETTLEMENT' WHEN k % 7 = 0 THEN 'WATERFALL_CALCULATED' END AS w")
    return rows.select("document_id", exception_reason(F.col("s"), F.col("f"), F.col("w")).alias("reason"))
