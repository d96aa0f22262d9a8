"""The fixture tables again, as DuckDB SQL: the independent half of every check."""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "inv": ([], """
SELECT o_orderkey AS k, o_custkey AS custkey, o_orderkey::varchar AS document_id,
  'VEND_' || lpad(o_custkey::varchar, greatest(6, length(o_custkey::varchar))::int, '0') AS vendor_code,
  'INV-' || lpad(o_orderkey::varchar, greatest(8, length(o_orderkey::varchar))::int, '0') AS invoice_number,
  o_orderdate::date AS document_date,
  round(o_totalprice * 100)::bigint AS grand_total_paise,
  round(o_totalprice * 100)::bigint // 50 AS tds_deduction_paise,
  CASE WHEN o_orderstatus = 'P' THEN 'EXCEPTION_FLAGGED' ELSE 'VALIDATED' END AS processing_status,
  (floor(o_totalprice / 50000)::bigint + 1) * 1000000 AS coarse_net_paise,
  datediff('day', date '1970-01-01', o_orderdate::date)::bigint AS day_no,
  CASE WHEN o_orderkey % 13 <> 0 THEN (300000000001 + o_orderkey)::varchar END AS utr
FROM orders"""),
    "invn": (["inv"], """
SELECT inv.*, coalesce(p_name || ' Pvt Ltd', 'unknown Pvt Ltd') AS supplier_legal_name
FROM inv LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1) l ON l.l_orderkey = inv.k
LEFT JOIN part ON p_partkey = pk"""),
    "settle_now": (["invn"], """
SELECT k, 'pout_' || k AS payout_id, 'fa_' || k AS fund_account_id,
  grand_total_paise - tds_deduction_paise AS amount_paise,
  CASE WHEN k % 17 = 0 THEN 'failed' ELSE 'processed' END AS status, utr, invoice_number AS reference_id,
  CASE WHEN k % 3 = 0 THEN 'IMPS/' || (300000000001 + k)::varchar || '/HDFC/' ||
      replace(replace(upper(supplier_legal_name), 'WIDGET', 'WIDGIT'), 'PLATE', 'PLAITE')
    ELSE upper(supplier_legal_name) || ' - PAYOUT ' || invoice_number END AS narration,
  (grand_total_paise - tds_deduction_paise) // 100 AS fees_paise,
  (grand_total_paise - tds_deduction_paise) // 100 * 18 // 100 AS tax_paise,
  vendor_code, day_no * 86400 AS event_created_at_epoch, day_no * 86400 + 3 * 86400 + k % 86400 AS ingested_epoch
FROM invn WHERE k % 5 <> 0"""),
    "settle": (["settle_now"], """
SELECT * FROM settle_now UNION ALL
SELECT * REPLACE (payout_id || '_old' AS payout_id, ingested_epoch - 86400 AS ingested_epoch)
FROM settle_now WHERE k % 19 = 0"""),
    "bank": (["invn"], """
SELECT k, 'btx_' || k AS transaction_id, document_date + (2 + k % 12)::int AS transaction_date,
  'NEFT/' || coalesce(utr, '0') || '/HDFC/' || upper(supplier_legal_name) AS narration, utr AS utr_number,
  CASE WHEN k % 23 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type,
  grand_total_paise - tds_deduction_paise - CASE WHEN k % 29 = 0 THEN 100 ELSE 0 END AS amount_paise,
  coarse_net_paise AS coarse_amount_paise, vendor_code
FROM invn WHERE k % 5 <> 0"""),
    "recs": (["inv"], """
SELECT k, 'evt_' || k AS idempotency_event_id, document_id, invoice_number, vendor_code, utr AS utr_number,
  'pout_' || k AS payout_id, grand_total_paise - tds_deduction_paise AS net_settled_amount_paise,
  day_no * 86400 + 20 * 86400 AS reconciled_epoch
FROM inv WHERE processing_status = 'VALIDATED' AND k % 11 = 0"""),
    "open_inv": (["invn", "recs"], """
SELECT * FROM invn WHERE processing_status = 'VALIDATED'
  AND NOT EXISTS (SELECT 1 FROM recs WHERE recs.document_id = invn.document_id)"""),
    "credits": (["bank", "recs"], """
SELECT * FROM bank WHERE transaction_type = 'CREDIT' AND NOT EXISTS
  (SELECT 1 FROM recs WHERE recs.vendor_code = bank.vendor_code AND recs.utr_number = bank.utr_number)"""),
    "items": (["inv"], """
SELECT k, batch_id, vendor_code, CASE WHEN k % 31 <> 0 THEN document_id END AS document_id,
  row_number() OVER (PARTITION BY batch_id ORDER BY k) - 1 AS row_number,
  CASE WHEN k % 31 <> 0 THEN invoice_number END AS invoice_number,
  CASE WHEN k % 31 = 0 THEN 'FAILED' ELSE processing_status END AS status,
  CASE WHEN k % 31 = 0 THEN 'extraction failed for ' || invoice_number END AS error_message
FROM (SELECT *, '00000000-0000-4000-800' || k % 3 || '-' || lpad(custkey::varchar, greatest(12, length(custkey::varchar))::int, '0') AS batch_id FROM inv)"""),
    "batches": (["inv"], """
SELECT '00000000-0000-4000-800' || k % 3 || '-' || lpad(custkey::varchar, greatest(12, length(custkey::varchar))::int, '0') AS batch_id, vendor_code, custkey,
  count(*) AS total_invoices, count(*) FILTER (k % 31 <> 0) AS processed_count,
  count(*) FILTER (k % 31 = 0) AS failed_count,
  CASE WHEN custkey % 7 <> 0 THEN 'COMPLETED' ELSE 'PENDING' END AS status,
  (min(day_no) - 1) * 86400 AS created_epoch,
  CASE WHEN custkey % 7 <> 0 AND custkey % 9 <> 0 THEN (max(day_no) + 1) * 86400 END AS completed_epoch
FROM inv GROUP BY 1, 2, 3"""),
    "runs": (["batches"], """
SELECT batch_id, vendor_code, 'BATCH' AS run_type,
  ['SEALED', 'RUNNING', 'COMPLETED', 'PARTIAL', 'RUNNING'][custkey % 5 + 1] AS status,
  total_invoices AS total_extracted, processed_count AS matched_count, failed_count AS exception_count,
  created_epoch, CASE WHEN custkey % 5 <> 0 THEN created_epoch + custkey % 4 * 600 END AS started_epoch
FROM batches WHERE custkey % 3 <> 0"""),
    "tickets": (["open_inv"], """
SELECT k, 'tkt_' || k || tag AS ticket_id, vendor_code, [invoice_number] AS flagged_invoice_ids,
  ['NO_MATCH', 'AMBIGUOUS_COLLISION', 'ENTITY_MISMATCH', 'NEGATIVE_NET_SETTLEMENT', 'REASON_UNSPECIFIED']
    [(k + shift) % 5 + 1] AS exception_reason,
  ['OPEN', 'IN_REVIEW', 'RESOLVED', 'CLOSED'][k % 4 + 1] AS status,
  CASE WHEN k % 4 > 1 THEN 'clerk_' || k % 7 END AS resolved_by, CASE WHEN k % 4 > 1 THEN k + 9 END AS resolved_epoch,
  day_no * 86400 + days * 86400 AS created_epoch
FROM open_inv, (VALUES ('a', 0, 10, 29), ('b', 2, 20, 58)) v(tag, shift, days, m) WHERE k % m = 0"""),
    "lines": ([], """
SELECT *, taxable_value_paise + igst_paise + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS total_paise FROM (
SELECT *, unit_price_paise * quantity AS taxable_value_paise, unit_price_paise * quantity * gst_rate // 100 AS igst_paise
FROM (SELECT l_orderkey AS k, l_partkey, l_quantity::bigint AS quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_number,
  round(l_extendedprice * 100)::bigint // l_quantity::bigint AS unit_price_paise, round(l_tax * 100)::bigint AS gst_rate
FROM lineitem))"""),
    "page_text": ([], """
SELECT conv_id::varchar AS batch_id, turn AS page_index,
  CASE WHEN turn % 3 = 0 THEN 'TAX INVOICE Invoice No: INV-' || conv_id || '-' || turn || ' ' ELSE '' END ||
  CASE WHEN turn % 4 = 1 THEN 'GSTIN 27ABCDE' || lpad(((conv_id + turn) % 10000)::varchar, 4, '0') || 'F1Z5 ' ELSE '' END ||
  CASE WHEN turn % 5 = 2 THEN 'Grand Total 10 Authorized Signatory ' ELSE '' END ||
  CASE WHEN turn % 7 = 4 THEN 'bank details ' ELSE '' END ||
  CASE WHEN conv_id % 20 = 0 AND turn = 0 THEN 'cover sheet ' ELSE '' END || text AS text
FROM conversations"""),
    "pii_text": ([], """
SELECT doc_id, text ||
  CASE WHEN doc_id % 2 = 0 THEN ' PAN ABCDE' || lpad((doc_id % 50)::varchar, 4, '0') || 'F' ELSE '' END ||
  CASE WHEN doc_id % 3 = 0 THEN ' account no ' || (50100000000000 + doc_id % 40) ELSE '' END ||
  CASE WHEN doc_id % 4 = 0 THEN ' IFSC HDFC0' || lpad((doc_id % 30)::varchar, 6, '0') ELSE '' END ||
  CASE WHEN doc_id % 5 = 0 THEN repeat(' filler', 14) || ' amount ' || (7000000000000 + doc_id) ELSE '' END AS text
FROM documents"""),
    "telemetry": ([], """
WITH once AS (SELECT event_id, user_id::varchar AS batch_id, (event_id % 20)::varchar AS invoice,
  epoch_us(ts) AS ts_us,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'deterministic' WHEN 'click' THEN 'tool_called'
    WHEN 'error' THEN 'agent' ELSE 'terminal' END AS stage,
  CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'run_fuzzy_text_linker_tool'
      ELSE 'run_subset_sum_matching_tool' END
    WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'run_subset_sum_matching_tool -> NO_MATCH'
      ELSE 'run_subset_sum_matching_tool -> SUBSET_MATCHED' END ELSE event_type END AS detail,
  CASE WHEN event_type = 'purchase' THEN ['LEDGER_COMMITTED', 'ALREADY_COMMITTED', 'EXCEPTION_ROUTED'][event_id % 3 + 1]
    END AS terminal_status
FROM events) SELECT * FROM once UNION ALL SELECT * FROM once WHERE event_id % 10 = 0"""),
}


def with_views(needs: list[str], body: str) -> str:
    """``WITH`` clause for the named views and what they build on, in front of ``body``.

    ``body`` is a SELECT, or further common table expressions followed by one (``name AS (...), ... SELECT``).
    """
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    parts = [f"{name} AS ({VIEWS[name][1]}\n)" for name in order]
    text = body.strip()
    head = text.split(None, 1)[0].upper()
    if head == "SELECT":
        return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + text
    return "WITH RECURSIVE " + "".join(p + ",\n" for p in parts) + text
