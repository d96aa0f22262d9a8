"""Read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import reads, reports
from ledgerloom.plans.registry import query

_PATHS = "CASE WHEN k % 4 <> 0 THEN ['fast_path', 'agent', 'deterministic_fallback'][k % 3 + 1] END"
_ROWS = f"""
reasons AS (SELECT i.batch_id, i.invoice_number, first(exception_reason ORDER BY t.created_epoch, ticket_id) AS exception_reason
  FROM tickets t JOIN items i ON i.vendor_code = t.vendor_code AND i.invoice_number = t.flagged_invoice_ids[1]
  JOIN batches b ON b.batch_id = i.batch_id WHERE t.created_epoch >= b.created_epoch GROUP BY 1, 2),
rows AS (SELECT i.*, inv.processing_status, grand_total_paise - tds_deduction_paise AS net_paise, r.utr_number, r.payout_id,
  r.net_settled_amount_paise, x.exception_reason, CASE WHEN i.document_id IS NOT NULL THEN {_PATHS.replace('k %', 'i.k %')} END AS path
  FROM items i LEFT JOIN inv ON inv.document_id = i.document_id LEFT JOIN recs r ON r.document_id = i.document_id
  LEFT JOIN reasons x ON x.batch_id = i.batch_id AND x.invoice_number = i.invoice_number)"""
_NEEDS = ["items", "batches", "tickets", "recs", "inv"]


def _rows(fx):
    items = fx.items()
    paths = fx.invoices().selectExpr("document_id", "CASE WHEN k % 4 <> 0 THEN element_at(array('fast_path', 'agent',"
                                     " 'deterministic_fallback'), cast(k % 3 + 1 AS int)) END AS path")
    return reports.invoice_telemetry(items, fx.invoices(), fx.reconciliations(),
                                     reports.ticket_reasons(fx.tickets(), items, fx.batches()), paths)


@query("c4_invoice_telemetry", needs=_NEEDS, sql=_ROWS + """
SELECT batch_id, row_number, invoice_number, status, processing_status, utr_number, payout_id, net_settled_amount_paise, net_paise, exception_reason, path FROM rows""")
def _(fx):
    return _rows(fx).select("batch_id", "row_number", "invoice_number", "status", "processing_status", "utr_number", "payout_id",
                            "net_settled_amount_paise", "net_paise", "exception_reason", "path")


@query("c12_ticket_reasons", needs=_NEEDS, sql=_ROWS + " SELECT batch_id, invoice_number, exception_reason FROM reasons")
def _(fx):
    return reports.ticket_reasons(fx.tickets(), fx.items(), fx.batches())


@query("d5_batch_funnel", needs=_NEEDS, sql=_ROWS + """
SELECT batch_id, count(*) AS total, count(utr_number) AS settled, count(exception_reason) AS exceptions,
  greatest(0, count(*) - count(utr_number) - count(exception_reason)) AS open,
  CASE WHEN count(path) > 0 THEN count(*) FILTER (path = 'fast_path') END AS fast_path,
  CASE WHEN count(path) > 0 THEN count(*) FILTER (path IN ('agent', 'deterministic_fallback')) END AS agent_routed FROM rows GROUP BY 1""")
def _(fx):
    return reports.funnel(_rows(fx))


@query("d6_d7_d8_kpis", needs=_NEEDS, sql=_ROWS + """,
k AS (SELECT batch_id, coalesce(sum(net_settled_amount_paise) FILTER (utr_number IS NOT NULL), 0)::bigint AS cleared_paise,
  count(*) FILTER (utr_number IS NOT NULL) AS cleared_count,
  coalesce(sum(net_paise) FILTER (utr_number IS NULL AND exception_reason IS NOT NULL), 0)::bigint AS review_paise,
  count(*) FILTER (utr_number IS NULL AND exception_reason IS NOT NULL) AS review_count,
  count(*) FILTER (processing_status = 'VALIDATED' OR utr_number IS NOT NULL OR exception_reason IS NOT NULL) AS x FROM rows GROUP BY 1),
m AS (SELECT *, greatest(x, cleared_count + review_count) AS extracted_count FROM k)
SELECT batch_id, cleared_paise, cleared_count, review_paise, review_count, extracted_count,
  round(cleared_count / greatest(1, extracted_count) * 100, 4) AS auto_rate, greatest(0, extracted_count - cleared_count - review_count) AS open_count,
  round(CASE WHEN extracted_count > 0 THEN cleared_count / extracted_count * 100 ELSE 0 END, 4) AS cleared_pct FROM m""")
def _(fx):
    return reports.kpis(_rows(fx)).withColumns({"auto_rate": F.round("auto_rate", 4), "cleared_pct": F.round("cleared_pct", 4)})


@query("d16_list_counts", needs=_NEEDS, sql=_ROWS + " SELECT batch_id, count(utr_number) AS cleared, count(exception_reason) AS in_review FROM rows GROUP BY 1")
def _(fx):
    return reports.list_counts(_rows(fx))


@query("d2_d3_batch_progress", needs=["items", "batches"], sql="""
SELECT b.batch_id, total_invoices, coalesce(p, 0) AS processed, coalesce(f, 0) AS failed,
  round(coalesce(p, 0) / total_invoices * 100, 1) AS progress_pct, coalesce(p, 0) + coalesce(f, 0) >= total_invoices AS complete
FROM batches b LEFT JOIN (SELECT batch_id, count(*) FILTER (k % 31 <> 0) AS p, count(*) FILTER (k % 31 = 0) AS f FROM items WHERE k % 12 <> 0 GROUP BY 1) c USING (batch_id)""")
def _(fx):
    pages = fx.items().filter("k % 12 <> 0").selectExpr("k", "batch_id", "row_number AS page_index", "k % 31 <> 0 AS ok")
    return reports.batch_progress(fx.batches(), pages.unionByName(pages.filter("k % 5 = 0")).drop("k"))


@query("d4_run_outcome", needs=["items", "batches"], sql="""
SELECT b.batch_id, coalesce(m, 0) AS matched_count, coalesce(n, 0) - coalesce(m, 0) AS exception_count,
  greatest(0, total_invoices - coalesce(n, 0)) AS shortfall, CASE WHEN coalesce(n, 0) > 0 THEN 'COMPLETED' ELSE 'PARTIAL' END AS status
FROM batches b LEFT JOIN (SELECT batch_id, count(*) AS n, count(*) FILTER (k % 3 <> 2) AS m FROM items WHERE k % 6 <> 1 GROUP BY 1) c USING (batch_id)""")
def _(fx):
    outcomes = fx.items().filter("k % 6 <> 1").selectExpr(
        "batch_id", "document_id", "element_at(array('LEDGER_COMMITTED', 'ALREADY_COMMITTED', 'EXCEPTION_ROUTED'), cast(k % 3 + 1 AS int)) AS terminal")
    return reports.run_outcome(fx.batches(), outcomes)


@query("d14_telemetry_fold", needs=["telemetry"], sql="""
e AS (SELECT DISTINCT * FROM telemetry),
f AS (SELECT *, CASE WHEN stage = 'agent' THEN true WHEN stage = 'deterministic' AND detail LIKE '%-> SUBSET_MATCHED%' THEN false END AS llm FROM e),
g AS (SELECT batch_id, invoice, last(llm ORDER BY ts_us, event_id) FILTER (llm IS NOT NULL) AS llm, bool_or(stage = 'agent') AS agent,
  count(*) FILTER (stage = 'tool_called') AS tool_calls, bool_or(stage = 'terminal') AS ended,
  last(terminal_status ORDER BY ts_us, event_id) FILTER (stage = 'terminal') AS ts FROM f GROUP BY 1, 2)
SELECT batch_id, invoice, tool_calls, CASE WHEN ended THEN coalesce(llm, false) ELSE llm END AS llm_invoked,
  CASE WHEN ended THEN CASE WHEN coalesce(llm, false) OR tool_calls > 0 THEN 'agent' WHEN ts = 'EXCEPTION_ROUTED' THEN 'deterministic_fallback'
    ELSE 'fast_path' END WHEN agent THEN 'agent' END AS path FROM g""")
def _(fx):
    return reports.telemetry_fold(fx.telemetry())


@query("d14_tool_calls", needs=["telemetry"], sql="""
SELECT batch_id, invoice, row_number() OVER (PARTITION BY batch_id, invoice ORDER BY ts_us, event_id) AS call_no, detail AS tool
FROM (SELECT DISTINCT * FROM telemetry WHERE stage = 'tool_called')""")
def _(fx):
    return reports.tool_calls(fx.telemetry())


@query("d15_message_path", sql="""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR turn % 4 = 1 THEN 'agent' ELSE 'fast_path' END AS path, turn % 3 = 0 OR turn % 4 = 1 AS llm_invoked,
  CASE WHEN turn % 3 = 0 THEN 'run_fuzzy_text_linker_tool,' || role ELSE '' END AS tools FROM conversations""")
def _(fx):
    rows = fx.table("conversations").selectExpr("conv_id", "turn", """array(
      named_struct('type', 'human', 'content', text, 'tool_calls', array('ignored')),
      named_struct('type', 'ai', 'content', CASE WHEN turn % 4 = 1 THEN text ELSE concat('Deterministic fallback: ', text) END,
        'tool_calls', CASE WHEN turn % 3 = 0 THEN array('run_fuzzy_text_linker_tool', '', role) END)) AS messages""")
    p = rows.select("conv_id", "turn", reports.message_path(F.col("messages")).alias("p"))
    return p.select("conv_id", "turn", "p.path", "p.llm_invoked", F.array_join("p.tool_calls", ",").alias("tools"))


@query("h30_event_lines", needs=["inv"], sql="""
o AS (SELECT invoice_number, k, CASE WHEN k % 5 <> 0 THEN 'NO_MATCH' END AS ss, CASE WHEN k % 3 = 0 THEN repeat('m', 250) END AS sm,
  CASE WHEN k % 2 = 0 THEN 'fast_path' ELSE 'agent' END AS path, k % 4 = 1 AS llm, CASE WHEN k % 4 = 1 THEN ['a', 'b'] ELSE [] END AS tools,
  CASE WHEN k % 6 = 0 THEN repeat('d', 300) WHEN k % 6 = 1 THEN '' END AS td, CASE WHEN k % 2 = 0 THEN 'U' || k END AS utr FROM inv),
l AS (SELECT invoice_number, list_filter([{'s': 'started', 'd': 'Run of this invoice begins'},
  CASE WHEN ss IS NOT NULL THEN {'s': 'deterministic', 'd': 'run_subset_sum_matching_tool -> ' || ss || coalesce(' :: ' || sm[:200], '')} END,
  CASE WHEN path = 'fast_path' THEN {'s': 'deterministic', 'd': 'Settled by rules, model never invoked'}
    WHEN llm THEN {'s': 'agent', 'd': 'Tool agent takes over'} END], lambda x: x IS NOT NULL)
  || list_transform(tools, lambda t: {'s': 'tool_called', 'd': t}) || [{'s': 'terminal', 'd': coalesce(nullif(td[:240], ''), 'EXCEPTION_ROUTED')}] AS x, utr FROM o)
SELECT invoice_number, (i - 1)::int AS line_no, e.s AS stage, e.d AS detail, CASE WHEN e.s = 'terminal' THEN 'EXCEPTION_ROUTED' END AS terminal_status,
  CASE WHEN e.s = 'terminal' THEN utr END AS utr FROM (SELECT invoice_number, utr, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM l)""")
def _(fx):
    return reports.event_lines(fx.invoices().selectExpr(
        "invoice_number", "CASE WHEN k % 5 <> 0 THEN 'NO_MATCH' END AS subset_status", "CASE WHEN k % 3 = 0 THEN repeat('m', 250) END AS subset_message",
        "CASE WHEN k % 2 = 0 THEN 'fast_path' ELSE 'agent' END AS path", "k % 4 = 1 AS llm_invoked",
        "CASE WHEN k % 4 = 1 THEN array('a', 'b') ELSE cast(array() AS array<string>) END AS tool_calls", "'EXCEPTION_ROUTED' AS terminal",
        "CASE WHEN k % 6 = 0 THEN repeat('d', 300) WHEN k % 6 = 1 THEN '' END AS terminal_detail", "CASE WHEN k % 2 = 0 THEN concat('U', k) END AS terminal_utr"))


@query("h29_case_narrative", needs=["settle", "open_inv"], sql="""
best AS (SELECT * FROM settle WHERE status = 'processed' QUALIFY row_number() OVER (
  PARTITION BY vendor_code, reference_id ORDER BY ingested_epoch DESC, payout_id DESC) = 1),
t AS (SELECT o.invoice_number, b.utr, CASE WHEN b.utr IS NOT NULL AND b.amount_paise <> 0 THEN b.amount_paise ELSE greatest(0, grand_total_paise - tds_deduction_paise) END AS p
  FROM open_inv o LEFT JOIN best b ON b.vendor_code = o.vendor_code AND b.reference_id = o.invoice_number)
SELECT invoice_number, 'Rules on ' || invoice_number || ': matching says NO_MATCH.' ||
  coalesce(chr(10) || 'Tried with UTR ' || utr || '.', '') || chr(10) || 'Wanted net amount: Rs.' || (p // 100) || '.' || lpad((p % 100)::varchar, 2, '0') || '.' AS narrative FROM t""")
def _(fx):
    invoices = fx.open_invoices().withColumn("net_paise", reads.net_paise())
    rows = reads.with_anchor(invoices, fx.settlements()).withColumn("subset_status", F.lit("NO_MATCH"))
    return reports.case_narrative(rows).select("invoice_number", "narrative")


def _alias_events(fx):
    e = fx.items().filter("invoice_number IS NOT NULL AND k % 7 = 0").selectExpr(
        "batch_id", "invoice_number", "k", "k * 37 % 1000 AS ts", "'tool_called' AS stage", "'RUN_FUZZY_TEXT_LINKER_TOOL ok' AS detail")
    return e.unionByName(e.filter("k % 14 = 0").withColumn("ts", F.col("ts") + 5)).unionByName(
        e.filter("k % 3 = 0").withColumn("detail", F.lit("other"))).drop("k")


@query("e10_alias_notices", needs=["items"], sql="""
SELECT batch_id, invoice_number, k * 37 % 1000 + CASE WHEN k % 14 = 0 THEN 5 ELSE 0 END AS ts FROM items WHERE invoice_number IS NOT NULL AND k % 7 = 0""")
def _(fx):
    return reports.alias_notices(_alias_events(fx)).select("batch_id", "invoice_number", "ts")


@query("f7_g3_audit_feed", needs=_NEEDS, sql=_ROWS + """,
feed AS (SELECT batch_id, 0 AS section, k * 37 % 1000 + CASE WHEN k % 14 = 0 THEN 5 ELSE 0 END AS rank, invoice_number, 'info' AS tone FROM items WHERE invoice_number IS NOT NULL AND k % 7 = 0
  UNION ALL SELECT batch_id, 1, row_number, invoice_number, CASE WHEN utr_number IS NOT NULL THEN 'success' ELSE 'pending' END FROM rows WHERE utr_number IS NOT NULL OR exception_reason IS NOT NULL)
SELECT batch_id, section, rank, invoice_number, tone FROM feed QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY section, rank DESC, invoice_number) <= 12""")
def _(fx):
    return reports.audit_feed(_rows(fx), _alias_events(fx)).select("batch_id", "section", "rank", "invoice_number", "tone")


def _outbox(fx):
    return fx.invoices().selectExpr(
        "k AS outbox_id", "concat('evt_', k) AS event_id", "element_at(array('PENDING', 'PUBLISHED', 'FAILED'), cast(k % 3 + 1 AS int)) AS status",
        "k % 4 AS retry_count", "3L AS max_retries", "cast(unix_date(document_date) AS bigint) * 86400 AS created_epoch",
        "cast(unix_date(document_date) AS bigint) * 86400 + k % 100 AS available_epoch",
        "CASE WHEN k % 3 = 1 THEN k + 5 END AS published_epoch", "CASE WHEN k % 3 = 2 OR k % 4 > 1 THEN concat('earlier ', k) END AS last_error")


@query("f3_due_outbox", needs=["inv"], sql="""
SELECT k AS outbox_id, 'evt_' || k AS event_id FROM inv WHERE k % 3 = 0 AND day_no * 86400 + k % 100 <= 1000000000 ORDER BY day_no, k LIMIT 10""")
def _(fx):
    return reports.due_outbox(_outbox(fx), 1_000_000_000).select("outbox_id", "event_id")


@query("a8_outbox_relay", needs=["inv"], sql="""
SELECT k AS outbox_id, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'PUBLISHED' WHEN k % 3 = 0 AND k % 4 < 3 THEN 'FAILED' ELSE ['PENDING', 'PUBLISHED', 'FAILED'][k % 3 + 1] END AS status,
  k % 4 + CASE WHEN k % 3 = 0 AND k % 2 <> 0 AND k % 4 < 3 THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN k % 3 = 0 AND k % 2 <> 0 AND k % 4 < 3 THEN 1000000030 ELSE day_no * 86400 + k % 100 END AS available_epoch,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 1000000000 WHEN k % 3 = 1 THEN k + 5 END AS published_epoch,
  CASE WHEN k % 3 = 0 AND k % 2 <> 0 AND k % 4 < 3 THEN 'broker away' WHEN k % 3 = 2 OR k % 4 > 1 THEN 'earlier ' || k END AS last_error FROM inv""")
def _(fx):
    outbox = _outbox(fx)
    results = outbox.filter("status = 'PENDING'").selectExpr("outbox_id", "outbox_id % 2 = 0 AS ok", "'broker away' AS error")
    return reports.relay_result(outbox, results, 1_000_000_000).select(
        "outbox_id", "status", "retry_count", "available_epoch", "published_epoch", "last_error")


@query("k9_e3_e4_e5_expected_feed", needs=["open_inv"], sql="""
o AS (SELECT *, grand_total_paise - tds_deduction_paise AS net, row_number() OVER w AS idx, count(*) OVER (PARTITION BY vendor_code) AS n
  FROM open_inv WHERE grand_total_paise > tds_deduction_paise WINDOW w AS (PARTITION BY vendor_code ORDER BY invoice_number))
SELECT vendor_code, invoice_number, (300000000001 + idx)::varchar AS utr, 'pout_e2e_' || lpad(idx::varchar, greatest(4, length(idx::varchar))::int, '0') AS payout_id,
  (document_date + 2)::varchar AS transaction_date, net AS amount_paise, sum(net) OVER (PARTITION BY vendor_code ORDER BY invoice_number)::bigint AS closing_balance_paise,
  'CREDIT/IMPS/' || (300000000001 + idx)::varchar || '/' || upper(supplier_legal_name) || '/' || invoice_number AS bank_narration
FROM o WHERE idx <= n - 2""")
def _(fx):
    invoices = fx.open_invoices(named=True).withColumn("net_paise", reads.net_paise())
    return reports.expected_feed(invoices, F.substring("invoice_number", 1, 9), drop_last=2).select(
        "vendor_code", "invoice_number", "utr", "payout_id", F.col("transaction_date").cast("string"), "amount_paise",
        "closing_balance_paise", "bank_narration")
