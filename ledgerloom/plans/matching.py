"""Subset search and the three-phase decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import linking, matching, reads
from ledgerloom.operators.subsets import MAX_SUBSETS, count_subsets, find_subsets
from ledgerloom.plans.registry import query
from ledgerloom.plans.textsql import narration_sql, score_sql, source_sql


def _pool(fx, coarse=False, named=True):
    net = F.col("coarse_net_paise") if coarse else reads.net_paise()
    if named:
        fx.share_names()
    return fx.open_invoices(named=named).withColumn("net_paise", net)


def _credits(fx, coarse=False, named=True):
    return reads.unmatched_credits(fx.bank(named=named, coarse=coarse), fx.reconciliations())


def subsets_sql(net: str, amount: str, cap: int | None = None) -> str:
    """CTE ``subs`` with every set of open invoices adding up to a credit amount, by recursion."""
    first = f" QUALIFY row_number() OVER (PARTITION BY vendor_code, amount ORDER BY path) <= {cap}" if cap else ""
    return f"""
pool AS (SELECT vendor_code, invoice_number AS no, {net} AS net, document_date, supplier_legal_name FROM open_inv),
target AS (SELECT DISTINCT vendor_code, {amount} AS amount FROM credits),
step AS (
  SELECT vendor_code, amount, amount AS rest, []::struct(net bigint, no varchar)[] AS path, []::date[] AS dates,
    NULL::varchar AS supplier FROM target WHERE amount <> 0
  UNION ALL
  SELECT s.vendor_code, s.amount, s.rest - p.net, list_append(s.path, {{'net': p.net, 'no': p.no}}),
    list_append(s.dates, p.document_date), CASE WHEN len(s.path) = 0 THEN p.supplier_legal_name END
  FROM step s JOIN pool p ON p.vendor_code = s.vendor_code
    AND (len(s.path) = 0 OR (p.net, p.no) > (s.path[-1].net, s.path[-1].no)) AND (p.net = s.rest OR 2 * p.net <= s.rest)
  WHERE s.rest <> 0),
subs AS (SELECT vendor_code, amount, path, dates, supplier, list_sort(list_transform(path, lambda m: m.no)) AS members
  FROM step WHERE rest = 0{first})"""


@query("c9_k1_subsets", needs=["open_inv", "credits"], sql=subsets_sql(
    "grand_total_paise - tds_deduction_paise", "amount_paise") + """
SELECT vendor_code, amount AS amount_paise, len(members)::int AS size, array_to_string(members, ',') AS members FROM subs""")
def _(fx):
    return find_subsets(_credits(fx, named=False), _pool(fx)).select(
        "vendor_code", "amount_paise", "size", F.array_join("members", ",").alias("members"))


@query("f6_k1_subsets_any_size", needs=["open_inv", "credits"], sql=subsets_sql(
    "coarse_net_paise", "coarse_amount_paise", MAX_SUBSETS) + """
SELECT vendor_code, amount AS amount_paise, len(members)::int AS size, array_to_string(members, ',') AS members FROM subs""")
def _(fx):
    return find_subsets(_credits(fx, True, named=False), _pool(fx, True), salts=2, cap=MAX_SUBSETS).select(
        "vendor_code", "amount_paise", "size", F.array_join("members", ",").alias("members"))


@query("d17_collision_statistics", needs=["open_inv", "credits"], sql=subsets_sql(
    "coarse_net_paise", "coarse_amount_paise") + """,
n AS (SELECT vendor_code, amount, count(*) AS subsets FROM subs GROUP BY 1, 2)
SELECT coalesce(subsets, 0) AS subsets, count(*) AS credits FROM credits LEFT JOIN n
  ON n.vendor_code = credits.vendor_code AND n.amount = coarse_amount_paise GROUP BY 1""")
def _(fx):
    credits = _credits(fx, True, named=False)
    n = count_subsets(credits, _pool(fx, True, named=False))
    return credits.join(n, ["vendor_code", "amount_paise"], "left").groupBy(
        F.coalesce(F.col("subsets").cast("bigint"), F.lit(0)).alias("subsets")).agg(F.count(F.lit(1)).alias("credits"))


# Options of each request, scored and dated; then the decision. ``req`` is (vendor_code, rutr, rpaise).
_DECIDE = f"""
unit AS (SELECT r.vendor_code, r.rutr, r.rpaise, c.transaction_id, c.utr_number, c.transaction_date, c.narration, s.*
    EXCLUDE (vendor_code)
  FROM req r JOIN cr c ON c.vendor_code = r.vendor_code AND CASE WHEN r.rutr IS NULL THEN c.amt = r.rpaise
    ELSE c.utr_number = r.rutr END
  JOIN subs s ON s.vendor_code = r.vendor_code AND s.amount = c.amt),
pr0 AS (SELECT DISTINCT supplier, narration FROM unit WHERE len(members) = 1),
pr AS (SELECT {{'s': supplier, 'n': narration}} AS id, {source_sql('supplier')} AS a, {narration_sql('narration')} AS b FROM pr0),
{score_sql('pr')},
u AS (SELECT unit.*, CASE WHEN len(members) = 1 AND score >= 0.85 THEN score ELSE 0 END AS score,
    list_min(list_transform(dates, lambda d: abs(datediff('day', d, transaction_date)))) AS delta
  FROM unit LEFT JOIN scored ON len(members) = 1 AND scored.id = {{'s': supplier, 'n': narration}}),
u2 AS (SELECT *, CASE WHEN delta <= 7 THEN delta END AS near FROM u),
u3 AS (SELECT *, count(*) OVER w AS options, max(score) OVER w AS top, min(near) OVER w AS closest FROM u2
  WINDOW w AS (PARTITION BY vendor_code, rutr, rpaise)),
u4 AS (SELECT *, count(*) FILTER (score = top) OVER w AS n_top, count(*) FILTER (near = closest) OVER w AS n_near FROM u3
  WINDOW w AS (PARTITION BY vendor_code, rutr, rpaise)),
u5 AS (SELECT *, CASE WHEN options = 1 THEN 1 WHEN top >= 0.85 AND n_top = 1 THEN 2 WHEN n_near = 1 THEN 3 END AS phase,
  CASE WHEN options = 1 THEN true WHEN top >= 0.85 AND n_top = 1 THEN score = top WHEN n_near = 1 THEN near = closest
    ELSE false END AS wins FROM u4),
verdict AS (SELECT vendor_code, rutr, rpaise, max(phase) AS phase, max(options) AS options,
    max(array_to_string(members, ',')) FILTER (wins) AS members, max(utr_number) FILTER (wins) AS utr,
    max(transaction_id) FILTER (wins) AS transaction_id, max(amount) FILTER (wins) AS proof_paise FROM u5 GROUP BY ALL),
final AS (SELECT req.vendor_code, req.rutr, req.rpaise, CASE WHEN options IS NULL THEN 'NO_MATCH' WHEN phase IS NULL THEN
    'AMBIGUOUS_COLLISION' ELSE 'SUBSET_MATCHED' END AS status, phase, coalesce(options, 0) AS options, members, utr,
    transaction_id, proof_paise
  FROM req LEFT JOIN verdict v ON v.vendor_code = req.vendor_code AND v.rutr IS NOT DISTINCT FROM req.rutr
    AND v.rpaise IS NOT DISTINCT FROM req.rpaise)"""

_BEST = """best AS (SELECT * FROM settle WHERE status = 'processed' QUALIFY row_number() OVER (
  PARTITION BY vendor_code, reference_id ORDER BY ingested_epoch DESC, payout_id DESC) = 1)"""


def asked_sql(net: str) -> str:
    return f"""{_BEST},
ask AS (SELECT o.*, b.payout_id AS anchor_payout_id, b.utr AS rutr, CASE WHEN b.utr IS NULL THEN greatest(0, {net}) END AS rpaise
  FROM open_inv o LEFT JOIN best b ON b.vendor_code = o.vendor_code AND b.reference_id = o.invoice_number),
req AS (SELECT DISTINCT vendor_code, rutr, rpaise FROM ask)"""


@query("k2_e8_c11_three_phases", needs=["open_inv", "credits"], sql=subsets_sql(
    "coarse_net_paise", "coarse_amount_paise") + """,
cr AS (SELECT *, coarse_amount_paise AS amt FROM credits),
req AS (SELECT DISTINCT vendor_code, NULL::varchar AS rutr, coarse_net_paise AS rpaise FROM open_inv),
""" + _DECIDE + """
SELECT vendor_code, rpaise AS request_paise, status AS subset_status, phase::int AS phase, options,
  members AS matched_invoices, transaction_id FROM final""")
def _(fx):
    pool = _pool(fx, True)
    requests = pool.select("vendor_code", F.lit(None).cast("string").alias("request_utr"),
                           F.col("net_paise").alias("request_paise")).distinct()
    return matching.match_requests(requests, _credits(fx, True), pool).select(
        "vendor_code", "request_paise", "subset_status", "phase", "options",
        F.array_join("matched_invoices", ",").alias("matched_invoices"), "transaction_id")


@query("k3_k4_b17_b21_fast_path", needs=["open_inv", "credits", "settle"], sql=subsets_sql(
    "grand_total_paise - tds_deduction_paise", "amount_paise") + """,
cr AS (SELECT *, amount_paise AS amt FROM credits),
""" + asked_sql("grand_total_paise - tds_deduction_paise") + "," + _DECIDE + """
SELECT ask.document_id, ask.invoice_number, anchor_payout_id, phase::int AS phase, f.utr AS matched_utr, proof_paise,
  status = 'SUBSET_MATCHED' AND list_contains(string_split(members, ','), ask.invoice_number) AS committable,
  CASE WHEN status = 'SUBSET_MATCHED' AND NOT list_contains(string_split(members, ','), ask.invoice_number)
    THEN 'NO_MATCH' ELSE status END AS subset_status
FROM ask JOIN final f ON f.vendor_code = ask.vendor_code AND f.rutr IS NOT DISTINCT FROM ask.rutr
  AND f.rpaise IS NOT DISTINCT FROM ask.rpaise""")
def _(fx):
    return matching.fast_path(_pool(fx), fx.settlements(), _credits(fx)).select(
        "document_id", "invoice_number", "anchor_payout_id", "phase", "matched_utr", "proof_paise", "committable",
        "subset_status")


@query("b17_request_guard", needs=["open_inv", "settle"], sql=_BEST + """,
ask AS (SELECT o.*, b.utr AS anchor, coalesce(nullif(CASE WHEN b.utr IS NOT NULL THEN b.amount_paise END, 0), greatest(0, grand_total_paise - tds_deduction_paise)) AS target
  FROM open_inv o LEFT JOIN best b ON b.vendor_code = o.vendor_code AND b.reference_id = o.invoice_number)
SELECT document_id, CASE WHEN k % 5 = 1 THEN 'UTR_NOT_RESOLVED' 
  WHEN k % 5 = 3 AND k % 2 = 1 THEN 'TARGET_DIFFERS' END AS guard_reason FROM ask""")
def _(fx):
    """Requests for an invented UTR, the anchor, another amount by one paisa, the own amount, or nothing."""
    asked = reads.with_anchor(_pool(fx, named=False), fx.settlements()).withColumns({
        "request_utr": F.expr("CASE k % 5 WHEN 1 THEN concat('X', k) WHEN 2 THEN anchor_utr END"),
        "request_paise": F.expr("CASE WHEN k % 5 = 3 THEN target_paise + k % 2 WHEN k % 5 = 4 THEN target_paise END")})
    return matching.request_guard(asked).select("document_id", "guard_reason")


_FUZZY = f"""
narrated AS (SELECT * FROM settle WHERE utr IS NOT NULL AND narration <> ''),
fp AS (SELECT DISTINCT o.vendor_code, o.supplier_legal_name, t.payout_id, t.utr, t.amount_paise, t.ingested_epoch, t.narration
  FROM (SELECT DISTINCT vendor_code, supplier_legal_name FROM {{names}}) o JOIN narrated t USING (vendor_code)),
fpr AS (SELECT DISTINCT {{{{'s': supplier_legal_name, 'n': narration}}}} AS id, {source_sql('supplier_legal_name')} AS a,
  {narration_sql('narration')} AS b FROM fp),
{score_sql('fpr', 'f_').replace('{', '{{').replace('}', '}}')},
fz AS (SELECT fp.*, s.score FROM fp JOIN f_scored s ON s.id = {{{{'s': supplier_legal_name, 'n': narration}}}}
  WHERE s.score >= 0.85 QUALIFY row_number() OVER (PARTITION BY vendor_code, supplier_legal_name
  ORDER BY s.score DESC, ingested_epoch DESC, payout_id DESC) = 1)"""


@query("c10_best_settlement", needs=["open_inv", "settle"], sql=_FUZZY.format(names="open_inv") + """
SELECT vendor_code, supplier_legal_name, payout_id AS fuzzy_payout_id, utr AS fuzzy_utr, score AS fuzzy_score FROM fz""")
def _(fx):
    return linking.best_settlement(_pool(fx), fx.settlements(named=True)).select(
        "vendor_code", "supplier_legal_name", "fuzzy_payout_id", "fuzzy_utr", "fuzzy_score")


@query("k5_b18_b19_exception_resolution", needs=["open_inv", "credits", "settle"], sql=subsets_sql(
    "grand_total_paise - tds_deduction_paise", "amount_paise") + """,
cr AS (SELECT *, amount_paise AS amt FROM credits),
""" + _BEST + """,
unres AS (SELECT o.* FROM open_inv o LEFT JOIN best b ON b.vendor_code = o.vendor_code AND b.reference_id = o.invoice_number
  WHERE b.utr IS NULL),
""" + _FUZZY.format(names="unres") + """,
ask AS (SELECT u.*, fz.utr AS rutr, NULL::bigint AS rpaise, fz.payout_id AS fuzzy_payout_id FROM unres u
  LEFT JOIN fz ON fz.vendor_code = u.vendor_code AND fz.supplier_legal_name = u.supplier_legal_name),
req AS (SELECT DISTINCT vendor_code, rutr, rpaise FROM ask WHERE rutr IS NOT NULL),
""" + _DECIDE + """,
joined AS (SELECT ask.document_id, fuzzy_payout_id, ask.rutr, coalesce(status = 'SUBSET_MATCHED'
    AND list_contains(string_split(members, ','), ask.invoice_number), false) AS committable, status
  FROM ask LEFT JOIN final f ON f.vendor_code = ask.vendor_code AND f.rutr = ask.rutr)
SELECT document_id, fuzzy_payout_id, committable, CASE WHEN rutr IS NULL THEN 'ENTITY_MISMATCH' ELSE 'ENTITY_RESOLVED' END AS fuzzy_status,
  CASE WHEN committable THEN NULL WHEN status = 'AMBIGUOUS_COLLISION' THEN 'AMBIGUOUS_COLLISION' ELSE 'NO_MATCH' END AS review_reason
FROM joined""")
def _(fx):
    pool, settlements = _pool(fx), fx.settlements(named=True)
    unresolved = reads.with_anchor(pool, settlements).filter("anchor_utr IS NULL").withColumn(
        "subset_status", F.lit(matching.NO_MATCH))
    return matching.resolve_exceptions(unresolved, settlements, _credits(fx), pool).select(
        "document_id", "fuzzy_payout_id", "committable", "fuzzy_status", "review_reason")


# One invoice of each vendor after the other: what is taken so far, and the verdict on the options left.
_IN_ORDER = """,
opts AS (SELECT vendor_code, rutr, rpaise, list({'utr': utr_number, 'm': members, 'score': score, 'near': near}) AS o
  FROM u2 GROUP BY vendor_code, rutr, rpaise),
line AS (SELECT ask.vendor_code, ask.document_id, ask.invoice_number, coalesce(o, []) AS o,
    row_number() OVER (PARTITION BY ask.vendor_code ORDER BY i.row_number, ask.document_id) AS n
  FROM ask JOIN items i ON i.k = ask.k LEFT JOIN opts ON opts.vendor_code = ask.vendor_code
    AND opts.rutr IS NOT DISTINCT FROM ask.rutr AND opts.rpaise IS NOT DISTINCT FROM ask.rpaise),
run AS (
  SELECT DISTINCT vendor_code, 0::bigint AS n, []::varchar[] AS utrs, []::varchar[] AS gone, NULL::varchar AS document_id,
    NULL::varchar AS terminal, NULL::varchar AS subset_status, NULL::int AS phase, NULL::varchar AS utr FROM line
  UNION ALL
  SELECT vendor_code, n, CASE WHEN commits THEN list_append(utrs, win.utr) ELSE utrs END,
    CASE WHEN commits THEN list_concat(gone, win.m) ELSE gone END, document_id,
    CASE WHEN cleared THEN 'ALREADY_COMMITTED' WHEN commits THEN 'LEDGER_COMMITTED' ELSE 'EXCEPTION_ROUTED' END,
    CASE WHEN cleared THEN NULL WHEN len(free) = 0 OR (phase IS NOT NULL AND NOT member) THEN 'NO_MATCH'
      WHEN phase IS NULL THEN 'AMBIGUOUS_COLLISION' ELSE 'SUBSET_MATCHED' END,
    CASE WHEN cleared THEN NULL ELSE phase END, CASE WHEN commits THEN win.utr END
  FROM (SELECT *, NOT cleared AND member AND win.utr IS NOT NULL AS commits
  FROM (SELECT *, coalesce(list_contains(win.m, invoice_number), false) AS member
  FROM (SELECT *, CASE phase WHEN 1 THEN free[1] WHEN 2 THEN best[1] WHEN 3 THEN closest[1] END AS win
  FROM (SELECT *, CASE WHEN len(free) = 1 THEN 1 WHEN top >= 0.85 AND len(best) = 1 THEN 2 WHEN len(closest) = 1 THEN 3 END AS phase
  FROM (SELECT *, list_filter(free, lambda x: x.score = top) AS best, list_filter(free, lambda x: x.near = low) AS closest
  FROM (SELECT *, list_max(list_transform(free, lambda x: x.score)) AS top, list_min(list_transform(free, lambda x: x.near)) AS low
  FROM (SELECT l.vendor_code, l.n, r.utrs, r.gone, l.document_id, l.invoice_number,
      list_contains(r.gone, l.invoice_number) AS cleared,
      list_filter(l.o, lambda x: NOT list_has_any(x.m, r.gone) AND NOT coalesce(list_contains(r.utrs, x.utr), false)) AS free
    FROM run r JOIN line l ON l.vendor_code = r.vendor_code AND l.n = r.n + 1))))))))
SELECT document_id, terminal, subset_status, phase, utr FROM run WHERE n > 0"""


def in_order_sql(net: str, amount: str) -> str:
    return (subsets_sql(net, amount) + f""",
cr AS (SELECT *, {amount} AS amt FROM credits),
""" + asked_sql(net) + "," + _DECIDE + _IN_ORDER)


def _in_order(fx, coarse: bool):
    from ledgerloom.operators.batchrun import reconcile_in_order
    order = fx.items().select(F.col("k"), "row_number", "batch_id")
    pool = _pool(fx, coarse).join(order, "k").withColumn("run_order", F.struct("row_number", "document_id"))
    outcomes, _ = reconcile_in_order(pool, fx.settlements(), _credits(fx, coarse))
    return outcomes.select("document_id", "terminal", "subset_status", "phase", "utr")


@query("k8_batch_in_order", needs=["open_inv", "credits", "settle", "items"],
       sql=in_order_sql("grand_total_paise - tds_deduction_paise", "amount_paise"))
def _(fx):
    return _in_order(fx, False)


@query("k8_batch_in_order_collisions", needs=["open_inv", "credits", "settle", "items"],
       sql=in_order_sql("coarse_net_paise", "coarse_amount_paise"))
def _(fx):
    return _in_order(fx, True)


@query("j1_tools_one_pass")
def _(fx):
    from ledgerloom.tools import reconcile_snapshot
    _, outcomes = reconcile_snapshot(_pool(fx), fx.settlements(named=True), _credits(fx), fx.reconciliations())
    return outcomes.select("document_id", "terminal", "utr", "review_reason")
