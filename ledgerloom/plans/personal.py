"""Masking and reversible tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import checks, pii
from ledgerloom.plans.registry import query

_PATTERN = ("\\b(?:[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]|[0-9]{4}[ ]?[0-9]{4}[ ]?[0-9]{4}|[A-Z]{5}[0-9]{4}[A-Z]|"
            "[A-Z]{4}0[A-Z0-9]{6}|[0-9]{9,18})\\b")
_SPANS = f"""
h0 AS (SELECT doc_id, text, regexp_extract_all(text, '{_PATTERN}', 0, 'i') AS hits, regexp_split_to_array(text, '(?i){_PATTERN}') AS gaps FROM pii_text),
h1 AS (SELECT doc_id, text, gaps, unnest(hits) AS value, generate_subscripts(hits, 1) AS i, hits FROM h0),
h2 AS (SELECT *, (list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0))::bigint AS start FROM h1),
h3 AS (SELECT *, lower(text[greatest(start - 80, 0) + 1 : start + length(value) + 30]) AS around FROM h2),
sp AS (SELECT *, CASE WHEN regexp_full_match(value, '(?i)[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]') THEN 'IN_GSTIN'
  WHEN regexp_full_match(value, '[0-9]{{4}}[ ]?[0-9]{{4}}[ ]?[0-9]{{4}}') THEN 'IN_AADHAAR' WHEN regexp_full_match(value, '(?i)[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 'IN_PAN'
  WHEN regexp_full_match(value, '(?i)[A-Z]{{4}}0[A-Z0-9]{{6}}') THEN 'IN_IFSC'
  WHEN regexp_matches(around, 'account|acc|bank|savings|beneficiary|ifsc') THEN 'BANK_ACCOUNT' END AS entity FROM h3)"""
_PLACE = ("CASE entity WHEN 'IN_GSTIN' THEN '[GSTIN_REDACTED]' WHEN 'IN_AADHAAR' THEN '[AADHAAR_REDACTED]' WHEN 'IN_PAN' THEN '[PAN_REDACTED]' "
          "WHEN 'IN_IFSC' THEN '[IFSC_REDACTED]' WHEN 'BANK_ACCOUNT' THEN '[ACCOUNT_REDACTED]' ELSE value END")


@query("h18_masked_text", needs=["pii_text"], sql=_SPANS + f""",
r AS (SELECT doc_id, string_agg(gaps[i] || {_PLACE}, '' ORDER BY i) AS body FROM sp GROUP BY 1)
SELECT doc_id, coalesce(body || gaps[len(gaps)], text) AS masked FROM h0 LEFT JOIN r USING (doc_id)""")
def _(fx):
    return pii.with_spans(fx.pii_text()).select("doc_id", pii.masked_text().alias("masked"))


@query("e9_vault_ordinals", needs=["pii_text"], sql=_SPANS + """
SELECT doc_id, entity || '_' || row_number() OVER (PARTITION BY doc_id, entity ORDER BY start) AS name, value FROM sp WHERE entity IS NOT NULL""")
def _(fx):
    found = pii.with_spans(fx.pii_text()).select("doc_id", F.explode(pii.vault_entries()).alias("v"))
    return found.select("doc_id", "v.name", "v.value")


_BUCKET = "doc_order div 4096"


def _runs(fx):
    return fx.pii_text().selectExpr("concat('run_', doc_id % 7) AS run_id", "doc_id AS doc_order", "text")


_VAULT = """,
f0 AS (SELECT 'run_' || doc_id % 7 AS run_id, doc_id, start, entity, value FROM sp WHERE entity IS NOT NULL),
f1 AS (SELECT run_id, entity, value, min((doc_id, start)) AS first FROM f0 GROUP BY 1, 2, 3),
vault AS (SELECT run_id, entity, value, '[' || CASE entity WHEN 'BANK_ACCOUNT' THEN 'ACCOUNT' ELSE entity[4:] END || '_TOKEN_' ||
  row_number() OVER (PARTITION BY run_id, entity ORDER BY first, value) || ']' AS token FROM f1)"""


@query("h20_run_tokens", needs=["pii_text"], sql=_SPANS + _VAULT + " SELECT run_id, entity, value, token FROM vault")
def _(fx):
    return pii.run_vault(pii.text_findings(pii.with_spans(_runs(fx))), F.expr(_BUCKET))


@query("h21_tokenized_text", needs=["pii_text"], sql=_SPANS + _VAULT + """,
r AS (SELECT doc_id, string_agg(gaps[i] || coalesce(token, sp.value), '' ORDER BY i) AS body FROM sp
  LEFT JOIN vault v ON v.run_id = 'run_' || doc_id % 7 AND v.entity = sp.entity AND v.value = sp.value GROUP BY 1)
SELECT 'run_' || doc_id % 7 AS run_id, doc_id AS doc_order, coalesce(body || gaps[len(gaps)], text) AS text FROM h0 LEFT JOIN r USING (doc_id)""")
def _(fx):
    return pii.tokenize_run(_runs(fx), F.expr(_BUCKET))[0]


@query("h20_rehydrated_text", needs=["pii_text"], sql="""
SELECT 'run_' || doc_id % 7 AS run_id, doc_id AS doc_order, text FROM pii_text""")
def _(fx):
    return pii.rehydrate_text(*pii.tokenize_run(_runs(fx), F.expr(_BUCKET)))


@query("h19_masked_documents", needs=["inv"], sql="""
SELECT document_id, 'XXXX-' || right((50100000000000 + k)::varchar, 4) AS account_number_masked, '[ACCOUNT_REDACTED]' AS account_number,
  '[IFSC_REDACTED]' AS ifsc, '[PAN_REDACTED]' AS pan, CASE WHEN k % 2 = 0 THEN '[GSTIN_REDACTED]' END AS gstin FROM inv""")
def _(fx):
    docs = checks.with_document(fx.documents_json()).withColumn("m", F.explode(F.array(pii.mask_document(F.col("doc.body")))))
    return docs.select("document_id", "m.banking_details.account_number_masked", "m.banking_details.account_number",
                       "m.banking_details.ifsc", "m.supplier_details.pan", "m.supplier_details.gstin")


@query("h20_document_tokens", needs=["inv"], sql="""
f AS (SELECT vendor_code AS run_id, k, unnest([{'p': 0, 'e': 'IN_PAN', 'v': 'ABCDE' || lpad((k % 10000)::varchar, 4, '0') || 'F'},
  {'p': 1, 'e': 'IN_GSTIN', 'v': CASE WHEN k % 2 = 0 THEN '27ABCDE' || lpad((k % 10000)::varchar, 4, '0') || 'F1Z5' END},
  {'p': 4, 'e': 'BANK_ACCOUNT', 'v': (50100000000000 + k)::varchar}, {'p': 5, 'e': 'IN_IFSC', 'v': 'HDFC0' || lpad(custkey::varchar, greatest(6, length(custkey::varchar))::int, '0')}]) AS x FROM inv),
d AS (SELECT run_id, x.e AS entity, x.v AS value, min((k, x.p)) AS first FROM f WHERE x.v IS NOT NULL GROUP BY 1, 2, 3)
SELECT run_id, entity, value, '[' || CASE entity WHEN 'BANK_ACCOUNT' THEN 'ACCOUNT' ELSE entity[4:] END || '_TOKEN_' ||
  row_number() OVER (PARTITION BY run_id, entity ORDER BY first) || ']' AS token FROM d""")
def _(fx):
    docs = checks.with_document(fx.documents_json(), parts=checks.PARTY_PARTS).selectExpr("vendor_code AS run_id", "k AS doc_order", "doc")
    return pii.run_vault(pii.document_findings(docs), F.expr(_BUCKET))
