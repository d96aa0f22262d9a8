"""Posting of proven matches: reconciliations, completed events, and the double-entry ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import envelopes
from ledgerloom.functions.money import is_rupee_string, paise_to_rupees, rupees_to_paise
from ledgerloom.operators.matching import MATCHED
from ledgerloom.scale import first_per_key, written

# Accounts of the two lines, outcomes and error codes.
DEBIT_ACCOUNT = ("LIABILITY", "Accounts Payable - ")
CREDIT_ACCOUNT = ("ASSET", "HDFC Corporate Current Account")
COMMITTED, DUPLICATE = "COMMITTED", "DUPLICATE_EVENT"
MALFORMED, BAD_AMOUNT, UNBALANCED = "MALFORMED_PAYLOAD", "INVALID_PAISE_CASTING", "ORPHANED_DEBIT_CREDIT_MISMATCH"


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, order and repeats aside."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def ledger_guard(df: DataFrame) -> DataFrame:
    """``guard_reason``: the first way in which a posting request departs from its proof, NULL if in none.

    Request: request_utr, request_invoices, request_amount (rupees). Proof: subset_status, matched_utr,
    matched_invoices, proof_paise. Plus invoice_number.
    """
    asked, proven = F.coalesce("request_invoices", F.array()), F.coalesce("matched_invoices", F.array())
    return df.withColumn("guard_reason", (
        F.when(F.coalesce(F.col("subset_status"), F.lit("")) != MATCHED, "NOT_MATCHED")
        .when(~F.col("request_utr").eqNullSafe(F.col("matched_utr")), "UTR_DIFFERS")
        .when(~same_set(asked, proven), "INVOICES_DIFFER")
        .when(~F.array_contains(proven, F.col("invoice_number")), "INVOICE_NOT_IN_PROOF")
        .when(~is_rupee_string("request_amount"), BAD_AMOUNT)
        .when(F.col("proof_paise").isNull() | (rupees_to_paise("request_amount") != F.col("proof_paise")), "AMOUNT_DIFFERS")))


def amounts_guard(df: DataFrame) -> DataFrame:
    """``guard_reason`` of waterfall arguments against the extraction: id first, then both amounts."""
    return df.withColumn("guard_reason", F.when(~F.col("claimed_invoice").eqNullSafe(F.col("invoice_number")), "INVOICE_DIFFERS").when(
        ~F.col("claimed_grand_total").eqNullSafe(paise_to_rupees("grand_total_paise"))
        | ~F.col("claimed_tds").eqNullSafe(paise_to_rupees("tds_deduction_paise")), "AMOUNTS_DIFFER"))


def proof_rows(proofs: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row per proven invoice, only for proofs whose invoices all exist and add up to the proven total.

    ``proofs``: vendor_code, proof_id, matched_invoices, matched_utr, proof_paise, payout_id.
    A proof without a UTR is not posted.
    """
    wanted = proofs.filter("matched_utr IS NOT NULL").withColumn("invoice_number", F.explode("matched_invoices"))
    rows = wanted.join(invoices.select("vendor_code", "invoice_number", "document_id", "net_paise"),
                       ["vendor_code", "invoice_number"])
    proof = Window.partitionBy("proof_id")
    complete = rows.withColumns({"n": F.count(F.lit(1)).over(proof), "total": F.sum("net_paise").over(proof)})
    return complete.filter((F.col("n") == F.size("matched_invoices")) & (F.col("total") == F.col("proof_paise"))).drop("n", "total")


def _accepted(rows: DataFrame) -> DataFrame:
    """proof_id, __bad: proofs accepted in ``__order``, each unless an accepted earlier one has an invoice of it.

    Every round accepts the proofs that are first for all their invoices and refuses those that share an invoice with
    them. The rounds follow the longest chain of proofs that wait for each other, not their number.
    """
    done = written(rows.groupBy("proof_id").agg(F.bool_or(F.col("__taken").isNotNull()).alias("__bad")).filter("__bad"))
    open_rows = written(rows.select("proof_id", "document_id", "__order").join(done, "proof_id", "left_anti"))
    settled = [done]
    while not open_rows.isEmpty():
        first = open_rows.groupBy("document_id").agg(F.min("__order").alias("__first"))
        won = written(open_rows.join(first, "document_id").groupBy("proof_id").agg(
            F.bool_and(F.col("__first") == F.col("__order")).alias("won")).filter("won").select("proof_id"))
        settled.append(won.withColumn("__bad", F.lit(False)))
        waiting = open_rows.join(won, "proof_id", "left_anti")
        claimed = open_rows.join(won, "proof_id", "left_semi").select("document_id").distinct()
        refused = written(waiting.join(claimed, "document_id", "left_semi").select("proof_id").distinct())
        settled.append(refused.withColumn("__bad", F.lit(True)))
        open_rows = written(waiting.join(refused, "proof_id", "left_anti"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def post_matches(proofs: DataFrame, invoices: DataFrame, reconciliations: DataFrame,
                 order: Column) -> tuple[DataFrame, DataFrame]:
    """(reconciliation rows, proof statuses): each proof is posted whole or not at all.

    A proof is a duplicate when any of its invoices is reconciled already or belongs to an earlier proof by
    ``order`` that is posted; an earlier proof that is refused blocks nothing.
    """
    rows = proof_rows(proofs.withColumn("__order", F.struct(order.alias("o"), "proof_id")), invoices)
    taken = reconciliations.select("document_id").distinct().withColumn("__taken", F.lit(True))
    judged = written(rows.join(taken, "document_id", "left"))
    verdict = _accepted(judged)
    statuses = proofs.join(verdict, "proof_id", "left").withColumn(
        "posting_status", F.when(F.col("__bad").isNull(), "PREREQUISITE_FAILED").when(F.col("__bad"), DUPLICATE)
        .otherwise("LEDGER_COMMITTED")).drop("__bad")
    posted = judged.join(verdict.filter("NOT __bad"), "proof_id").select(
        envelopes.event_id(F.col("document_id"), F.col("matched_utr")).alias("idempotency_event_id"), "document_id",
        "invoice_number", "vendor_code", F.col("matched_utr").alias("utr_number"), "payout_id",
        F.col("net_paise").alias("net_settled_amount_paise"))
    return posted, statuses


def completed_events(reconciliations: DataFrame) -> DataFrame:
    """One completed event per reconciled invoice, with its own net, keyed by vendor."""
    data = F.struct("vendor_code", F.array("invoice_number").alias("matched_invoices"),
                    F.col("payout_id").alias("razorpay_payout_id"), F.col("utr_number").alias("bank_utr_number"),
                    paise_to_rupees("net_settled_amount_paise").alias("total_reconciled_amount"))
    return reconciliations.select(
        F.lit(envelopes.TOPIC_COMPLETED).alias("topic"), F.col("vendor_code").alias("key"),
        envelopes.cloud_event(envelopes.RECONCILED, F.col("idempotency_event_id"), data).alias("value"))


def parse_completed(events: DataFrame, value: str = "value") -> DataFrame:
    """Completed events parsed and judged: ``error_code`` is NULL for a record that can be posted.

    Explicit debit and credit amounts each override the total, a null too. Texts must be texts: the typed parse
    turns numbers into texts, so the kinds come from a VARIANT parse.
    """
    both = F.struct(F.from_json(F.col(value), envelopes.COMPLETED_SCHEMA).alias("e"), F.try_parse_json(F.col(value)).alias("v"))
    e = events.withColumn("__parsed", F.explode(F.array(both))).withColumns({
        "e": F.col("__parsed.e"), "v": F.col("__parsed.v")}).drop("__parsed")
    d = F.col("e.data")

    def part(path: str) -> Column:
        return F.try_variant_get(F.col("v"), path, "variant")

    def is_kind(path: str, kind: str) -> Column:
        return F.coalesce(F.schema_of_variant(part(path)) == kind, F.lit(False))

    def amount(name: str) -> Column:
        explicit_null = F.coalesce(F.is_variant_null(part(f"$.data.{name}")), F.lit(False))
        return F.when(~explicit_null, F.coalesce(d[name], d["total_reconciled_amount"]))

    debit, credit = amount("debit_amount"), amount("credit_amount")
    texts = [is_kind(p, "STRING") for p in ("$.id", "$.source", "$.data.vendor_code", "$.data.bank_utr_number")]
    wrong_kind = ~(texts[0] & texts[1] & texts[2] & texts[3] & is_kind("$.data.matched_invoices", "ARRAY<STRING>"))

    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    listed = d["matched_invoices"]
    bad_list = listed.isNull() | (F.size(listed) == 0) | F.exists(listed, lambda x: F.coalesce(x, F.lit("")) == "")
    malformed = (wrong_kind | blank(F.col("e.id")) | blank(F.col("e.source")) | blank(d["vendor_code"]) | bad_list
                 | blank(d["bank_utr_number"]) | debit.isNull() | credit.isNull())
    debit_paise, credit_paise = rupees_to_paise(debit), rupees_to_paise(credit)
    code = (F.when(malformed, MALFORMED).when(debit_paise.isNull() | credit_paise.isNull(), BAD_AMOUNT)
            .when(debit_paise != credit_paise, UNBALANCED))
    return e.select(
        *[c for c in events.columns], F.col("e.id").alias("event_id"), d["vendor_code"].alias("vendor_code"),
        listed.alias("matched_invoice_ids"), d["razorpay_payout_id"].alias("payout_id"),
        d["bank_utr_number"].alias("utr_number"), debit_paise.alias("debit_paise"), credit_paise.alias("credit_paise"),
        code.alias("error_code"))


def new_records(parsed: DataFrame, processed: DataFrame) -> DataFrame:
    """Postable records whose event id was not processed before; the first of equal ids in the input wins."""
    good = parsed.filter("error_code IS NULL")
    return first_per_key(good, ["event_id"], [F.asc("vendor_code"), F.asc("utr_number"), F.asc("debit_paise")]).join(
        processed.select("event_id"), "event_id", "left_anti")


def ledger_headers(records: DataFrame) -> DataFrame:
    return records.select(
        F.sha2(F.col("event_id"), 256).alias("batch_id"), F.col("event_id").alias("idempotency_event_id"), "vendor_code",
        "utr_number", "payout_id", F.col("debit_paise").alias("total_reconciled_amount_paise"), "matched_invoice_ids")


def ledger_lines(records: DataFrame) -> DataFrame:
    """Exactly one DEBIT and one CREDIT row per record."""
    def line(account: tuple[str, Column], kind: str, amount: str) -> Column:
        return F.struct(F.lit(account[0]).alias("account_type"), account[1].alias("account_name"),
                        F.lit(kind).alias("entry_type"), F.col(amount).alias("amount_paise"))

    pair = F.array(line((DEBIT_ACCOUNT[0], F.concat(F.lit(DEBIT_ACCOUNT[1]), "vendor_code")), "DEBIT", "debit_paise"),
                   line((CREDIT_ACCOUNT[0], F.lit(CREDIT_ACCOUNT[1])), "CREDIT", "credit_paise"))
    return records.select(F.sha2(F.col("event_id"), 256).alias("batch_id"), "vendor_code", "utr_number",
                          F.col("matched_invoice_ids").alias("cleared_invoice_ids"), F.explode(pair).alias("l")).select(
        "batch_id", "vendor_code", "utr_number", "cleared_invoice_ids", "l.*")


def fatal_events(parsed: DataFrame, value: str = "value") -> DataFrame:
    """Records that cannot be posted, as side-output events around the original text."""
    data = F.struct(F.col(value).alias("original_event"), F.col("error_code"), F.col("error_code").alias("error"),
                    F.struct("event_id", "vendor_code", "debit_paise", "credit_paise").alias("details"))
    metadata = F.struct(F.lit("layer5_ledger_writer").alias("source"), F.col("error_code").alias("error"))
    return parsed.filter("error_code IS NOT NULL").select(
        F.lit(envelopes.TOPIC_FATAL).alias("topic"), F.col("error_code").alias("key"),
        envelopes.cloud_event(envelopes.FATAL, envelopes.event_id(F.col(value), prefix="fatal_"), data,
                              metadata=metadata).alias("value"))


def headers_with_lines(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with their lines nested, and the imbalance. A header has two lines, so the list stays short."""
    nested = lines.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("entry_type", "account_name", "amount_paise"))).alias("lines"),
        F.sum(F.when(F.col("entry_type") == "DEBIT", F.col("amount_paise")).otherwise(0)).alias("debit_paise"),
        F.sum(F.when(F.col("entry_type") == "CREDIT", F.col("amount_paise")).otherwise(0)).alias("credit_paise"))
    return headers.join(nested, "batch_id", "left").withColumn(
        "imbalance_paise", F.coalesce("debit_paise", F.lit(0)) - F.coalesce("credit_paise", F.lit(0)))


def ledger_totals(with_lines: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return with_lines.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("debit_paise"), zero).alias("debit_paise"),
                          F.coalesce(F.sum("credit_paise"), zero).alias("credit_paise"),
                          F.coalesce(F.sum("imbalance_paise"), zero).alias("imbalance_paise"))
