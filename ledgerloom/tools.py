"""The five matching tools as DataFrame transforms, and one pass over all open invoices built from them.

    link_names   supplier names against settlement narrations
    deduct       gross-to-net waterfall
    match        amount / name / date decision per request
    post         reconciliations and completed events for proven matches
    route        exception events for everything else
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.deductions import with_waterfall as deduct
from ledgerloom.functions.text import narration_tokens
from ledgerloom.operators.exceptions import exception_events
from ledgerloom.operators.linking import fuzzy_verdict as link_names
from ledgerloom.operators.matching import MATCHED, WORDS, fast_path, match_requests, request_guard, resolve_exceptions
from ledgerloom.operators.posting import completed_events, post_matches
from ledgerloom.scale import first_per_key, written

__all__ = ["link_names", "deduct", "match", "post", "route", "reconcile_snapshot"]


REFUSED = "PREREQUISITE_FAILED"  # status of a request that may not be asked


def match(requests: DataFrame, credits: DataFrame, invoices: DataFrame, **options) -> DataFrame:
    """Verdicts of requests with anchor_utr and target_paise; those that fail :func:`request_guard` are refused unasked."""
    guarded = request_guard(requests)
    asked = match_requests(guarded.filter("guard_reason IS NULL"), credits, invoices, **options)
    refused = guarded.filter("guard_reason IS NOT NULL").withColumn("subset_status", F.lit(REFUSED))
    return asked.unionByName(refused, allowMissingColumns=True)


def post(proofs: DataFrame, invoices: DataFrame, reconciliations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reconciliations, completed events, statuses) for proofs, whole or not at all."""
    posted, statuses = post_matches(proofs, invoices, reconciliations, F.col("proof_id"))
    return posted, completed_events(posted), statuses


def route(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exception events, refused rows): an invoice with a proof may not be sent to review."""
    proven = F.coalesce(F.col("subset_status") == MATCHED, F.lit(False))
    return exception_events(reviews.filter(~proven)), reviews.filter(proven)


def reconcile_snapshot(invoices: DataFrame, settlements: DataFrame, credits: DataFrame, reconciliations: DataFrame,
                       **options) -> tuple[DataFrame, DataFrame]:
    """(posted reconciliations, outcome per open invoice) of one pass on one snapshot of the tables.

    All invoices see the same pool. Of proofs that claim the same credit, the one asked for by the lowest
    document id stands; the others stay open for the next pass. Use ``reconcile_in_order`` for the result
    of strictly one invoice after the other.
    """
    # Each step reads what it needs from files: derived once, and only the columns that are used.
    invoices = written(invoices.select("document_id", "vendor_code", "invoice_number", "document_date", "supplier_legal_name", "net_paise"))
    credits = written(credits.select("vendor_code", "transaction_id", "utr_number", "transaction_date", "amount_paise",
                                     narration_tokens("narration").alias(WORDS)))
    bare = settlements.withColumns({"narration": F.lit(None).cast("string"), "fees_paise": F.lit(0), "tax_paise": F.lit(0)})
    keep = ["vendor_code", "document_id", "matched_invoices", "matched_utr", "proof_paise"]
    first = written(fast_path(invoices, bare, credits, **options).select(
        *keep, "invoice_number", "supplier_legal_name", "anchor_payout_id", "subset_status", "committable"))
    again = written(resolve_exceptions(first.filter("NOT committable"), settlements, credits, invoices, **options).select(
        *keep, "anchor_payout_id", "fuzzy_payout_id", "committable", "review_reason"))
    claims = first.filter("committable").select(*keep, F.col("anchor_payout_id").alias("payout_id")).unionByName(
        again.filter("committable").select(*keep, F.coalesce("anchor_payout_id", "fuzzy_payout_id").alias("payout_id")))
    proofs = first_per_key(claims.filter("matched_utr IS NOT NULL"), ["vendor_code", "matched_utr"], [F.asc("document_id")]).withColumnRenamed(
        "document_id", "proof_id")
    posted, _ = post_matches(proofs, invoices, reconciliations, F.col("proof_id"))
    posted = written(posted)
    cleared = posted.select("document_id", F.col("utr_number").alias("utr"))
    # A proof by a credit without a UTR cannot be posted; a person has to look at it.
    no_utr = first.filter("committable AND matched_utr IS NULL").select("document_id", F.lit("REASON_UNSPECIFIED").alias("review_reason"))
    reasons = again.select("document_id", F.coalesce("review_reason", F.when(F.col("matched_utr").isNull(), "REASON_UNSPECIFIED")).alias(
        "review_reason")).unionByName(no_utr)
    outcomes = invoices.select("document_id", "vendor_code", "invoice_number").join(cleared, "document_id", "left").join(
        reasons, "document_id", "left").withColumn(
        "terminal", F.when(F.col("utr").isNotNull(), "LEDGER_COMMITTED").when(F.col("review_reason").isNotNull(), "EXCEPTION_ROUTED")
        .otherwise("OPEN"))
    return posted, outcomes
