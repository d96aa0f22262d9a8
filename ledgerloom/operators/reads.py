"""Relational reads: open invoices, unmatched credits, lookups, newest-per-key and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.scale import first_per_key, spread_nulls

# Invoice and batch states the reads select on.
MATCHABLE_STATUS = "VALIDATED"
RUN_LIST_STATUSES = ("VALIDATED", "EXCEPTION_FLAGGED")
BATCH_DONE = "COMPLETED"
RUN_OPEN_STATUSES = ("SEALED", "RUNNING")
STALE_AFTER_SECONDS = 15 * 60
RUNNABLE_LIMIT = 5
STALE_LIMIT = 5
TOP_SETTLEMENTS = 20

UUID_PATTERN = r"(?i)\A\{?(urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\z"


def net_paise() -> Column:
    return F.col("grand_total_paise") - F.col("tds_deduction_paise")


def tenant(df: DataFrame, vendor_code: str) -> DataFrame:
    """Rows of one vendor; prunes partitions when the table is partitioned by vendor_code."""
    return df.filter(F.col("vendor_code") == vendor_code)


def optional_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; ``None`` means no filter on that column."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def open_invoices(invoices: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """Validated invoices nobody has paid yet."""
    return invoices.filter(F.col("processing_status") == MATCHABLE_STATUS).join(
        reconciliations.select("document_id"), "document_id", "left_anti")


def run_list(invoices: DataFrame) -> DataFrame:
    return invoices.filter(F.col("processing_status").isin(*RUN_LIST_STATUSES))


def positive_net(invoices: DataFrame) -> DataFrame:
    return invoices.filter(net_paise() > 0)


def unmatched_credits(bank: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """Credits whose (vendor, UTR) is not in the reconciliations; a credit without a UTR always stays.

    Credits without a UTR get a join key of their own, so that they do not meet in one partition.
    """
    done = reconciliations.filter(F.col("utr_number").isNotNull()).select(
        F.col("vendor_code").alias("__vendor"), F.col("utr_number").alias("__utr"))
    credits = bank.filter(F.col("transaction_type") == "CREDIT").withColumn(
        "__key", spread_nulls(F.col("utr_number"), F.col("transaction_id")))
    return credits.join(done, (F.col("vendor_code") == F.col("__vendor")) & (F.col("__key") == F.col("__utr")),
                        "left_anti").drop("__key")


def batch_open_invoices(items: DataFrame, open_inv: DataFrame) -> DataFrame:
    """Open invoices of each batch with a net above zero."""
    return positive_net(items.select("batch_id", "row_number", "document_id").join(open_inv, "document_id"))


def batch_run_list(items: DataFrame, invoices: DataFrame) -> DataFrame:
    return items.select("batch_id", "row_number", "document_id").join(run_list(invoices), "document_id")


def items_with_batch(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Items of a batch, only where item and batch belong to the same vendor."""
    heads = batches.select("batch_id", "vendor_code", F.col("status").alias("batch_status"))
    return items.join(heads, ["batch_id", "vendor_code"])


def runnable_batches(batches: DataFrame, runs: DataFrame, limit: int = RUNNABLE_LIMIT) -> DataFrame:
    """Completed batches without a run, oldest completion first."""
    return (batches.filter(F.col("status") == BATCH_DONE).join(runs.select("batch_id"), "batch_id", "left_anti")
            .orderBy(F.asc_nulls_last("completed_epoch"), "batch_id").limit(limit))


def stale_runs(runs: DataFrame, now_epoch: int | Column, limit: int = STALE_LIMIT) -> DataFrame:
    """Runs still open that never started or started too long ago, oldest first."""
    now = F.lit(now_epoch) if isinstance(now_epoch, int) else now_epoch
    old = F.col("started_epoch").isNull() | (F.col("started_epoch") < now - STALE_AFTER_SECONDS)
    return (runs.filter(F.col("status").isin(*RUN_OPEN_STATUSES) & old)
            .orderBy("created_epoch", "batch_id").limit(limit))


def batch_summary(batches: DataFrame, runs: DataFrame, batch_id: str | None = None,
                  vendor_code: str | None = None) -> DataFrame:
    """Batch header with its run, in one query; filters reach both scans."""
    heads = optional_filter(batches, batch_id=batch_id, vendor_code=vendor_code)
    tails = optional_filter(runs, batch_id=batch_id, vendor_code=vendor_code).select(
        "batch_id", "vendor_code", F.col("status").alias("run_status"), "run_type", "total_extracted",
        "matched_count", "exception_count", "started_epoch")
    return heads.join(tails, ["batch_id", "vendor_code"], "left").withColumn(
        "run_active", is_run_active(F.col("run_status")))


def is_run_active(run_status: Column) -> Column:
    """No run row yet counts as active."""
    return run_status.isNull() | run_status.isin(*RUN_OPEN_STATUSES)


def with_reconciled_flag(invoices: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """``already_committed`` per invoice."""
    done = reconciliations.select("document_id").distinct().withColumn("__done", F.lit(True))
    return invoices.join(done, "document_id", "left").withColumn(
        "already_committed", F.coalesce("__done", F.lit(False))).drop("__done")


def onboarded_only(df: DataFrame, vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known vendors, and the rejected rest."""
    known = vendors.select("vendor_code")
    return df.join(known, "vendor_code", "left_semi"), df.join(known, "vendor_code", "left_anti")


def latest_batch(batches: DataFrame) -> DataFrame:
    """Newest batch per vendor."""
    return first_per_key(batches, ["vendor_code"], [F.desc("created_epoch"), F.asc("batch_id")])


def latest_completed_batch(batches: DataFrame) -> DataFrame:
    """Newest completed batch per vendor; those without a completion time come last."""
    return first_per_key(batches.filter(F.col("status") == BATCH_DONE), ["vendor_code"],
                         [F.desc_nulls_last("completed_epoch"), F.desc("created_epoch"), F.asc("batch_id")])


def lead_user(users: DataFrame) -> DataFrame:
    """One user per vendor: an ADMIN before anyone else, then the oldest."""
    return first_per_key(users, ["vendor_code"],
                         [F.when(F.col("role") == "ADMIN", 0).otherwise(1), F.asc("created_epoch"), F.asc("email")])


def latest_anchor(settlements: DataFrame) -> DataFrame:
    """Newest processed settlement per (vendor, referenced invoice).

    UTR and amount count only together and only when the UTR is set; the payout id counts regardless.
    """
    newest = F.struct("ingested_epoch", "payout_id")
    body = F.struct("payout_id", "utr", "amount_paise", "narration",
                    (F.col("fees_paise") + F.col("tax_paise")).alias("gateway_paise"))
    # max_by is aggregated map-side, so a much-repeated reference ships one row per task.
    best = (settlements.filter((F.col("status") == "processed") & F.col("reference_id").isNotNull())
            .groupBy("vendor_code", F.col("reference_id").alias("invoice_number"))
            .agg(F.max_by(body, newest).alias("a")))
    has_utr = F.col("a.utr").isNotNull() & (F.col("a.utr") != "")
    return best.select(
        "vendor_code", "invoice_number", F.col("a.payout_id").alias("anchor_payout_id"),
        F.when(has_utr, F.col("a.utr")).alias("anchor_utr"),
        F.when(has_utr, F.col("a.amount_paise")).alias("anchor_amount_paise"),
        F.col("a.gateway_paise").alias("anchor_gateway_paise"),
        F.when(has_utr, F.coalesce("a.narration", F.lit(""))).alias("anchor_narration"))


def with_anchor(invoices: DataFrame, settlements: DataFrame) -> DataFrame:
    """Invoices with their settlement anchor and the matching target.

    The target is the anchored amount when there is one and it is not zero, else the net, never below 0.
    """
    joined = invoices.join(latest_anchor(settlements), ["vendor_code", "invoice_number"], "left")
    net = F.greatest(F.lit(0), F.col("net_paise")).cast("long")
    return joined.withColumn("net_expected_paise", net).withColumn(
        "target_paise", F.coalesce(F.nullif(F.col("anchor_amount_paise"), F.lit(0)), F.col("net_expected_paise")))


def three_way_chain(anchored: DataFrame, credits: DataFrame) -> DataFrame:
    """Invoice, its settlement, and the bank credit carrying the settlement's UTR."""
    side = credits.filter(F.col("utr_number").isNotNull()).select(
        "vendor_code", F.col("utr_number").alias("anchor_utr"), "transaction_id", "transaction_date",
        F.col("amount_paise").alias("credit_amount_paise"))
    return anchored.filter(F.col("anchor_utr").isNotNull()).join(side, ["vendor_code", "anchor_utr"])


def newest_narrated_settlements(settlements: DataFrame, n: int = TOP_SETTLEMENTS) -> DataFrame:
    """The ``n`` newest settlements per vendor that carry a UTR and a narration."""
    usable = settlements.filter(F.col("utr").isNotNull() & F.col("narration").isNotNull() & (F.col("narration") != ""))
    return first_per_key(usable, ["vendor_code"], [F.desc("ingested_epoch"), F.desc("payout_id")], n)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_PATTERN), F.lit(False))


def newest_tickets(tickets: DataFrame, status: str | None = None, vendor_code: str | None = None,
                   limit: int = 50) -> DataFrame:
    """Newest tickets first; ``limit`` is part of the report and lies in 1..500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    rows = optional_filter(tickets, status=status, vendor_code=vendor_code)
    return rows.orderBy(F.desc("created_epoch"), "ticket_id").limit(limit)


def newest_headers(headers: DataFrame, vendor_code: str | None = None, utr_number: str | None = None,
                   batch_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest ledger headers; every filter is applied before the limit."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rows = optional_filter(headers, vendor_code=vendor_code, utr_number=utr_number, batch_id=batch_id)
    return rows.orderBy(F.desc("created_epoch"), "batch_id").limit(limit)


def by_row_number(items: DataFrame) -> DataFrame:
    return items.orderBy("batch_id", F.asc_nulls_last("row_number"))

