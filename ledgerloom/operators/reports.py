"""Read models: per-invoice telemetry, funnel, KPIs, run outcome, audit feed, expected feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import expected_bank_date, midnight_epoch
from ledgerloom.functions.labels import (SUBSET_MESSAGE_CAP, TERMINAL_DETAIL_CAP, cleared_text, exception_text)
from ledgerloom.functions.money import format_inr
from ledgerloom.scale import first_per_key, ordinal, ordinal_from_end, running_sum, spread_nulls

# Terminal states, texts that tell a deterministic note from an answer, and report sizes.
COMMITTED_STATES = ("LEDGER_COMMITTED", "ALREADY_COMMITTED")
EXCEPTION_ROUTED = "EXCEPTION_ROUTED"
DETERMINISTIC_MARKS = ("Deterministic fallback:", "Groq invocation failed")
ALIAS_TOOL = "run_fuzzy_text_linker_tool"
FEED_SIZE = 12
OUTBOX_SIZE = 10
# Parts of log lines that other steps look for.
NO_MODEL, PROVEN = "never invoked", "-> SUBSET_MATCHED"

RETRY_DELAY_SECONDS = 30
FIRST_UTR = 300000000001


# -- per invoice ----------------------------------------------------------------------------------

def ticket_reasons(tickets: DataFrame, items: DataFrame, batches: DataFrame) -> DataFrame:
    """Reason per (batch, invoice) from tickets created at or after the batch; the oldest ticket wins."""
    flagged = tickets.select("vendor_code", F.explode("flagged_invoice_ids").alias("invoice_number"),
                             F.col("created_epoch").alias("t_epoch"), "ticket_id", "exception_reason")
    heads = batches.select("batch_id", F.col("created_epoch").alias("b_epoch"))
    wanted = items.filter("invoice_number IS NOT NULL").select("batch_id", "vendor_code", "invoice_number")
    hits = flagged.join(wanted, ["vendor_code", "invoice_number"]).join(heads, "batch_id").filter("t_epoch >= b_epoch")
    return hits.groupBy("batch_id", "invoice_number").agg(
        F.min_by("exception_reason", F.struct("t_epoch", "ticket_id")).alias("exception_reason"))


def invoice_telemetry(items: DataFrame, invoices: DataFrame, reconciliations: DataFrame, reasons: DataFrame,
                      paths: DataFrame | None = None) -> DataFrame:
    """One row per batch item with its invoice, reconciliation, review reason and path."""
    inv = invoices.select("document_id", "processing_status",
                          (F.col("grand_total_paise") - F.col("tds_deduction_paise")).alias("net_paise"))
    rec = reconciliations.select("document_id", "utr_number", "payout_id", "net_settled_amount_paise")
    # Failed items have no document; each gets a key of its own, so that they do not meet in one partition.
    item = [F.col("batch_id"), F.col("row_number").cast("string")]
    keyed = items.withColumns({"__doc": spread_nulls(F.col("document_id"), *item),
                               "__number": spread_nulls(F.col("invoice_number"), *item)})
    facts = inv.join(rec, "document_id", "left")
    if paths is not None:
        facts = facts.join(paths, "document_id", "left")
    else:
        facts = facts.withColumn("path", F.lit(None).cast("string"))
    return (keyed.join(facts.withColumnRenamed("document_id", "__doc"), "__doc", "left")
            .join(reasons.withColumnRenamed("invoice_number", "__number"), ["batch_id", "__number"], "left")
            .drop("__doc", "__number"))


def _set(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def funnel(rows: DataFrame) -> DataFrame:
    """Counts per batch; an invoice can count as settled and as exception. Path counts need some telemetry."""
    known = F.count("path") > 0
    settled, exceptions = F.count_if(_set("utr_number")), F.count_if(_set("exception_reason"))
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), settled.alias("settled"), exceptions.alias("exceptions"),
        F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - settled - exceptions).alias("open"),
        F.when(known, F.count_if(F.col("path") == "fast_path")).alias("fast_path"),
        F.when(known, F.count_if(F.col("path").isin("agent", "deterministic_fallback"))).alias("agent_routed"))


def kpis(rows: DataFrame) -> DataFrame:
    """Money cleared and at risk per batch, clearance rate, and the open share."""
    cleared = _set("utr_number") & F.col("net_settled_amount_paise").isNotNull()
    review = ~cleared & _set("exception_reason")
    extracted = F.coalesce(F.col("processing_status") == "VALIDATED", F.lit(False)) | _set("utr_number") | _set("exception_reason")
    zero = F.lit(0).cast("long")
    k = rows.groupBy("batch_id").agg(
        F.coalesce(F.sum(F.when(cleared, F.col("net_settled_amount_paise"))), zero).alias("cleared_paise"),
        F.count_if(cleared).alias("cleared_count"),
        F.coalesce(F.sum(F.when(review, F.col("net_paise"))), zero).alias("review_paise"),
        F.count_if(review).alias("review_count"), F.count_if(extracted).alias("__x"))
    return k.withColumn("extracted_count", F.greatest("__x", F.col("cleared_count") + F.col("review_count"))).drop("__x").withColumns({
        "auto_rate": F.col("cleared_count") / F.greatest(F.lit(1), F.col("extracted_count")) * 100,
        "open_count": F.greatest(zero, F.col("extracted_count") - F.col("cleared_count") - F.col("review_count")),
        "cleared_pct": F.when(F.col("extracted_count") > 0, F.col("cleared_count") / F.col("extracted_count") * 100).otherwise(0.0)})


def list_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("batch_id").agg(F.count_if(_set("utr_number")).alias("cleared"),
                                        F.count_if(_set("exception_reason")).alias("in_review"))


# -- batches and runs -----------------------------------------------------------------------------

def batch_progress(batches: DataFrame, page_outcomes: DataFrame) -> DataFrame:
    """Processed, failed and percent per batch, recounted over distinct pages, so redelivery cannot drift.

    ``page_outcomes``: batch_id, page_index, ok. A page with both outcomes counts as processed.
    """
    pages = page_outcomes.groupBy("batch_id", "page_index").agg(F.bool_or("ok").alias("ok"))
    counts = pages.groupBy("batch_id").agg(F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))
    total = F.col("total_invoices")
    joined = batches.select("batch_id", "total_invoices").join(counts, "batch_id", "left").fillna(0, ["processed", "failed"])
    return joined.withColumns({
        "progress_pct": F.round(F.when(total > 0, F.col("processed") / total * 100).otherwise(0.0), 1),
        "complete": F.col("processed") + F.col("failed") >= total})


def run_outcome(batches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Matched, exceptions, shortfall and final status per sealed batch; outcomes: batch_id, document_id, terminal."""
    counts = outcomes.groupBy("batch_id").agg(
        F.count_if(F.col("terminal").isin(*COMMITTED_STATES)).alias("matched_count"), F.count(F.lit(1)).alias("inputs"))
    joined = batches.select("batch_id", "total_invoices").join(counts, "batch_id", "left").fillna(0, ["matched_count", "inputs"])
    return joined.select(
        "batch_id", "matched_count", (F.col("inputs") - F.col("matched_count")).alias("exception_count"),
        F.greatest(F.lit(0).cast("long"), F.col("total_invoices") - F.col("inputs")).alias("shortfall"),
        F.when(F.col("inputs") > 0, "COMPLETED").otherwise("PARTIAL").alias("status"))


# -- telemetry ------------------------------------------------------------------------------------

def telemetry_fold(events: DataFrame) -> DataFrame:
    """Path, llm_invoked and number of tool calls per (batch, invoice), from events in (ts, event_id) order."""
    order = F.struct("ts_us", "event_id")
    seen = events.dropDuplicates(["event_id"])
    quiet = (F.col("stage") == "deterministic") & (
        F.col("detail").contains(NO_MODEL) | F.col("detail").contains(PROVEN))
    llm = F.when(F.col("stage") == "agent", True).when(quiet, False)
    folded = seen.groupBy("batch_id", "invoice").agg(
        F.max_by(llm, F.when(llm.isNotNull(), order)).alias("llm"),
        F.bool_or(F.col("stage") == "agent").alias("agent"),
        F.count_if(F.col("stage") == "tool_called").alias("tool_calls"),
        F.bool_or(F.col("stage") == "terminal").alias("ended"),
        F.max_by("terminal_status", F.when(F.col("stage") == "terminal", order)).alias("terminal_status"))
    helped = F.coalesce("llm", F.lit(False)) | (F.col("tool_calls") > 0)
    path = (F.when(F.col("ended") & (F.col("terminal_status") == EXCEPTION_ROUTED),
                   F.when(helped, "agent").otherwise("deterministic_fallback"))
            .when(F.col("ended") & F.col("terminal_status").isin(*COMMITTED_STATES),
                  F.when(helped, "agent").otherwise("fast_path"))
            .when(F.col("agent"), "agent"))
    return folded.select("batch_id", "invoice", path.alias("path"), F.when(
        F.col("ended"), F.coalesce("llm", F.lit(False))).otherwise(F.col("llm")).alias("llm_invoked"), "tool_calls")


def tool_calls(events: DataFrame) -> DataFrame:
    """Tool calls as rows, numbered per (batch, invoice) in order; a list per invoice could be arbitrarily long."""
    calls = events.dropDuplicates(["event_id"]).filter("stage = 'tool_called'")
    return ordinal(calls, ["batch_id", "invoice"], F.expr("ts_us div 86400000000"),
                   [F.col("ts_us"), F.col("event_id")], "call_no").select("batch_id", "invoice", "call_no", F.col("detail").alias("tool"))


def message_path(messages: Column) -> Column:
    """``struct(path, llm_invoked, tool_calls)`` from ``array<struct(type, content, tool_calls)>``."""
    ai = F.filter(messages, lambda m: m["type"] == "ai")
    tools = F.filter(F.flatten(F.transform(ai, lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<string>")))),
                     lambda t: F.coalesce(t, F.lit("")) != "")

    def answered(m: Column) -> Column:
        noted = F.lit(False)
        for mark in DETERMINISTIC_MARKS:
            noted = noted | F.coalesce(m["content"], F.lit("")).startswith(mark)
        return (F.size(F.coalesce(m["tool_calls"], F.array().cast("array<string>"))) > 0) | ~noted

    llm = F.exists(ai, answered)
    return F.struct(F.when((F.size(tools) == 0) & ~llm, "fast_path").otherwise("agent").alias("path"),
                    llm.alias("llm_invoked"), tools.alias("tool_calls"))


def event_lines(outcomes: DataFrame) -> DataFrame:
    """Log lines of each invoice's run, in order: started, deterministic, agent, tools, terminal."""
    def line(stage: str, detail: Column, status: Column | None = None, utr: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(stage).alias("stage"), detail.alias("detail"),
                        (status if status is not None else none).alias("terminal_status"),
                        (utr if utr is not None else none).alias("utr"))

    message = F.when(F.coalesce("subset_message", F.lit("")) != "", F.concat(
        F.lit(" :: "), F.left("subset_message", F.lit(SUBSET_MESSAGE_CAP)))).otherwise("")
    detail = F.coalesce(F.nullif(F.left("terminal_detail", F.lit(TERMINAL_DETAIL_CAP)), F.lit("")), F.col("terminal"))
    head = F.array_compact(F.array(
        line("started", F.lit("Run of this invoice begins")),
        F.when(F.coalesce("subset_status", F.lit("")) != "", line("deterministic", F.concat(
            F.lit("run_subset_sum_matching_tool -> "), "subset_status", message))),
        F.when(F.col("path") == "fast_path", line("deterministic", F.lit("Settled by rules, model never invoked")))
        .when(F.col("llm_invoked"), line("agent", F.lit("Tool agent takes over")))))
    tools = F.transform("tool_calls", lambda t: line("tool_called", t))
    end = F.array(line("terminal", detail, F.col("terminal"), F.col("terminal_utr")))
    return outcomes.select("invoice_number", F.posexplode(F.concat(head, tools, end)).alias("line_no", "l")).select(
        "invoice_number", "line_no", "l.*")


def case_narrative(rows: DataFrame) -> DataFrame:
    """Reviewer's text per unresolved invoice: what was tried, with which UTR and target."""
    target = F.when(F.col("target_paise").isNotNull(), F.concat(
        F.lit("Wanted net amount: Rs."), F.call_function("div", F.col("target_paise"), F.lit(100)).cast("string"),
        F.lit("."), F.lpad((F.col("target_paise") % 100).cast("string"), 2, "0"), F.lit(".")))
    return rows.withColumn("narrative", F.concat_ws(
        "\n", F.concat(F.lit("Rules on "), "invoice_number", F.lit(": matching says "),
                       "subset_status", F.lit(".")),
        F.when(F.col("anchor_utr").isNotNull(), F.concat(F.lit("Tried with UTR "), "anchor_utr", F.lit("."))),
        target))


# -- audit feed -----------------------------------------------------------------------------------

def alias_notices(events: DataFrame) -> DataFrame:
    """One notice per (batch, invoice) whose supplier name was linked, the newest event of each."""
    used = events.filter((F.col("stage") == "tool_called") & F.lower("detail").contains(ALIAS_TOOL))
    return used.groupBy("batch_id", "invoice_number").agg(F.max("ts").alias("ts")).withColumn("title", F.concat(
        F.lit("Supplier name linked for "), "invoice_number", F.lit(": a payout names it.")))


def audit_feed(rows: DataFrame, events: DataFrame, size: int = FEED_SIZE) -> DataFrame:
    """First ``size`` entries per batch: alias notices, newest first, then outcomes, last row first."""
    cleared = _set("utr_number") & F.col("net_settled_amount_paise").isNotNull()
    review = _set("exception_reason")
    title = F.when(cleared, cleared_text(F.col("invoice_number"), F.col("utr_number"), F.col("net_settled_amount_paise"))).when(
        review, exception_text(F.col("exception_reason"), F.coalesce("invoice_number", F.lit(""))))
    detail = F.when(cleared, F.lit("In the ledger, debit equals credit.")).when(
        review & F.col("net_paise").isNotNull(), F.concat(format_inr("net_paise"), F.lit(" waits for a decision.")))
    outcomes = rows.filter(cleared | review).select(
        "batch_id", F.lit(1).alias("section"), F.col("row_number").alias("rank"), "invoice_number",
        F.when(cleared, "success").otherwise("pending").alias("tone"), title.alias("title"), detail.alias("detail"))
    notices = alias_notices(events).select(
        "batch_id", F.lit(0).alias("section"), F.col("ts").alias("rank"), "invoice_number", F.lit("info").alias("tone"), "title",
        F.lit(None).cast("string").alias("detail"))
    return first_per_key(notices.unionByName(outcomes), ["batch_id"],
                         [F.asc("section"), F.desc("rank"), F.asc("invoice_number")], size)


# -- outbox ---------------------------------------------------------------------------------------

def due_outbox(outbox: DataFrame, now_epoch: int, size: int = OUTBOX_SIZE) -> DataFrame:
    """The oldest pending rows that are due."""
    return outbox.filter((F.col("status") == "PENDING") & (F.col("available_epoch") <= now_epoch)).orderBy(
        "created_epoch", "outbox_id").limit(size)


def relay_result(outbox: DataFrame, results: DataFrame, now_epoch: int) -> DataFrame:
    """The outbox after a relay round; results: outbox_id, ok, error.

    A failure counts as a retry and is put off, unless the retries are used up. Only pending rows are ever
    relayed, so a failed row stays failed.
    """
    joined = outbox.join(results, "outbox_id", "left")
    failed = ~F.col("ok") & (F.col("retry_count") < F.col("max_retries"))
    return joined.withColumns({
        "status": F.when(F.col("ok"), "PUBLISHED").when(failed, "FAILED").otherwise(F.col("status")),
        "published_epoch": F.when(F.col("ok"), F.lit(now_epoch).cast("long")).otherwise(F.col("published_epoch")),
        "last_error": F.when(failed, F.col("error")).otherwise(F.col("last_error")),
        "available_epoch": F.when(failed, F.lit(now_epoch + RETRY_DELAY_SECONDS).cast("long")).otherwise(F.col("available_epoch")),
        "retry_count": F.col("retry_count") + F.when(failed, 1).otherwise(0)}).drop("ok", "error")


# -- expected feeds -------------------------------------------------------------------------------

def expected_feed(invoices: DataFrame, bucket: Column, drop_last: int = 0) -> DataFrame:
    """Settlement and statement line each open invoice should produce, per vendor in invoice-number order.

    The last ``drop_last`` invoices of a vendor get none. ``bucket`` must not decrease with invoice_number;
    positions and balances are worked out per (vendor, bucket).
    """
    order = [F.col("invoice_number")]
    placed = ordinal_from_end(invoices.filter("net_paise > 0"), ["vendor_code"], bucket, order, "__from_end")
    kept = placed.filter(F.col("__from_end") > drop_last).withColumnRenamed("__from_end_fwd", "idx").drop("__from_end")
    utr = (F.lit(FIRST_UTR) + F.col("idx")).cast("string")  # twelve digits or more
    day = expected_bank_date(F.col("document_date"))
    number = F.col("idx").cast("string")
    short = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    rows = kept.select(
        "vendor_code", "invoice_number", "idx", utr.alias("utr"), F.concat(F.lit("pout_e2e_"), short).alias("payout_id"),
        F.concat(F.lit("fa_e2e_"), short).alias("fund_account_id"),
        F.col("net_paise").alias("amount_paise"), day.alias("transaction_date"), midnight_epoch(day).alias("event_created_at_epoch"),
        F.concat(F.upper("supplier_legal_name"), F.lit(" - PAYOUT "), "invoice_number").alias("settlement_narration"),
        F.concat(F.lit("CREDIT/IMPS/"), utr, F.lit("/"), F.upper("supplier_legal_name"), F.lit("/"), "invoice_number").alias("bank_narration"))
    return running_sum(rows, ["vendor_code"], bucket, order, F.col("amount_paise"), "closing_balance_paise")
