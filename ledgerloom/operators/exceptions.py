"""Review queue: exception events, tickets and their life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import envelopes
from ledgerloom.functions.money import variance_to_paise
from ledgerloom.scale import first_per_key

# Defaults of a ticket, and the allowed moves between states.
UNKNOWN_VENDOR, NO_ID, NO_REASON, NO_MESSAGE = "UNKNOWN", "no-id", "REASON_UNSPECIFIED", "No message provided."
TRANSITIONS = {"OPEN": ("IN_REVIEW",), "IN_REVIEW": ("RESOLVED", "CLOSED")}
TERMINAL = ("RESOLVED", "CLOSED")


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _id(c: Column, payload: Column) -> Column:
    """The event's id; an event without one is told apart by its text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.concat(F.lit(NO_ID + "-"), F.sha2(F.coalesce(payload, F.lit("")), 256)))


def exception_events(reviews: DataFrame) -> DataFrame:
    """Dead-letter events for invoices that go to review; a blank reason becomes the unspecified one.

    ``reviews``: vendor_code, document_id, invoice_number, utr, review_reason, variance, message; with a ``run_id``, the same
    problem can be raised again by a later run, without one it is raised once.
    """
    run = [F.col("run_id")] if "run_id" in reviews.columns else []
    reason = _or(F.trim("review_reason"), NO_REASON)
    data = F.struct("vendor_code", F.array("invoice_number").alias("flagged_invoices"), F.col("utr").alias("bank_utr_number"),
                    reason.alias("exception_reason"), F.col("variance").alias("variance_delta"),
                    F.col("message").alias("human_readable_message"),
                    F.struct(F.lit("layer2_agent").alias("source"), reason.alias("error")).alias("metadata"))
    return reviews.select(
        F.lit(envelopes.TOPIC_DLQ).alias("topic"), F.col("vendor_code").alias("key"),
        envelopes.cloud_event(envelopes.EXCEPTION, envelopes.event_id(F.col("document_id"), reason, *run), data).alias("value"))


def tickets_from_dlq(events: DataFrame, topic: str = envelopes.TOPIC_DLQ, value: str = "value") -> DataFrame:
    """Ticket rows from dead-letter events, defaults filled in."""
    e = events.select(F.col(value).alias("flagged_payload"),
                      F.explode(F.array(F.from_json(F.col(value), envelopes.DLQ_SCHEMA))).alias("e"))
    d = F.col("e.data")
    return e.select(
        _id(F.col("e.id"), F.col("flagged_payload")).alias("source_event_id"), F.lit(topic).alias("source_topic"),
        _or(d["vendor_code"], UNKNOWN_VENDOR).alias("vendor_code"), d["bank_utr_number"].alias("bank_utr_number"),
        F.coalesce(d["flagged_invoices"], F.array().cast("array<string>")).alias("flagged_invoice_ids"),
        _or(d["exception_reason"], NO_REASON).alias("exception_reason"),
        variance_to_paise(d["variance_delta"]).alias("variance_delta_paise"),
        _or(d["human_readable_message"], NO_MESSAGE).alias("human_readable_message"), "flagged_payload")


def tickets_from_fatal(parsed: DataFrame, topic: str = envelopes.TOPIC_FATAL, value: str = "value") -> DataFrame:
    """Ticket rows from completed events the ledger refused."""
    bad = parsed.filter("error_code IS NOT NULL")
    return bad.select(
        _id(F.col("event_id"), F.col(value)).alias("source_event_id"), F.lit(topic).alias("source_topic"),
        _or(F.col("vendor_code"), UNKNOWN_VENDOR).alias("vendor_code"), F.col("utr_number").alias("bank_utr_number"),
        F.coalesce("matched_invoice_ids", F.array().cast("array<string>")).alias("flagged_invoice_ids"),
        F.col("error_code").alias("exception_reason"),
        F.when(F.col("error_code") == "ORPHANED_DEBIT_CREDIT_MISMATCH",
               F.col("debit_paise") - F.col("credit_paise")).alias("variance_delta_paise"),
        F.col("error_code").alias("human_readable_message"), F.col(value).alias("flagged_payload"))


def new_tickets(tickets: DataFrame, processed: DataFrame) -> DataFrame:
    """Tickets whose event was not ticketed before; the first of equal ids wins."""
    return first_per_key(tickets, ["source_event_id"], [F.asc("source_topic"), F.asc("flagged_payload")]).join(
        processed.select(F.col("event_id").alias("source_event_id")), "source_event_id", "left_anti")


def move_tickets(tickets: DataFrame, moves: DataFrame) -> DataFrame:
    """Tickets after the requested moves (ticket_id, new_status, moved_by, moved_epoch), one move per ticket.

    ``move_result`` is allowed, rejected, or NULL without a request; ``allowed_next`` lists what is allowed.
    """
    table = F.create_map(*[x for s, nxt in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, nxt)))])
    allowed = F.coalesce(F.try_element_at(table, F.col("status")), F.array().cast("array<string>"))
    ok = F.array_contains(allowed, F.col("new_status"))
    done = ok & F.col("new_status").isin(*TERMINAL)

    def kept(name: str) -> Column:
        return F.col(name) if name in tickets.columns else F.lit(None)

    return (tickets.join(moves, "ticket_id", "left")
            .withColumn("allowed_next", allowed)
            .withColumn("move_result", F.when(F.col("new_status").isNotNull(), F.when(ok, "allowed").otherwise("rejected")))
            .withColumn("resolved_by", F.when(done, F.col("moved_by")).otherwise(kept("resolved_by")))
            .withColumn("resolved_epoch", F.when(done, F.col("moved_epoch")).otherwise(kept("resolved_epoch")))
            .withColumn("status", F.when(ok, F.col("new_status")).otherwise(F.col("status"))))
