"""Event envelopes. Ids and times come from the business key and the data, so a replay writes the same event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics, event types, sources and aggregate names on the wire.
TOPIC_RAW = "invoice.processing.events"
TOPIC_EXTRACTED = "invoice.extracted.events"
TOPIC_COMPLETED = "reconciliation.completed.events"
TOPIC_DLQ = "reconciliation.dlq.events"
TOPIC_FATAL = "ledger.fatal.dlq.events"
SPEC_VERSION = "1.0"
RECONCILED = ("invoice.reconciled", "/layer2/agent")
EXCEPTION = ("reconciliation.exception", "/layer2/agent")
EXTRACTED = ("invoice.extracted", "/layer1/ingestion")
PAGE = ("batch.page.ingestion", "/layer1/batch")
POISON = ("invoice.processing.dlq", "layer1_extractor")
FATAL = ("ledger.fatal", "/layer5/ledger-writer")

COMPLETED_SCHEMA = (
    "specversion string, type string, source string, id string, time string, data struct<vendor_code:string,"
    "matched_invoices:array<string>,razorpay_payout_id:string,bank_utr_number:string,total_reconciled_amount:string,"
    "debit_amount:string,credit_amount:string>")
DLQ_SCHEMA = (
    "id string, type string, data struct<vendor_code:string,flagged_invoices:array<string>,bank_utr_number:string,"
    "exception_reason:string,variance_delta:string,human_readable_message:string>")
EXTRACTED_SCHEMA = (
    "id string, type string, time string, data struct<document_id:string,vendor_code:string,invoice_number:string,"
    "processing_status:string,batch_id:string,extracted_invoice:string>")
PAGE_SCHEMA = (
    "id string, type string, time string, data struct<batch_id:string,vendor_code:string,source_type:string,"
    "page_index:bigint,file_path:string,file_size:bigint>")


def event_id(*parts: Column, prefix: str = "evt_") -> Column:
    """Deterministic id of a business key."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *parts), 256))


def cloud_event(kind: tuple[str, str], id_: Column, data: Column, time: Column | None = None,
                metadata: Column | None = None) -> Column:
    """Envelope as JSON text; NULL fields are kept."""
    fields = [F.lit(SPEC_VERSION).alias("specversion"), F.lit(kind[0]).alias("type"), F.lit(kind[1]).alias("source"),
              id_.alias("id"), (time if time is not None else F.lit(None).cast("string")).alias("time"), data.alias("data")]
    if metadata is not None:
        fields.append(metadata.alias("metadata"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
