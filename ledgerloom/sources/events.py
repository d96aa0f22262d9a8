"""Event sources and sinks: Kafka topics, envelopes, quarantine, outgoing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import envelopes

# Fixed value: how many events without a batch one poll takes.
SINGLES_PER_POLL = 20


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, **options: str) -> DataFrame:
    """A topic as a stream of (topic, key, value, timestamp) with text key and value."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option(
        "startingOffsets", "earliest")
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select("topic", F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def kafka_sink(events: DataFrame, servers: str, checkpoint: str) -> StreamingQuery:
    """Write (topic, key, value) rows, each to the topic it names."""
    return (events.select("topic", "key", "value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("checkpointLocation", checkpoint).start())


def write_kafka(events: DataFrame, servers: str) -> None:
    events.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def open_envelopes(events: DataFrame, schema: str, time_column: str | None = None) -> DataFrame:
    """Parsed envelopes as column ``e`` with ``malformed`` set where the text is none; nothing is dropped.

    The event time is the envelope's, else the transport's.
    """
    parsed = events.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    blank = F.col("e").isNull() | (F.col("e.id").isNull() & F.col("e.data").isNull())
    fallback = F.col(time_column) if time_column else F.lit(None).cast("timestamp")
    return parsed.withColumn("malformed", blank).withColumn("event_time", F.coalesce(F.try_to_timestamp(F.col("e.time")), fallback))


def split_malformed(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable events, quarantine)."""
    return opened.filter("NOT malformed"), opened.filter("malformed").drop("e")


def extracted_events(invoices: DataFrame) -> DataFrame:
    """One extracted event per invoice, keyed by vendor.

    ``invoices``: document_id, vendor_code, invoice_number, processing_status, batch_id, extracted_invoice.
    """
    data = F.struct("document_id", "vendor_code", "invoice_number", "processing_status", "batch_id", "extracted_invoice")
    return invoices.select(
        F.lit(envelopes.TOPIC_EXTRACTED).alias("topic"), F.col("vendor_code").alias("key"),
        envelopes.cloud_event(envelopes.EXTRACTED, envelopes.event_id(F.col("document_id")), data).alias("value"))


def page_events(pages: DataFrame) -> DataFrame:
    """Outbox payloads of page events; pages as from ``fan_out_pages`` plus source_type, file_path, file_size."""
    data = F.struct("batch_id", "vendor_code", "source_type", "page_index", "file_path", "file_size")
    return pages.select(F.lit(envelopes.TOPIC_RAW).alias("topic"), F.col("partition_key").alias("key"),
                        envelopes.cloud_event(envelopes.PAGE, F.col("event_id"), data).alias("value"))


def poison_events(triaged: DataFrame, error: Column | None = None) -> DataFrame:
    """Side-output events for rows with an ``error_type``: original text, batch, page and context."""
    data = F.struct(F.col("value").alias("original_event"), "error_type", (error if error is not None else F.col("error_type")).alias("error"),
                    F.struct("batch_id", "page_index").alias("details"), "batch_id", "page_index")
    metadata = F.struct(F.lit("layer1_extractor").alias("source"), F.col("error_type").alias("error"))
    return triaged.filter("error_type IS NOT NULL").select(
        F.lit(envelopes.TOPIC_DLQ).alias("topic"), F.col("error_type").alias("key"),
        envelopes.cloud_event(envelopes.POISON, envelopes.event_id(F.col("value"), prefix="dlq_"), data, metadata=metadata).alias("value"))
