"""Streams over the given tables, run until their input is used up, and what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import envelopes
from ledgerloom.operators import posting, reads, reports
from ledgerloom.plans.registry import query
from ledgerloom.session import STREAMING_CONF, checkpoint_dir
from ledgerloom.sources.events import extracted_events, open_envelopes, page_events
from ledgerloom.sources.fixtures import Fixtures
from ledgerloom.streaming import jobs
from ledgerloom.streaming.keystore import read_committed


class StreamFixtures(Fixtures):
    """The same derived tables, with the named source tables read as file streams."""

    def __init__(self, fx: Fixtures, *streamed: str):
        super().__init__(fx.spark, fx.sf_dir)
        self.streamed = streamed

    def table(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().table(name)
        schema = super().table(name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


def _folder(fx) -> str:
    for key, value in STREAMING_CONF.items():
        fx.spark.conf.set(key, value)
    return f"{checkpoint_dir(fx.spark)}/streams-{uuid.uuid4().hex}"


def _to_table(fx, stream: DataFrame) -> DataFrame:
    root = _folder(fx)
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(
        availableNow=True).start().awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(f"{root}/out")


def _through(fx, stream: DataFrame, body) -> str:
    root = _folder(fx)
    stream.writeStream.foreachBatch(body(f"{root}/out")).option("checkpointLocation", f"{root}/cp").trigger(
        availableNow=True).start().awaitTermination()
    return f"{root}/out"


@query("i1_dedupe_stream", sql="SELECT event_id, user_id::varchar AS batch_id FROM events")
def _(fx):
    e = StreamFixtures(fx, "events").table("events").selectExpr(
        "cast(event_id AS string) AS event_id", "cast(NULL AS string) AS document_id", "cast(user_id AS string) AS batch_id",
        "cast(ts AS timestamp) AS event_time")
    twice = e.withColumn("copy", F.explode(F.when(F.col("event_id").cast("long") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return _to_table(fx, jobs.dedupe_events(twice, "60 days")).select(F.col("event_id").cast("long"), "batch_id")


@query("i2_fan_in_seal", needs=["items", "batches"], sql="""
e AS (SELECT batch_id, count(*) AS n FROM items JOIN batches USING (batch_id) WHERE custkey % 4 <> 0 AND k % 10 <> 0 GROUP BY 1),
b AS (SELECT batch_id, total_invoices AS total, custkey, coalesce(n, 0) AS n FROM batches LEFT JOIN e USING (batch_id)),
f AS (SELECT batch_id, count(*) AS found FROM items JOIN inv USING (document_id) GROUP BY 1),
g AS (SELECT b.*, CASE WHEN n > 0 THEN n ELSE coalesce(found, 0) END AS inputs FROM b LEFT JOIN f USING (batch_id))
SELECT batch_id, inputs, greatest(total - inputs, 0) AS shortfall, CASE WHEN inputs > 0 THEN 'SEALED' ELSE 'PARTIAL' END AS run_status,
  n = 0 AND inputs > 0 AS rebuilt FROM g""")
def _(fx):
    """Members of batches arrive, but for every tenth one and for all of every fourth vendor; those are taken from the tables."""
    items = StreamFixtures(fx, "orders").invoices().withColumn("batch_id", fx._batch_id())
    last = F.timestamp_seconds(F.lit(4_000_000_000))  # the clock goes on after the last event, so that every grace ends
    arrives = F.array(F.when(F.expr("custkey % 4 <> 0 AND k % 10 <> 0"), F.col("batch_id")),
                      F.when(F.col("k") == fx.invoices().agg(F.max("k")).first()[0], F.lit("clock")))
    events = items.select("k", F.explode(F.array_compact(arrives)).alias("batch_id")).select(
        "batch_id", F.when(F.col("batch_id") == "clock", last).otherwise(F.timestamp_seconds(F.col("k") * 60)).alias("event_time"))
    batches = fx.batches().select("batch_id", "total_invoices", F.timestamp_seconds(F.lit(0)).alias("opened"))
    clock = fx.spark.createDataFrame([("clock", 10)], "batch_id string, total_invoices bigint").withColumn("opened", F.lit(None).cast("timestamp"))
    sealed = _to_table(fx, jobs.seal_batches(events, batches.unionByName(clock), opened="opened"))
    return jobs.close_sealed(sealed, fx.items(), fx.invoices())


@query("i3_single_runs", sql="""
SELECT 'single_' || event_id AS run_id, 'SINGLE' AS run_type FROM events WHERE user_id % 5 = 0""")
def _(fx):
    e = StreamFixtures(fx, "events").table("events").selectExpr(
        "cast(event_id AS string) AS document_id", "CASE WHEN user_id % 5 <> 0 THEN cast(user_id AS string) END AS batch_id")
    return _to_table(fx, jobs.single_runs(e)).select("run_id", "run_type")


@query("i4_a6_ledger_stream", needs=["recs"], sql="""
SELECT sha256(idempotency_event_id) AS batch_id, t.entry_type, net_settled_amount_paise AS amount_paise, utr_number FROM recs,
  (VALUES ('DEBIT'), ('CREDIT')) t(entry_type) WHERE utr_number IS NOT NULL""")
def _(fx):
    recs = StreamFixtures(fx, "orders").reconciliations()
    events = posting.completed_events(recs).withColumn("value", F.explode(F.array("value", "value")))
    out = _through(fx, events, jobs.ledger_sink)
    return read_committed(fx.spark, out, "lines", "batch_id string, entry_type string, amount_paise bigint, utr_number string").drop("epoch")


@query("i5_a7_ticket_stream", needs=["inv"], sql="""
SELECT vendor_code, invoice_number AS flagged, 'NO_MATCH' AS exception_reason FROM inv""")
def _(fx):
    from ledgerloom.operators.exceptions import exception_events
    reviews = StreamFixtures(fx, "orders").invoices().selectExpr(
        "vendor_code", "document_id", "invoice_number", "cast(NULL AS string) AS utr", "'NO_MATCH' AS review_reason",
        "cast(NULL AS string) AS variance", "cast(NULL AS string) AS message")
    events = exception_events(reviews).withColumn("value", F.explode(F.array("value", "value")))
    out = _through(fx, events, jobs.ticket_sink)
    return read_committed(fx.spark, out, "tickets", "vendor_code string, flagged_invoice_ids array<string>, exception_reason string").select(
        "vendor_code", F.array_join("flagged_invoice_ids", ",").alias("flagged"), "exception_reason")


@query("i6_a4_poison_stream", needs=["batches", "items"], sql="""
SELECT batch_id, count(*) AS failed FROM items WHERE k % 13 = 0 GROUP BY 1""")
def _(fx):
    orders = StreamFixtures(fx, "orders")
    pages = fx.items().select("k", "row_number")
    events = orders.invoices().withColumn("batch_id", fx._batch_id()).join(pages, "k").selectExpr(
        "batch_id", "row_number AS page_index", "vendor_code", "k", "CASE WHEN k % 13 = 0 THEN 'VEND_OTHER' ELSE vendor_code END AS claimed",
        "to_json(named_struct('k', k)) AS value")
    twice = events.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))

    def triage(rows: DataFrame) -> DataFrame:
        return rows.withColumn("error_type", F.when(F.col("claimed") != F.col("vendor_code"), "tenant_mismatch"))

    out = _through(fx, twice, lambda root: jobs.triage_sink(root, triage))
    return jobs.failed_pages(fx.spark.read.parquet(f"{out}/poison"))


@query("i7_a5_quarantine", sql="""
SELECT event_id % 4 = 0 AS malformed, count(*) AS n FROM events GROUP BY 1""")
def _(fx):
    e = StreamFixtures(fx, "events").table("events").selectExpr(
        "CASE WHEN event_id % 4 = 0 THEN concat('{broken', event_id) ELSE to_json(named_struct('id', cast(event_id AS string), 'type',"
        " 'invoice.extracted', 'data', named_struct('document_id', cast(event_id AS string)))) END AS value")
    return _to_table(fx, open_envelopes(e, envelopes.EXTRACTED_SCHEMA).select("malformed")).groupBy("malformed").agg(F.count(F.lit(1)).alias("n"))


@query("i6_i7_a4_a5_b12_b13_page_flow", needs=["items"], sql="""
t AS (SELECT k, row_number AS page_index, CASE WHEN k % 11 = 0 AND k % 10 <> 0 THEN 'no-' || batch_id ELSE batch_id END AS batch_id,
  CASE WHEN k % 29 = 0 THEN 'malformed' WHEN k % 23 = 0 THEN 'ignored' WHEN k % 10 = 0 THEN 'skipped' WHEN k % 11 = 0 THEN 'batch_not_found'
    WHEN k % 13 = 0 THEN 'tenant_mismatch' WHEN k % 17 = 0 THEN 'file_not_found' WHEN k % 19 = 0 THEN 'image_decode_failed' ELSE 'process' END AS outcome FROM items)
SELECT outcome, batch_id, page_index FROM t WHERE outcome NOT IN ('malformed', 'ignored', 'skipped')
UNION ALL SELECT outcome, CASE WHEN outcome = 'ignored' THEN batch_id END, NULL FROM t, range(2) WHERE outcome IN ('malformed', 'ignored')""")
def _(fx):
    """Page events, each delivered twice: some texts are broken, some of another type, some fail a check."""
    orders, items = StreamFixtures(fx, "orders"), fx.items()
    pages = orders.invoices().withColumn("own_batch", fx._batch_id()).join(items.select("k", "row_number"), "k").selectExpr(
        "k", "CASE WHEN k % 11 = 0 AND k % 10 <> 0 THEN concat('no-', own_batch) ELSE own_batch END AS batch_id",
        "CASE WHEN k % 13 = 0 THEN 'VEND_OTHER' ELSE vendor_code END AS vendor_code", "'scan' AS source_type", "row_number AS page_index",
        "concat('/pages/', k) AS file_path", "k AS file_size", "concat(own_batch, ':', row_number) AS partition_key",
        "CASE WHEN k % 3 <> 0 THEN concat('evt_outbox_', k) END AS event_id")
    events = page_events(pages).withColumn("k", F.get_json_object("value", "$.data.file_size").cast("bigint")).selectExpr(
        "CASE WHEN k % 29 = 0 THEN concat('{broken', k) WHEN k % 23 = 0 THEN replace(value, 'batch.page.ingestion', 'batch.other') ELSE value END AS value")
    manifest = fx.invoices().filter("k % 17 <> 0").selectExpr("concat('/pages/', k) AS file_path", "k % 19 <> 0 AS readable")
    out = _through(fx, events.withColumn("value", F.explode(F.array("value", "value"))),
                   lambda root: jobs.page_sink(root, fx.batches(), items.filter("k % 10 = 0"), manifest))

    def read(name, schema):
        return read_committed(fx.spark, out, name, schema)

    part = lambda path: F.get_json_object("value", path)
    none = F.lit(None).cast("bigint").alias("page_index")
    return (read("pages", "batch_id string, page_index bigint").select(F.lit("process").alias("outcome"), "batch_id", "page_index")
            .unionByName(read("poison", "value string").select(part("$.data.error_type").alias("outcome"), part("$.data.batch_id").alias("batch_id"),
                                                               part("$.data.page_index").cast("bigint").alias("page_index")))
            .unionByName(read("quarantine", "value string").select(F.lit("malformed").alias("outcome"), F.lit(None).cast("string").alias("batch_id"), none))
            .unionByName(read("other", "value string, route string").select(F.col("route").alias("outcome"), part("$.data.batch_id").alias("batch_id"), none)))


@query("i8_live_log_sessions", sql="""
t AS (SELECT user_id::varchar AS batch_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY batch_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS g FROM t)
SELECT batch_id, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(max(ts)) + 7200000000 AS expires_us FROM s GROUP BY batch_id, g""")
def _(fx):
    """The sessions as a stream writes them once they are over; a clock goes on after the last event, so that all are."""
    last = fx.table("events").agg(F.max("event_id")).first()[0]
    own = F.struct(F.col("user_id").cast("string").alias("batch_id"), F.col("ts").cast("timestamp").alias("ts"))
    clock = F.struct(F.lit("clock").alias("batch_id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"))
    e = StreamFixtures(fx, "events").table("events").select(F.explode(F.array_compact(F.array(
        own, F.when(F.col("event_id") == last, clock)))).alias("e")).select("e.*")
    fx.spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return _to_table(fx, jobs.live_log(e)).filter("batch_id <> 'clock'").select("batch_id", "events", F.unix_micros("first_ts").alias("first_us"),
                                   F.unix_micros("last_ts").alias("last_us"), F.unix_micros("expires").alias("expires_us"))


@query("i9_run_lifecycle", sql="""
t AS (SELECT user_id::varchar AS batch_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'claim' WHEN event_type IN ('click', 'view') THEN 'start' ELSE 'close' END AS kind,
  CASE WHEN event_type = 'error' THEN 'PARTIAL' ELSE 'COMPLETED' END AS result FROM events),
c AS (SELECT batch_id, min(seq) AS claimed_seq FROM t WHERE kind = 'claim' GROUP BY 1),
d AS (SELECT batch_id, min(seq) AS closed_seq, arg_min(result, seq) AS result FROM t JOIN c USING (batch_id) WHERE kind = 'close' AND seq >= claimed_seq GROUP BY 1),
x AS (SELECT * FROM c LEFT JOIN d USING (batch_id)),
y AS (SELECT batch_id, max(seq) AS started_seq FROM t JOIN x USING (batch_id)
  WHERE kind = 'start' AND seq >= claimed_seq AND (closed_seq IS NULL OR seq < closed_seq) GROUP BY 1)
SELECT batch_id, claimed_seq, started_seq, closed_seq, coalesce(result, CASE WHEN started_seq IS NOT NULL THEN 'RUNNING' ELSE 'SEALED' END) AS status
FROM x LEFT JOIN y USING (batch_id)""")
def _(fx):
    log = fx.table("events").selectExpr(
        "cast(user_id AS string) AS batch_id", "event_id AS seq",
        "CASE WHEN event_type = 'signup' THEN 'claim' WHEN event_type IN ('click', 'view') THEN 'start' ELSE 'close' END AS kind",
        "CASE WHEN event_type = 'error' THEN 'PARTIAL' ELSE 'COMPLETED' END AS result")
    return jobs.run_lifecycle(log)


@query("i10_live_kpis", needs=["items", "recs"], sql="""
SELECT batch_id, count(*) AS total, count(utr_number) AS settled, coalesce(sum(net_settled_amount_paise), 0)::bigint AS cleared_paise
FROM items LEFT JOIN recs USING (k) GROUP BY 1""")
def _(fx):
    orders = StreamFixtures(fx, "orders")
    recs = fx.reconciliations().select("k", "utr_number", "net_settled_amount_paise")
    stream = orders.invoices().withColumn("batch_id", fx._batch_id()).join(recs, "k", "left").withColumn(
        "event_time", F.col("document_date").cast("timestamp"))

    def keep(root):
        return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")

    root = _folder(fx)
    jobs.live_kpis(stream).writeStream.outputMode("update").foreachBatch(keep(f"{root}/out")).option(
        "checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    seen = fx.spark.read.parquet(f"{root}/out")
    return seen.groupBy("batch_id").agg(F.max_by(F.struct("total", "settled", "cleared_paise"), "epoch").alias("s")).select("batch_id", "s.*")


@query("a10_extracted_events", needs=["items", "inv"], sql="""
SELECT 'invoice.extracted.events' AS topic, i.vendor_code AS key, '{"specversion":"1.0","type":"invoice.extracted","source":"/layer1/ingestion","id":"evt_' ||
  sha256(i.document_id) || '","time":null,"data":{"document_id":"' || i.document_id || '","vendor_code":"' || i.vendor_code || '","invoice_number":"' || i.invoice_number ||
  '","processing_status":"' || processing_status || '","batch_id":"' || batch_id || '","extracted_invoice":null}}' AS value
FROM items i JOIN inv ON inv.document_id = i.document_id""")
def _(fx):
    rows = fx.items().filter("document_id IS NOT NULL").select("document_id", "batch_id").join(fx.invoices(), "document_id").withColumn(
        "extracted_invoice", F.lit(None).cast("string"))
    return extracted_events(rows)
