"""Streams with redelivery, restarts and late members."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import envelopes
from ledgerloom.operators import exceptions, posting
from ledgerloom.operators.pages import group_pages, invoice_groups, with_page_signals
from ledgerloom.sources import files
from ledgerloom.streaming import jobs, keystore

T0 = dt.datetime(2026, 8, 1)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drop(df, folder, n):
    df.coalesce(1).write.parquet(f"{folder}/in/{n}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def run(stream_df, folder, body):
    stream_df.writeStream.foreachBatch(body).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()


def completed(spark, ids):
    rows = [(f"d{i}", f"INV-{i}", "V", f"u{i}", "p", 100 * i, f"evt_{i}") for i in ids]
    recs = spark.createDataFrame(rows, "document_id string, invoice_number string, vendor_code string, utr_number string,"
                                 " payout_id string, net_settled_amount_paise bigint, idempotency_event_id string")
    return posting.completed_events(recs).select("value")


def test_ledger_stream_twice(spark, folder):
    """Events within a batch and across batches are delivered twice; a broken one becomes a ticket."""
    broken = spark.createDataFrame([('{"id":"evt_x","source":"s","data":{"vendor_code":"V","matched_invoices":["I"],'
                                     '"bank_utr_number":"u","debit_amount":"10.00","credit_amount":"9.00"}}',), ("{nonsense",)], "value string")
    first = completed(spark, [1, 2]).union(completed(spark, [2])).union(broken)
    drop(first, folder, 1)
    run(stream(spark, folder, "value string"), folder, jobs.ledger_sink(f"{folder}/out"))
    drop(first.union(completed(spark, [3])), folder, 2)
    run(stream(spark, folder, "value string"), folder, jobs.ledger_sink(f"{folder}/out"))
    lines = spark.read.parquet(f"{folder}/out/lines")
    assert lines.count() == 6 and lines.filter("entry_type = 'DEBIT'").select("utr_number").distinct().count() == 3
    tickets = {r.exception_reason: r.variance_delta_paise for r in spark.read.parquet(f"{folder}/out/tickets").collect()}
    assert tickets == {"ORPHANED_DEBIT_CREDIT_MISMATCH": 100, "MALFORMED_PAYLOAD": None}
    # An epoch run again after a failure leaves the same tables.
    jobs.ledger_sink(f"{folder}/out")(first.union(completed(spark, [3])), 1)
    assert spark.read.parquet(f"{folder}/out/lines").count() == 6


def test_seal_full_short_and_late(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = spark.createDataFrame([("full", 3), ("short", 3)], "batch_id string, total_invoices bigint")
    schema = "batch_id string, event_time timestamp"

    def deliver(rows, n):
        drop(spark.createDataFrame([(b, T0 + dt.timedelta(seconds=s)) for b, s in rows], schema), folder, n)
        q = jobs.seal_batches(stream(spark, folder, schema), batches).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("batch_id", "outcome", "inputs", "shortfall").collect())

    assert deliver([("full", 1), ("full", 2), ("full", 3), ("short", 1), ("short", 2)], 1) == [("full", "sealed", 3, 0)]
    assert deliver([("full", 100)], 2) == [("full", "late", 1, 0), ("full", "sealed", 3, 0), ("short", "sealed", 2, 1)]


def test_dedupe_stream(spark, folder):
    schema = "event_id string, document_id string, event_time timestamp"
    rows = [("e1", "d1", T0), ("e1", "d1", T0), (None, "d2", T0), ("", "d2", T0), (None, None, T0)]
    drop(spark.createDataFrame(rows, schema), folder, 1)
    drop(spark.createDataFrame(rows, schema), folder, 2)
    q = jobs.dedupe_events(stream(spark, folder, schema)).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.document_id for r in spark.read.parquet(f"{folder}/out").collect()) == ["d1", "d2"]


def test_page_groups(spark):
    pages = [("one", 0, "nothing here"), ("b", 0, "TAX INVOICE Invoice No: INV-7 x"), ("b", 1, "27ABCDE1234F1Z5 rows"),
             ("b", 2, "29ABCDE1234F1Z5 rows"), ("b", 3, "grand total 5 signature"), ("b", 4, "Cover sheet")]
    grouped = group_pages(with_page_signals(spark.createDataFrame(pages, "batch_id string, page_index bigint, text string")))
    assert [r.invoice_index for r in grouped.filter("batch_id = 'b'").orderBy("page_index").collect()] == [0, 0, 1, 1, 2]
    g = {(r.batch_id, r.invoice_index): r for r in invoice_groups(grouped).collect()}
    assert (g["one", 0].confidence, g["one", 0].needs_review) == (1.0, False)
    assert (g["b", 0].invoice_number, g["b", 0].needs_review, g["b", 1].needs_review) == ("INV-7", False, True)


def test_ticket_moves(spark):
    t = spark.createDataFrame([("1", "OPEN"), ("2", "IN_REVIEW"), ("3", "CLOSED")], "ticket_id string, status string")
    m = spark.createDataFrame([("1", "RESOLVED", "me", 5), ("2", "CLOSED", "me", 5), ("3", "OPEN", "me", 5)],
                              "ticket_id string, new_status string, moved_by string, moved_epoch bigint")
    got = {r.ticket_id: (r.status, r.move_result, r.resolved_by) for r in exceptions.move_tickets(t, m).collect()}
    assert got == {"1": ("OPEN", "rejected", None), "2": ("CLOSED", "allowed", "me"), "3": ("CLOSED", "rejected", None)}


def test_file_feeds_and_manifest(spark, folder):
    feed = spark.createDataFrame([("p1", 5, "processed", "V")], "payout_id string, amount_paise bigint, status string, vendor_code string")
    files.write_feed(feed, f"{folder}/feed")
    assert files.read_settlements(spark, f"{folder}/feed").select("payout_id", "amount_paise", "fees_paise").first() == ("p1", 5, None)
    with open(f"{folder}/array.json", "w") as f:
        f.write('[{"utr_number": null, "amount_paise": 7}, {"utr_number": "u", "amount_paise": 8}]')
    assert files.read_feed_array(spark, f"{folder}/array.json", files.BANK_SCHEMA).count() == 2
    with open(f"{folder}/bad.json", "w") as f:
        f.write('[{"utr_number": "a",\n "amount_paise": 7}, {"utr_number": "}{,", "amount_paise": "x"},\n 5, {"amount_paise": 9}]')
    bad = files.read_feed_array(spark, f"{folder}/bad.json", files.BANK_SCHEMA)
    assert [(r.utr_number, r.amount_paise, r.problem) for r in bad.collect()] == [
        ("a", 7, None), ("}{,", None, "WRONG_TYPE"), (None, None, "MALFORMED"), (None, 9, None)]
    files.quarantine(bad, f"{folder}/quarantine")
    assert sorted(r.raw for r in spark.read.parquet(f"{folder}/quarantine").collect()) == ['5', '{"amount_paise":"x","utr_number":"}{,"}']
    with open(f"{folder}/lines.json", "w") as f:
        f.write('{"payout_id": "p", "amount_paise": 1}\n\nnot json\n[{"payout_id": "q"}, {"payout_id": "r"}]\n"text"\n')
    assert sorted((r.payout_id or "", r.problem or "") for r in files.read_settlements(spark, f"{folder}/lines.json").collect()) == [
        ("", "MALFORMED"), ("", "MALFORMED"), ("p", ""), ("q", ""), ("r", "")]
    import os
    os.makedirs(f"{folder}/pages/b1")
    for i in (10, 2, 0):
        with open(f"{folder}/pages/b1/page_{i}.jpg", "wb") as f:
            f.write(b"x" * (i + 1))
    with open(f"{folder}/pages/b1/notes.txt", "w") as f:
        f.write("no page")
    got = files.page_manifest(spark, f"{folder}/pages").collect()
    assert [(r.batch_id, r.page_index, r.file_size) for r in got] == [("b1", 0, 1), ("b1", 2, 3), ("b1", 10, 11)]


def test_malformed_completed_events(spark):
    def event(**data):
        import json
        base = {"vendor_code": "V", "matched_invoices": ["I"], "bank_utr_number": "u", "total_reconciled_amount": "1.00"}
        return (json.dumps({"id": "e", "source": "s", "data": {**base, **data}}),)
    rows = [event(), event(matched_invoices=[]), event(total_reconciled_amount="x"), event(debit_amount="10.00", credit_amount="9.00"),
            event(bank_utr_number=None), event(debit_amount="2.00", credit_amount="2.00")]
    got = [r.error_code for r in posting.parse_completed(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [None, "MALFORMED_PAYLOAD", "INVALID_PAISE_CASTING", "ORPHANED_DEBIT_CREDIT_MISMATCH", "MALFORMED_PAYLOAD", None]
    assert envelopes.SPEC_VERSION == "1.0"


def test_batches_nothing_arrives_for_are_sealed_and_rebuilt(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = spark.createDataFrame([("full", 2, T0), ("silent", 3, T0), ("empty", 4, T0), ("later", 5, T0 + dt.timedelta(days=9))],
                                    "batch_id string, total_invoices bigint, opened timestamp")
    schema = "batch_id string, event_time timestamp"

    def deliver(rows, n):
        drop(spark.createDataFrame([(b, T0 + dt.timedelta(seconds=s)) for b, s in rows], schema), folder, n)
        jobs.seal_batches(stream(spark, folder, schema), batches, opened="opened").writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/out")

    rows = lambda df: sorted(tuple(r) for r in df.select("batch_id", "outcome", "inputs", "shortfall").collect())
    assert rows(deliver([("full", 1), ("full", 2)], 1)) == [("full", "sealed", 2, 0)]
    sealed = deliver([("full", 100)], 2)
    assert rows(sealed) == [("empty", "sealed", 0, 4), ("full", "late", 1, 0), ("full", "sealed", 2, 0), ("silent", "sealed", 0, 3)]
    items = spark.createDataFrame([("silent", i, f"d{i}") for i in range(2)] + [("full", 0, "d9")], "batch_id string, row_number bigint, document_id string")
    invoices = spark.createDataFrame([(f"d{i}", "V", f"I{i}", "VALIDATED") for i in (0, 1, 9)],
                                     "document_id string, vendor_code string, invoice_number string, processing_status string")
    closed = {r.batch_id: (r.inputs, r.shortfall, r.run_status, r.rebuilt) for r in jobs.close_sealed(sealed, items, invoices).collect()}
    assert closed == {"full": (2, 0, "SEALED", False), "silent": (2, 1, "SEALED", True), "empty": (0, 4, "PARTIAL", False)}


def test_torn_epochs_are_not_read_and_are_done_again(spark, folder):
    sink = jobs.ledger_sink(f"{folder}/out")
    sink(completed(spark, [1, 2]), 0)
    lines = "utr_number string, entry_type string"
    # Epoch 1 breaks off after its lines: no manifest row.
    posting.ledger_lines(posting.new_records(posting.parse_completed(completed(spark, [3])), spark.createDataFrame([], "event_id string"))).write.parquet(
        f"{folder}/out/lines/epoch=1")
    shown = lambda: sorted(r.utr_number for r in keystore.read_committed(spark, f"{folder}/out", "lines", lines).filter("entry_type = 'DEBIT'").collect())
    assert shown() == ["u1", "u2"] and spark.read.parquet(f"{folder}/out/lines").count() == 6
    sink(completed(spark, [2, 3, 4]), 1)
    assert shown() == ["u1", "u2", "u3", "u4"]
    sink(completed(spark, [9]), 1)  # delivered again: committed epochs stay as they are
    assert shown() == ["u1", "u2", "u3", "u4"]


def test_files_of_an_epoch_do_not_grow_with_history(spark, folder):
    store, opened = keystore.KeyStore(spark, folder, buckets=4, fan_in=2), []
    for epoch in range(12):
        ids = spark.createDataFrame([(f"k{epoch}-{i}",) for i in range(20)], "event_id string")
        store.commit(epoch, ids)
        store = keystore.KeyStore(spark, folder, buckets=4, fan_in=2)  # as after a restart
        assert store.epoch == epoch
        opened.append(len(store.touched(spark.createDataFrame([("k0-0",)], "event_id string"))))
        assert max(sum(s.level == level for s in store.segments) for level in range(5)) <= 4
    assert max(opened) <= 4  # one bucket, at most one run a level
    asked = spark.createDataFrame([("k0-0",), ("k11-19",), ("k5-7",), ("new",), ("k12-0",)], "event_id string")
    assert sorted(r[0] for r in store.seen(asked).collect()) == ["k0-0", "k11-19", "k5-7"]
    assert store.spark.read.parquet(f"{folder}/manifest").count() == keystore.SLOTS


def test_kpis_go_on_over_batches_and_are_dropped_at_last(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "batch_id string, utr_number string, net_settled_amount_paise bigint, event_time timestamp"

    def deliver(rows, n):
        drop(spark.createDataFrame([(b, u, p, T0 + dt.timedelta(days=d)) for b, u, p, d in rows], schema), folder, n)
        jobs.live_kpis(stream(spark, folder, schema)).writeStream.outputMode("update").foreachBatch(
            lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")).option(
            "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.parquet(f"{folder}/out")
        newest = seen.groupBy("batch_id").agg(F.max_by(F.struct("total", "settled", "cleared_paise"), "epoch").alias("s"))
        return {r.batch_id: tuple(r.s) for r in newest.collect()}

    assert deliver([("b", "u1", 5, 0), ("b", None, None, 1)], 1) == {"b": (2, 1, 5)}
    assert deliver([("b", "u2", 7, 2)], 2) == {"b": (3, 2, 12)}
    assert deliver([("c", "u3", 1, 60)], 3)["c"] == (1, 1, 1)  # the watermark passes the life of b
    assert deliver([("b", "u4", 9, 61)], 4)["b"] == (1, 1, 9)


def test_batches_of_one_bucket_share_state_and_keep_their_own_dates(spark, folder):
    """State rows follow the buckets, not the batches; each batch is sealed, late, forgotten and summed as if it were alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = spark.range(3000).selectExpr("concat('b', id) AS batch_id", "2L AS total_invoices", "timestamp_seconds(1785542400 + id % 7) AS opened")
    events = batches.selectExpr("batch_id", "cast(substr(batch_id, 2) AS bigint) AS i").selectExpr(
        "batch_id", "explode(array_repeat(0, cast(i % 3 AS int)))", "timestamp_seconds(1785542400 + i % 3) AS event_time").select("batch_id", "event_time")
    schema, rows = "batch_id string, event_time timestamp", []

    def deliver(df, n):
        drop(df, folder, n)
        q = jobs.seal_batches(stream(spark, folder, schema), batches, opened="opened", buckets=2).writeStream.format("parquet").option(
            "path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        rows.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
        got = spark.read.parquet(f"{folder}/out").groupBy("outcome", "inputs", "shortfall").count().collect()
        return {tuple(r)[:3]: r[3] for r in got}

    assert deliver(events, 1) == {("sealed", 2, 0): 1000}
    end = spark.createDataFrame([("b2", T0 + dt.timedelta(seconds=100)), ("b5", T0 + dt.timedelta(seconds=100))], schema)
    assert deliver(end, 2) == {("sealed", 2, 0): 1000, ("late", 1, 0): 2, ("sealed", 1, 1): 1000, ("sealed", 0, 2): 1000}
    paid = events.selectExpr("batch_id", "'u' AS utr_number", "5L AS net_settled_amount_paise", "event_time")
    drop(paid, f"{folder}/k", 1)
    q = jobs.live_kpis(stream(spark, f"{folder}/k", paid.schema), buckets=2).writeStream.outputMode("update").foreachBatch(
        lambda df, epoch: df.write.mode("append").parquet(f"{folder}/kpis")).option("checkpointLocation", f"{folder}/k/cp").trigger(
        availableNow=True).start()
    q.awaitTermination()
    rows.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
    got = spark.read.parquet(f"{folder}/kpis").groupBy("total", "settled", "cleared_paise").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 5, 1000), (2, 2, 10, 1000)]
    assert max(rows) <= 12  # value, timer and its index of two buckets, not of 3,000 batches


def test_page_sink_hands_on_in_files(spark, tmp_path):
    """Parsed events are in files of the newest epoch, not in cached partitions that one task reads whole."""
    from ledgerloom.sources.events import page_events
    from ledgerloom.streaming.keystore import read_committed

    root = str(tmp_path)
    batches = spark.createDataFrame([("b", "V")], "batch_id string, vendor_code string")
    items = spark.createDataFrame([("b", 1)], "batch_id string, row_number bigint")
    manifest = spark.createDataFrame([("/p", True)], "file_path string, readable boolean")
    sink = jobs.page_sink(root, batches, items, manifest)
    for epoch, pages in enumerate(([0, 1], [0, 2, 3])):
        events = page_events(spark.createDataFrame(
            [("b", "V", "scan", p, "/p" if p != 3 else "/none", 1, "b", f"evt_outbox_{p}") for p in pages],
            "batch_id string, vendor_code string, source_type string, page_index bigint, file_path string, file_size bigint,"
            " partition_key string, event_id string")).select("value")
        sink(events.union(events).union(spark.createDataFrame([("{broken",)], "value string")), epoch)
        assert spark.read.parquet(f"{root}/staged/opened").count() == 2 * len(pages) + 1
    done = read_committed(spark, root, "pages", "batch_id string, page_index bigint")
    assert sorted(r.page_index for r in done.collect()) == [0, 2]
    assert [r.epoch for r in read_committed(spark, root, "poison", "value string").collect()] == [1]
    assert read_committed(spark, root, "quarantine", "value string").count() == 2
    assert spark.read.parquet(f"{root}/staged/judged").count() == 2
