"""Streaming jobs. They call the batch operators; state is small per key and bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions import envelopes
from ledgerloom.operators import exceptions, ingest, posting
from ledgerloom.scale import first_per_key
from ledgerloom.sources.events import open_envelopes, poison_events, split_malformed
from ledgerloom.streaming.keystore import KeyStore

# Grace for late members of a batch, life of the live log after its last event, age of a stale run.
GRACE_SECONDS = 30
FORGET_SECONDS = 7 * 86400  # how long late members of a sealed batch are still known as late
LIVE_LOG = "2 hours"
STATE_BUCKETS = 512  # of the state of batches; fixed for the life of a checkpoint


def dedupe_events(events: DataFrame, watermark: str = "2 hours", key: str = "event_id", fallback: str = "document_id",
                  time: str = "event_time") -> DataFrame:
    """First delivery of each event id; events without any id are dropped. Ids are forgotten past the watermark."""
    keyed = events.withColumn("__id", F.coalesce(F.nullif(F.col(key), F.lit("")), F.nullif(F.col(fallback), F.lit(""))))
    return keyed.filter("__id IS NOT NULL").withWatermark(time, watermark).dropDuplicatesWithinWatermark(["__id"]).drop("__id")


def single_runs(events: DataFrame) -> DataFrame:
    """Events without a batch become one-item runs at once."""
    return events.filter("batch_id IS NULL").withColumn("run_id", F.concat(F.lit("single_"), "document_id")).withColumn(
        "run_type", F.lit("SINGLE"))


def partial_counts(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events per batch within an Arrow chunk, so that a very large batch crosses the shuffle as few rows."""
    for chunk in chunks:
        if len(chunk):
            yield chunk.groupby("batch_id", as_index=False).agg(n=("batch_id", "size"), total=("total", "max"),
                                                                event_time=("event_time", "max"))


class BucketProcessor(StatefulProcessor):
    """State of batches, kept by hash bucket: one value holds the numbers of all batches of a bucket, and one timer its next date.

    Rows, state and dates of a bucket are handled as columns, so that a call to the state store serves many batches. ``due``
    is the time at which something happens to a batch, in ms.
    """

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batches", ", ".join(["batch_id array<string>", *[f"{c} array<bigint>" for c in self.columns]]))

    def load(self) -> pd.DataFrame:
        kept = self.state.get() or [[] for _ in range(len(self.columns) + 1)]
        return pd.DataFrame({c: pd.Series(list(v), dtype="int64") for c, v in zip(self.columns, kept[1:])}).set_axis(list(kept[0]))

    def save(self, now: pd.DataFrame) -> None:
        """Keep ``now``; the bucket's timer is its first date."""
        if len(now):
            self.state.update((now.index.tolist(), *[now[c].tolist() for c in self.columns]))
            self.handle.registerTimer(int(now["due"].min()))
        else:
            self.state.clear()

    def stop_timer(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])

    @staticmethod
    def fold(chunks: Iterator[pd.DataFrame], **how: str) -> pd.DataFrame:
        """The rows of a bucket by batch; ``last_ms`` is the time of the last one."""
        total = None
        for chunk in chunks:
            chunk = chunk.assign(last_ms=chunk["event_time"].astype("datetime64[ms]").astype("int64"))[["batch_id", "last_ms", *how]]
            total = (chunk if total is None else pd.concat([total.reset_index(), chunk])).groupby("batch_id").agg({**how, "last_ms": "max"})
        return total

    def close(self) -> None:
        pass


def by_bucket(rows: DataFrame, buckets: int):
    return rows.withColumn("bucket", F.pmod(F.xxhash64("batch_id"), F.lit(buckets)).cast("int")).groupBy("bucket")


class SealProcessor(BucketProcessor):
    """Counts the members of a batch; seals it when all are there or when the grace after the last one is over.

    State per batch is (seen, total, sealed, due), whatever the number of members. Batches known at the start come as initial
    state with a date of their own, so that one nothing arrives for is sealed too. Members after the seal are
    reported as late and don't reopen the batch; ``forget_ms`` after it the state is dropped.
    """

    columns = ("seen", "total", "sealed", "due")
    grace_ms = GRACE_SECONDS * 1000
    forget_ms = FORGET_SECONDS * 1000

    @staticmethod
    def outcome(rows: pd.DataFrame, name: str, inputs: str, shortfall) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": rows.index, "outcome": name, "inputs": rows[inputs].to_numpy(), "shortfall": shortfall})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        opened = initialState["opened"].astype("datetime64[ms]").astype("int64")
        known = pd.DataFrame({"seen": 0, "total": initialState["total"].to_numpy(), "sealed": 0, "due": opened.to_numpy() + self.grace_ms},
                             index=initialState["batch_id"].tolist())
        known = known[~known.index.duplicated()]
        now = self.load()
        self.stop_timer()
        self.save(pd.concat([now.drop(known.index, errors="ignore"), known]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh, now = self.fold(rows, n="sum", total="max"), self.load()
        old = now.reindex(fresh.index, fill_value=0)
        late = old["sealed"] == 1
        if late.any():
            yield self.outcome(fresh[late], "late", "n", 0)
        fresh, old = fresh[~late], old[~late]
        changed = pd.DataFrame({"seen": old["seen"] + fresh["n"], "total": old["total"].clip(lower=fresh["total"])})
        changed["sealed"] = (changed["seen"] >= changed["total"]).astype("int64")
        changed["due"] = fresh["last_ms"] + self.grace_ms + (self.forget_ms - self.grace_ms) * changed["sealed"]
        self.stop_timer()
        self.save(pd.concat([now.drop(changed.index, errors="ignore"), changed]))
        full = changed[changed["sealed"] == 1]
        if len(full):
            yield self.outcome(full, "sealed", "seen", 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.load()
        over = now["due"] <= timerValues.getCurrentWatermarkInMs()
        ended = now[over & (now["sealed"] == 0)]
        sealed = ended.assign(sealed=1, due=ended["due"] + self.forget_ms)
        self.save(pd.concat([now[~over], sealed]))
        yield self.outcome(sealed, "sealed", "seen", (sealed["total"] - sealed["seen"]).clip(lower=0).to_numpy())


def seal_batches(events: DataFrame, batches: DataFrame, watermark: str = "0 seconds", opened: str | None = None,
                 buckets: int = STATE_BUCKETS) -> DataFrame:
    """Seal and late rows (batch_id, outcome, inputs, shortfall) for deduplicated events of known batches.

    ``events``: batch_id, event_time. ``batches``: batch_id, total_invoices; a static table. With ``opened``, its column of
    the time a batch was completed at, batches that the stream starts with are sealed after the grace even if nothing
    arrives for them: their inputs are 0, and :func:`close_sealed` takes them from the tables.
    """
    joined = events.join(batches.select("batch_id", F.col("total_invoices").alias("total")), "batch_id").select(
        "batch_id", "total", "event_time")
    counted = joined.mapInPandas(partial_counts, "batch_id string, n bigint, total bigint, event_time timestamp")
    known = None
    if opened:
        known = by_bucket(batches.select("batch_id", F.col("total_invoices").alias("total"), F.col(opened).alias("opened")).filter(
            "opened IS NOT NULL"), buckets)
    return by_bucket(counted.withWatermark("event_time", watermark), buckets).transformWithStateInPandas(
        SealProcessor(), "batch_id string, outcome string, inputs bigint, shortfall bigint", "append", "eventTime", known)


def rebuild_inputs(sealed: DataFrame, items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Inputs of sealed batches nothing arrived for, from the stored tables."""
    from ledgerloom.operators.reads import batch_run_list
    lost = sealed.filter("outcome = 'sealed' AND inputs = 0").select("batch_id")
    return batch_run_list(items, invoices).join(lost, "batch_id", "left_semi")


def close_sealed(sealed: DataFrame, items: DataFrame, invoices: DataFrame) -> DataFrame:
    """How each sealed batch goes on: batch_id, inputs, shortfall, run_status, rebuilt.

    A batch nothing arrived for runs on what the tables hold; if that is nothing either, it is closed as PARTIAL with its
    whole number as shortfall.
    """
    found = rebuild_inputs(sealed, items, invoices).groupBy("batch_id").agg(F.count(F.lit(1)).alias("found"))
    total = F.col("inputs") + F.col("shortfall")
    inputs = F.when(F.col("inputs") > 0, F.col("inputs")).otherwise(F.coalesce("found", F.lit(0)))
    return sealed.filter("outcome = 'sealed'").join(found, "batch_id", "left").select(
        "batch_id", inputs.alias("inputs"), F.greatest(total - inputs, F.lit(0)).alias("shortfall"),
        F.when(inputs > 0, "SEALED").otherwise("PARTIAL").alias("run_status"), ((F.col("inputs") == 0) & (inputs > 0)).alias("rebuilt"))


def _write(df: DataFrame, path: str, epoch: int) -> None:
    """One folder per epoch, overwritten when the epoch is run again after a failure."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _staged(df: DataFrame, path: str) -> DataFrame:
    """Write what an epoch reads more than once to files, in place of those of the epoch before, and go on from them.

    A cached partition is read whole by one task, however large its rows are; files are read in splits of bounded size, and of
    them only the columns that are used.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ledger_sink(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for completed events: headers, lines, tickets and fatal events under ``root``.

    Keys of earlier epochs are looked up in a :class:`KeyStore`, whose manifest commits the epoch after all its folders
    are written; readers go through ``read_committed``. A committed epoch that is delivered again is left alone, a
    broken one overwrites its own folders.
    """
    def run(events: DataFrame, epoch: int) -> None:
        store = KeyStore(events.sparkSession, root)
        if store.is_committed(epoch):
            return
        parsed = posting.parse_completed(events.select("value")).persist()
        keys = store.seen(parsed.filter("event_id IS NOT NULL").select("event_id")).persist()
        records = posting.new_records(parsed, keys).persist()
        _write(posting.ledger_headers(records), f"{root}/headers", epoch)
        _write(posting.ledger_lines(records), f"{root}/lines", epoch)
        _write(exceptions.new_tickets(exceptions.tickets_from_fatal(parsed), keys), f"{root}/tickets", epoch)
        _write(posting.fatal_events(parsed), f"{root}/fatal", epoch)
        fatal = parsed.filter("error_code IS NOT NULL AND event_id IS NOT NULL").select("event_id").join(keys, "event_id", "left_anti")
        store.commit(epoch, records.select("event_id").unionByName(fatal))
        for df in (records, keys, parsed):
            df.unpersist()
    return run


def ticket_sink(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for dead-letter events: one ticket per event id, committed as in :func:`ledger_sink`."""
    def run(events: DataFrame, epoch: int) -> None:
        store = KeyStore(events.sparkSession, root)
        if store.is_committed(epoch):
            return
        read = exceptions.tickets_from_dlq(events).persist()
        keys = store.seen(read.select(F.col("source_event_id").alias("event_id")).filter("event_id IS NOT NULL")).persist()
        tickets = exceptions.new_tickets(read, keys).persist()
        _write(tickets, f"{root}/tickets", epoch)
        store.commit(epoch, tickets.select(F.col("source_event_id").alias("event_id")))
        for df in (tickets, keys, read):
            df.unpersist()
    return run


def triage_sink(root: str, triage: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for page events: good rows one way, poison rows to the side output."""
    def run(events: DataFrame, epoch: int) -> None:
        judged = triage(events).persist()
        _write(judged.filter("error_type IS NULL").drop("error_type"), f"{root}/pages", epoch)
        _write(poison_events(judged), f"{root}/poison", epoch)
        judged.unpersist()
    return run


def page_sink(root: str, batches: DataFrame, items: DataFrame, manifest: DataFrame) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body for the page topic, one parse for all: pages to extract, poison events, quarantine, other events.

    Texts that are no envelope go to the quarantine as they came, events of other types are passed on with their route. A page
    event that was handled before, in this epoch or an earlier one, isn't judged again; one without an id is known by its batch
    and page. ``batches``, ``items`` and ``manifest`` are tables, read as they are when the epoch runs.
    """
    def run(events: DataFrame, epoch: int) -> None:
        store = KeyStore(events.sparkSession, root)
        if store.is_committed(epoch):
            return
        opened = _staged(open_envelopes(events.select("value"), envelopes.PAGE_SCHEMA), f"{root}/staged/opened")
        good, broken = split_malformed(opened)
        own = F.coalesce(F.nullif(F.col("e.id"), F.lit("")), F.concat_ws(":", "e.data.batch_id", F.col("e.data.page_index").cast("string")))
        routed = ingest.route_events(good.select("value", own.alias("event_id"), F.col("e.type").alias("type"), "e.data.*"))
        pages = routed.filter("route = 'page'").drop("route")
        seen = store.seen(pages.select("event_id")).persist()
        fresh = first_per_key(pages, ["event_id"], [F.asc("value")]).join(seen, "event_id", "left_anti")
        judged = _staged(ingest.triage_pages(fresh, batches, items, manifest), f"{root}/staged/judged")
        _write(judged.filter("outcome = 'process'").drop("outcome", "value"), f"{root}/pages", epoch)
        poison = judged.filter("outcome NOT IN ('process', 'skipped')").withColumn("error_type", F.col("outcome"))
        _write(poison_events(poison), f"{root}/poison", epoch)
        _write(broken.select("value"), f"{root}/quarantine", epoch)
        _write(routed.filter("route <> 'page'").select("value", "type", "route"), f"{root}/other", epoch)
        store.commit(epoch, judged.select("event_id"))
        seen.unpersist()
    return run


def failed_pages(poison: DataFrame) -> DataFrame:
    """Failed count per batch over distinct (batch, page), so a redelivered poison event counts once."""
    body = poison.select(F.get_json_object("value", "$.data.batch_id").alias("batch_id"),
                         F.get_json_object("value", "$.data.page_index").alias("page_index"))
    return body.distinct().groupBy("batch_id").agg(F.count(F.lit(1)).alias("failed"))


def live_log(events: DataFrame, watermark: str = LIVE_LOG) -> DataFrame:
    """Log sessions per batch: a session ends two hours after its last event. Works on streams and tables."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return source.groupBy("batch_id", F.session_window("ts", LIVE_LOG).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(
        "batch_id", "events", "first_ts", "last_ts", F.col("w.end").alias("expires"))


def partial_kpis(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per batch within an Arrow chunk, so that a very large batch crosses the shuffle as few rows."""
    for chunk in chunks:
        if len(chunk):
            yield chunk.assign(settled=chunk["utr_number"].notna().astype("int64"), paise=chunk["net_settled_amount_paise"].fillna(0).astype("int64")).groupby(
                "batch_id", as_index=False).agg(total=("settled", "size"), settled=("settled", "sum"), cleared_paise=("paise", "sum"),
                                                event_time=("event_time", "max"))


class KpiProcessor(BucketProcessor):
    """Running counts and money of a batch. The numbers are dropped ``forget_ms`` after the batch's last outcome."""

    columns = ("total", "settled", "cleared_paise", "due")
    forget_ms = FORGET_SECONDS * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh, now = self.fold(rows, total="sum", settled="sum", cleared_paise="sum"), self.load()
        old = now.reindex(fresh.index, fill_value=0)
        changed = pd.DataFrame({c: old[c] + fresh[c] for c in self.columns[:3]})
        changed["due"] = old["due"].clip(lower=fresh["last_ms"] + self.forget_ms)
        self.stop_timer()
        self.save(pd.concat([now.drop(changed.index, errors="ignore"), changed]))
        yield changed.drop(columns="due").rename_axis("batch_id").reset_index()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.load()
        self.save(now[now["due"] > timerValues.getCurrentWatermarkInMs()])
        yield pd.DataFrame({"batch_id": [], "total": [], "settled": [], "cleared_paise": []}).astype({
            "batch_id": "str", "total": "int64", "settled": "int64", "cleared_paise": "int64"})


def live_kpis(outcomes: DataFrame, watermark: str = "30 days", buckets: int = STATE_BUCKETS) -> DataFrame:
    """Running counts and money per batch, for update mode: a row for each batch that something came for.

    ``outcomes``: batch_id, utr_number, net_settled_amount_paise, event_time. State is a few numbers a batch; it is dropped a
    week after the batch's last outcome, once the watermark has passed that.
    """
    schema = "batch_id string, total bigint, settled bigint, cleared_paise bigint"
    parts = outcomes.select("batch_id", "utr_number", "net_settled_amount_paise", "event_time").mapInPandas(
        partial_kpis, schema + ", event_time timestamp")
    return by_bucket(parts.withWatermark("event_time", watermark), buckets).transformWithStateInPandas(
        KpiProcessor(), schema, "update", "eventTime")


def run_lifecycle(transitions: DataFrame) -> DataFrame:
    """State of each run from its transition log (batch_id, kind, seq, result): an order-independent fold.

    Only the first claim counts. A start counts after the claim and before the close, the last one sets
    started_seq. The first close after the claim is final.
    """
    claims = transitions.filter("kind = 'claim'").groupBy("batch_id").agg(F.min("seq").alias("claimed_seq"))
    later = transitions.join(claims, "batch_id").filter(F.col("seq") >= F.col("claimed_seq"))
    closes = F.when(F.col("kind") == "close", F.struct("seq", "result"))
    closed = later.groupBy("batch_id").agg(F.min(closes).alias("close"))
    starts = later.join(closed, "batch_id").filter(
        (F.col("kind") == "start") & (F.col("close").isNull() | (F.col("seq") < F.col("close.seq")))).groupBy("batch_id").agg(
        F.max("seq").alias("started_seq"))
    return claims.join(closed, "batch_id").join(starts, "batch_id", "left").select(
        "batch_id", "claimed_seq", "started_seq", F.col("close.seq").alias("closed_seq"),
        F.coalesce("close.result", F.when(F.col("started_seq").isNotNull(), "RUNNING").otherwise("SEALED")).alias("status"))
