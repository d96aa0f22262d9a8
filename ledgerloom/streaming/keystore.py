"""Processed keys of a sink, and which of its epochs are committed.

Under a sink's folder:

    keys/run=<name>/bucket=<b>   keys of one epoch, or of several merged ones, by hash bucket
    manifest/slot=<s>            one row: the last committed epoch and all segments (run, bucket) in force

An epoch looks its keys up only in the buckets they fall into. Runs are merged ``fan_in`` at a time into the next level, so
that a bucket has at most ``fan_in`` runs of each level and the files an epoch opens grow with the logarithm of the number of
epochs, not with it. The manifest row is written last and commits the epoch with all its output folders; its slots are
overwritten in turn, so that a torn write leaves the row before it in force. Epochs come one after the other, so the last
one tells all that are committed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, FAN_IN, SLOTS = 64, 8, 4

_MANIFEST = "epoch bigint, segments array<struct<run:string,level:int,bucket:int>>, dropped array<string>"


@dataclass(frozen=True)
class Segment:
    run: str
    level: int
    bucket: int


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The files under ``paths``; a folder nothing was written to yet is empty."""
    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_committed(spark: SparkSession, root: str) -> int:
    """The last committed epoch under ``root``, -1 for none."""
    row = _read(spark, [f"{root}/manifest"], _MANIFEST).agg(F.max("epoch")).first()
    return -1 if row[0] is None else row[0]


def read_committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of the output ``name`` of all committed epochs; what a broken epoch left behind isn't shown."""
    rows = _read(spark, [f"{root}/{name}"], schema + ", epoch bigint")
    return rows.filter(F.col("epoch") <= last_committed(spark, root))


class KeyStore:
    """The keys under one sink's ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan_in: int = FAN_IN):
        self.spark, self.root, self.buckets, self.fan_in = spark, root, buckets, fan_in
        newest = _read(spark, [f"{root}/manifest"], _MANIFEST).orderBy(F.desc("epoch")).limit(1).collect()  # a row a slot
        self.epoch = newest[0]["epoch"] if newest else -1
        self.segments = [Segment(*s) for s in newest[0]["segments"]] if newest else []
        self._dropped: list[str] = list(newest[0]["dropped"]) if newest else []

    def is_committed(self, epoch: int) -> bool:
        return epoch <= self.epoch

    def _bucket(self, key: str = "event_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _path(self, segment: Segment) -> str:
        return f"{self.root}/keys/run={segment.run}/bucket={segment.bucket}"

    def touched(self, keys: DataFrame) -> list[Segment]:
        """The segments that may hold some of ``keys`` (event_id)."""
        hit = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # at most one for each bucket
        return [s for s in self.segments if s.bucket in hit]

    def seen(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (event_id) that a committed epoch processed."""
        touched = self.touched(keys)
        if not touched:
            return self.spark.createDataFrame([], "event_id string")
        known = self.spark.read.schema("event_id string").parquet(*[self._path(s) for s in touched])
        return keys.select("event_id").distinct().join(known, "event_id", "left_semi")

    def _write_run(self, keys: DataFrame, run: str, level: int) -> list[Segment]:
        rows = keys.select("event_id", self._bucket().alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "event_id").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.root}/keys/run={run}")
        written = _read(self.spark, [f"{self.root}/keys/run={run}"], "event_id string, bucket int")
        return [Segment(run, level, r[0]) for r in written.select("bucket").distinct().collect()]

    def commit(self, epoch: int, keys: DataFrame) -> None:
        """Add the keys (event_id) of ``epoch`` and commit it."""
        segments = self.segments + self._write_run(keys.filter("event_id IS NOT NULL").distinct(), f"e{epoch}", 0)
        dropped: list[str] = []
        level = 0
        while True:
            runs = sorted({s.run for s in segments if s.level == level})
            if len(runs) < self.fan_in:
                break
            old = [s for s in segments if s.level == level]
            merged = self.spark.read.schema("event_id string").parquet(*[self._path(s) for s in old])
            segments = [s for s in segments if s.level != level] + self._write_run(merged, f"m{epoch}-{level + 1}", level + 1)
            dropped += runs
            level += 1
        row = (epoch, [(s.run, s.level, s.bucket) for s in segments], dropped)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/slot={epoch % SLOTS}")
        self._delete(self._dropped)
        self.epoch, self.segments, self._dropped = epoch, segments, dropped

    def _delete(self, runs: list[str]) -> None:
        """Runs that were merged an epoch ago; nothing in force names them."""
        for run in runs:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/keys/run={run}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
