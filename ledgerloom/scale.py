"""Building blocks that keep one hot key from landing in one task.

A window partitioned by a tenant alone puts every row of that tenant in one task. The helpers here
split each key into ordered buckets first: totals per bucket are pre-aggregated map-side, only the
small totals table is scanned per key, and rows are windowed inside (key, bucket).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir

_BUCKET = "__bucket"

# Whether the shuffle files of a query are removed when it ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    A ``row_number <= n`` filter is planned with a group limit before the shuffle, so a hot key ships
    at most ``n`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def spread_nulls(key: Column, *row_id: Column) -> Column:
    """A join key equal to ``key`` where it is set and unique per row where it is NULL.

    NULL never equals anything, so those rows cannot match; without this they would all hash to one
    partition. The filler starts with a character no business key contains.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0001"), F.concat_ws("\u0001", *row_id)))


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per key in ``order``; ``bucket`` must not decrease along ``order``."""
    keys = list(keys)
    rows = df.withColumn(_BUCKET, bucket)
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy(*keys, _BUCKET).agg(F.sum(value).alias("__total"))
            .select(*keys, _BUCKET, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base")))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("__part", F.sum(value).over(inside))
            .join(base, keys + [_BUCKET])
            .withColumn(out, (F.col("__base") + F.col("__part")).cast("long"))
            .drop(_BUCKET, "__base", "__part"))


def ordinal(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position per key in ``order`` (the order must be total)."""
    return running_sum(df, keys, bucket, order, F.lit(1), out)


def ordinal_from_end(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                     out: str) -> DataFrame:
    """1-based position per key counted from the last row, plus the forward position in ``out + '_fwd'``."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    return (ordinal(df, keys, bucket, order, out + "_fwd").join(sizes, keys)
            .withColumn(out, F.col("__size") - F.col(out + "_fwd") + 1).drop("__size"))


def previous_value(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                   value: Column, out: str) -> DataFrame:
    """``value`` of the row before, as ``lag`` gives it, carried over bucket borders."""
    keys = list(keys)
    rows = df.withColumn(_BUCKET, bucket).withColumn("__v", F.struct(value.alias("v")))
    last = (rows.groupBy(*keys, _BUCKET)
            .agg(F.max_by("__v", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__last")))
    carry = last.select(*keys, _BUCKET,
                        F.lag("__last").over(Window.partitionBy(*keys).orderBy(_BUCKET)).alias("__carry"))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    return (rows.withColumn("__in", F.lag("__v").over(inside))
            .join(carry, keys + [_BUCKET])
            .withColumn(out, F.coalesce("__in", "__carry")["v"])
            .drop(_BUCKET, "__v", "__in", "__carry"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Used between rounds of an iterative job: the plan stays short, and the data outlives the executors
    that made it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as files of the shared folder and go on from them.

    For loops: a checkpoint hands what the optimizer knows of its columns on to the next round, where it piles up; files
    hold data and sizes alone. Nothing reads the shuffles of the write again, so they go with its end and not when the driver
    happens to collect garbage: of a job of many steps only one step's shuffles are on the disks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)
