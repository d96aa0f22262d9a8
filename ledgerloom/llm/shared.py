"""Small helpers of the operators: intermediate tables in the shared folder, row keys, checked broadcasts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_ROWS = 2000  # rows of a batch for Python, which are whole texts
SMALL_ROWS = 200_000  # rows of a few fixed-size columns that may be broadcast


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the file: short lineage, and no work done twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int, bound: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint where ``rows`` is within the bound; beyond it the join is shuffled and AQE splits hot keys."""
    return F.broadcast(df) if rows <= bound else df


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def seen_by_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where it lies, and get texts in batches of bounded rows."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark
