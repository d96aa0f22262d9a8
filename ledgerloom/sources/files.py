"""File feeds: settlement and statement JSON, page manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.pages import page_number

SETTLEMENT_SCHEMA = (
    "payout_id string, fund_account_id string, amount_paise bigint, currency string, status string, utr string, "
    "reference_id string, narration string, fees_paise bigint, tax_paise bigint, mode string, purpose string, "
    "vendor_code string, event_created_at_epoch bigint")
BANK_SCHEMA = (
    "transaction_date date, narration string, utr_number string, transaction_type string, amount_paise bigint, "
    "closing_balance_paise bigint, vendor_code string")


# Why a feed row can't be used as it is.
MALFORMED, WRONG_TYPE = "MALFORMED", "WRONG_TYPE"


def read_elements(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(raw, source_file): the text of each element of a feed, none lost.

    A line holds one JSON object, or an array of them; ``whole`` takes a file as one text, for arrays that go over lines.
    Such a file is read by one task, so keep it small; lines are split over tasks whatever the size of the file. Text that
    is no JSON is an element of its own.
    """
    lines = spark.read.text(path, wholetext=whole).select(
        "value", F.col("_metadata.file_path").alias("source_file")).filter("length(trim(value)) > 0")
    parsed = lines.withColumn("v", F.explode(F.array(F.try_parse_json("value"))))
    listed = F.schema_of_variant("v").startswith("ARRAY")
    elements = F.expr("transform(try_variant_get(v, '$', 'array<variant>'), x -> to_json(x))")
    return parsed.select(F.explode(F.when(listed, elements).otherwise(F.array("value"))).alias("raw"), "source_file")


def parse_feed(elements: DataFrame, schema: str) -> DataFrame:
    """The elements' columns by ``schema`` with ``raw``, ``source_file`` and ``problem``, which is NULL for a usable row."""
    typed = elements.withColumn("e", F.from_json("raw", schema + ", corrupt string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    problem = F.when(~is_object, MALFORMED).when(F.col("e.corrupt").isNotNull(), WRONG_TYPE)
    return typed.withColumn("problem", problem).select("e.*", "raw", "source_file", "problem").drop("corrupt")


def read_settlements(spark: SparkSession, path: str) -> DataFrame:
    """A settlement feed; rows that can't be used are kept, with ``problem``."""
    return parse_feed(read_elements(spark, path), SETTLEMENT_SCHEMA)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A statement feed, as :func:`read_settlements`."""
    return parse_feed(read_elements(spark, path), BANK_SCHEMA)


def read_feed_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feed files that each hold one JSON array; a bad element is kept with ``problem``, the others aren't touched by it."""
    return parse_feed(read_elements(spark, path, whole=True), schema)


def quarantine(rows: DataFrame, path: str) -> None:
    """Append the rejected rows of a feed, as they came, to the quarantine table under ``path``."""
    rows.filter("problem IS NOT NULL").select("source_file", "raw", "problem").write.mode("append").parquet(path)


def write_feed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def page_manifest(spark: SparkSession, root: str, pattern: str = "page_*.jpg") -> DataFrame:
    """(batch_id, page_index, file_path, file_size) of page files in ``root/<batch_id>/``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1).alias("batch_id"), page_number(F.col("path")).alias("page_index"),
                        F.col("path").alias("file_path"), F.col("length").alias("file_size")).orderBy("batch_id", "page_index")
