"""The question the repository exists for: which invoices are settled by which bank credit?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import matching, reads
from ledgerloom.sources.fixtures import Fixtures


def settled_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open invoices with the deterministic verdict on each, sets of any size included."""
    fx = Fixtures(spark, sf_dir)
    pool = fx.open_invoices(named=True).withColumn("net_paise", reads.net_paise())
    credits = reads.unmatched_credits(fx.bank(named=True), fx.reconciliations())
    return matching.fast_path(pool, fx.settlements(named=True), credits).select(
        "document_id", "vendor_code", "invoice_number", "net_paise", "subset_status", "phase",
        F.array_join("matched_invoices", ",").alias("matched_invoices"), "matched_utr", "committable")
