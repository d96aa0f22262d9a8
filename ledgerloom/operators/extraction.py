"""From the extracted JSON of a document to invoice and batch-item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import checks


def extract_documents(raw: DataFrame, text_column: str = "raw_text") -> DataFrame:
    """Parsed, checked and flattened documents with status, checksum_errors and schema_errors."""
    kept = [c for c in raw.columns if c != text_column]
    parsed = checks.with_document(raw, text_column)
    judged = parsed.select(*kept, "doc", F.explode(F.array(F.struct(
        checks.checksum_errors(F.col("doc")).alias("checksum_errors"),
        checks.schema_errors(F.col("doc")).alias("schema_errors")))).alias("found"))
    status = checks.extraction_status(F.col("found.checksum_errors"), F.col("found.schema_errors"))
    return judged.select(*kept, status.alias("status"), "found.*", *checks.flatten_document(F.col("doc")))
