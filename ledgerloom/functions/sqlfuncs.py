"""The scalar functions as SQL functions, for users who write SQL.

Temporary SQL functions are inlined by the optimizer, so they cost no more than the column form.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.functions import text

def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def definitions() -> dict[str, str]:
    return {
        "ll_rupees_to_paise(s STRING) RETURNS BIGINT":
            r"CASE WHEN s RLIKE r'\A[0-9]+(\.[0-9]{1,2})?\z' THEN try_add(try_multiply("
            r"try_cast(substring_index(s, '.', 1) AS BIGINT), 100L), "
            r"try_cast(rpad(regexp_extract(s, r'\.([0-9]{1,2})\z', 1), 2, '0') AS BIGINT)) END",
        "ll_paise_to_rupees(p BIGINT) RETURNS STRING":
            "CASE WHEN p >= 0 THEN concat(p div 100, '.', lpad(p % 100, 2, '0')) END",
        "ll_tokenize(s STRING) RETURNS ARRAY<STRING>":
            "filter(split(lower(s), '[^a-z0-9]+'), t -> t <> '')",
        "ll_source_tokens(s STRING) RETURNS ARRAY<STRING>":
            f"filter(split(lower(s), '[^a-z0-9]+'), t -> t <> '' AND t NOT IN ({_words(text.CORPORATE_NOISE)}))",
        "ll_narration_tokens(s STRING) RETURNS ARRAY<STRING>":
            "filter(split(lower(s), '[^a-z0-9]+'), t -> t <> '' AND t NOT IN "
            f"({_words(text.CORPORATE_NOISE + text.BANK_NOISE)}) AND NOT t RLIKE r'\\A[0-9]+\\z')",
        "ll_soundex(w STRING) RETURNS STRING": f"CASE WHEN w = '' THEN '' ELSE {text.soundex_sql('w')} END",
        "ll_nysiis(w STRING) RETURNS STRING": text.nysiis_sql("w"),
        "ll_token_set_match(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS STRUCT<score: DOUBLE, phonetic: BOOLEAN>":
            text.token_set_sql("a", "b"),
        "ll_edit_within(a STRING, b STRING, n INT) RETURNS BOOLEAN": "levenshtein(a, b) <= n",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    names = []
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(", 1)[0])
    return names
