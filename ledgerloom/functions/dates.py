"""Date helpers and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days from invoice date to expected credit, and the stand-in for a missing invoice date.
SETTLEMENT_LAG_DAYS = 2
DEFAULT_INVOICE_DATE = "2026-08-01"

# Display formats and the mark for a missing date.
DATE_FORMAT = "dd MMM yyyy"
DATETIME_FORMAT = "dd MMM, HH:mm:ss"
NO_DATE = "—"


def expected_bank_date(document_date: Column) -> Column:
    return F.date_add(F.coalesce(document_date, F.to_date(F.lit(DEFAULT_INVOICE_DATE))), SETTLEMENT_LAG_DAYS)


def midnight_epoch(day: Column) -> Column:
    """Seconds at midnight UTC of a date, independent of the session time zone."""
    return F.unix_date(day).cast("bigint") * 86400


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, DATE_FORMAT), F.lit(NO_DATE))


def format_datetime(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, DATETIME_FORMAT), F.lit(NO_DATE))
