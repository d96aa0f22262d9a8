"""Integer-paise money expressions. Floating point never touches an amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted rupee string. ``\z`` and not ``$``: the latter lets a trailing newline pass.
RUPEE_PATTERN = r"\A[0-9]+(\.[0-9]{1,2})?\z"

# Fixed value: the rupee sign with its separating space.
RUPEE_PREFIX = "₹ "


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rupees_to_paise(rupees: Column | str) -> Column:
    """Strict rupee string to paise; NULL for anything else (sign, comma, three decimals, blanks)."""
    r = _c(rupees)
    whole = F.substring_index(r, ".", 1).try_cast("bigint")
    cents = F.rpad(F.regexp_extract(r, r"\.([0-9]{1,2})\z", 1), 2, "0").try_cast("bigint")
    return F.when(r.rlike(RUPEE_PATTERN), F.try_add(F.try_multiply(whole, F.lit(100)), cents))


def is_rupee_string(rupees: Column | str) -> Column:
    return F.coalesce(_c(rupees).rlike(RUPEE_PATTERN), F.lit(False))


def paise_to_rupees(paise: Column | str) -> Column:
    """Paise to ``whole.cc``; NULL for a negative amount."""
    p = _c(paise).cast("bigint")
    cents = F.pmod(p, F.lit(100))
    return F.when(p >= 0, F.concat(_div100(p).cast("string"), F.lit("."),
                                   F.lpad(cents.cast("string"), 2, "0")))


def _div100(p: Column) -> Column:
    """Whole hundreds of a non-negative long without going through floating point."""
    return F.call_function("div", p, F.lit(100))


def variance_to_paise(value: Column | str) -> Column:
    """Best-effort variance: NULL stays NULL and garbage becomes NULL."""
    return rupees_to_paise(_c(value).cast("string"))


def group_indian(digits: Column) -> Column:
    """Commas the Indian way: the last three digits, then pairs."""
    return F.regexp_replace(digits, r"([0-9])(?=([0-9]{2})+[0-9]\z)", "$1,")


def group_rupees(paise: Column | str) -> Column:
    """``10,48,94,114.00``.

    For a negative amount the whole part is floored and the signed remainder added to it, so -150 shows
    as -2.50; use :func:`format_signed_inr` for deltas.
    """
    p = _c(paise).cast("bigint")
    rest = p % 100
    shown = _div100(p) * 100 + F.when(rest < 0, F.lit(-100)).otherwise(F.lit(0)) + rest
    size = F.abs(shown)
    return F.concat(F.when(shown < 0, F.lit("-")).otherwise(F.lit("")),
                    group_indian(_div100(size).cast("string")), F.lit("."),
                    F.lpad((size % 100).cast("string"), 2, "0"))


def format_inr(paise: Column | str) -> Column:
    return F.concat(F.lit(RUPEE_PREFIX), group_rupees(paise))


def format_signed_inr(paise: Column | str) -> Column:
    p = _c(paise).cast("bigint")
    return F.concat(F.when(p < 0, F.lit("-")).otherwise(F.lit("+")), format_inr(F.abs(p)))
