"""Gross-to-net waterfall of an invoice and the check of its tax deduction rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import paise_to_rupees, rupees_to_paise

# Statutory deduction rate per section, in hundredths of a percent.
SECTION_RATES = {
    "194C": 200, "194J": 1000, "194I": 1000, "194H": 1000, "194A": 1000,
    "194B": 3000, "194D": 2000, "194DA": 2000, "194E": 3000, "194G": 500,
}
# A rate is suspicious above this share of the gross, or above 5/4 of the section's rate.
RATE_CAP = 2000
RATE_SLACK = (5, 4)

# Outcomes.
CALCULATED = "WATERFALL_CALCULATED"
NEGATIVE_NET = "NEGATIVE_NET_SETTLEMENT"
BAD_AMOUNT = "INVALID_PAISE_CASTING"
RATE_ANOMALY = "TDS_RATE_ANOMALY"


def rate_anomaly(tds_paise: Column, gross_paise: Column, section: Column) -> Column:
    """Compared as integer cross-products, so no division rounds the rate. An unknown section only has the cap."""
    wide = "decimal(24,0)"
    tds, gross = tds_paise.cast(wide), gross_paise.cast(wide)
    table = F.create_map(*[F.lit(x) for pair in SECTION_RATES.items() for x in pair])
    rate = F.try_element_at(table, F.upper(section)).cast("decimal(6,0)")
    num, den = RATE_SLACK
    above_cap = tds * 10000 > gross * RATE_CAP
    above_section = F.coalesce(tds * (10000 * den) > gross * rate * num, F.lit(False))
    return (gross_paise > 0) & (above_cap | above_section)


def waterfall(gross_rupees: Column, tds_rupees: Column, fees_paise: Column, fee_tax_paise: Column,
              section: Column) -> Column:
    """``struct(status, net_rupees, net_paise, tds_rupees, gateway_rupees, flags)``."""
    gross, tds = rupees_to_paise(gross_rupees), rupees_to_paise(tds_rupees)
    gateway = fees_paise + fee_tax_paise
    net = gross - tds - gateway
    status = (F.when(gross.isNull() | tds.isNull(), BAD_AMOUNT).when(net < 0, NEGATIVE_NET).otherwise(CALCULATED))
    done = status == CALCULATED
    return F.struct(
        status.alias("status"),
        F.when(done, paise_to_rupees(net)).alias("net_rupees"),
        F.when(done, net).alias("net_paise"),
        F.when(done, paise_to_rupees(tds)).alias("tds_rupees"),
        F.when(done, paise_to_rupees(gateway)).alias("gateway_rupees"),
        F.when(~done, F.array(status)).when(rate_anomaly(tds, gross, section), F.array(F.lit(RATE_ANOMALY)))
        .otherwise(F.array().cast("array<string>")).alias("flags"))


def with_waterfall(df: DataFrame) -> DataFrame:
    """Adds ``waterfall`` from grand_total_rupees, tds_deducted_rupees, gateway fee columns and tds_section."""
    return df.withColumn("waterfall", waterfall(
        F.col("grand_total_rupees"), F.col("tds_deducted_rupees"), F.col("gateway_fees_paise"),
        F.col("gateway_tax_paise"), F.col("tds_section")))
