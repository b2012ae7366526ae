"""Amounts, tiers and estimates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gmv(raw: Column) -> Column:
    """Monthly sales from text: a text with 5k or 5000 is 5000, or 2500 as the range from 0; with k, thousands; a fraction
    under 100 is thousands too; else the first number. Null without a number."""
    text = F.lower(F.regexp_replace(raw, r"[\s,$]", ""))
    number = F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0)
    value = number.try_cast("double")
    five = F.contains(text, F.lit("5k")) | F.contains(text, F.lit("5000"))
    low = F.startswith(text, F.lit("0")) | F.contains(text, F.lit("0-"))
    return (
        F.when(five & low, 2500.0).when(five, 5000.0)
        .when(text.rlike(r"[0-9]k"), value * 1000)
        .when((value < 100) & F.contains(number, F.lit(".")), value * 1000)
        .otherwise(value)
    )


def gmv_flag(amount: Column) -> Column:
    """high above 5000, mid from 1000, else low."""
    return F.when(amount > 5000, "gmv_high").when(amount >= 1000, "gmv_mid").when(amount.isNotNull(), "gmv_low")


def gmv_tier(amount: Column) -> Column:
    """The first of the ranges, both ends included: A from 5000, B from 1000, else C."""
    return F.when(amount >= 5000, "A").when(amount >= 1000, "B").when(amount.isNotNull(), "C")


def money_text(amount: Column) -> Column:
    """Two decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", amount.cast("double")), r"\.?0+$", "")


def similarity(distance: Column) -> Column:
    """1 / (1 + distance) within 0 and 1, six decimals."""
    return F.when(distance.isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + distance))), 6))


def count_or_null(raw: Column) -> Column:
    """A whole number from text with thousands separators; negatives and anything else are null."""
    value = F.regexp_replace(raw, "[,\\s]", "").try_cast("bigint")
    return F.when(value >= 0, value)
