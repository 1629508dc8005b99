"""Rounding and French number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round halves towards +infinity, so that every engine gives the same double."""
    power = float(10**digits)
    return F.floor(value.cast("double") * F.lit(power) + F.lit(0.5)) / F.lit(power)


def percent_gap(value: Column, reference: Column) -> Column:
    """Relative gap to the reference in percent, one decimal."""
    return F.floor((value / reference - F.lit(1.0)) * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)


def scaled(value: Column, digits: int = 4) -> Column:
    """Fixed-point integer of a decimal: percentiles over integers interpolate exactly."""
    return (value * F.lit(10**digits)).cast("bigint")


def unscaled(value: Column, digits: int, scale: int = 4) -> Column:
    """Fixed-point (possibly interpolated) value back to a number with ``digits`` decimals."""
    return F.floor(value / F.lit(float(10 ** (scale - digits))) + F.lit(0.5)) / F.lit(
        float(10**digits)
    )


def decimal_comma(value: Column) -> Column:
    """Plain number with a decimal comma, empty when missing (export)."""
    text = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.coalesce(F.replace(text, F.lit("."), F.lit(",")), F.lit(""))


def format_number_fr(value: Column, digits: int = 2) -> Column:
    """1234.5 -> '1 234,50' with the narrow no-break space French uses; a dash when missing."""
    text = F.translate(F.format_number(value, digits), ",.", " ,")
    return F.coalesce(text, F.lit("—"))


def format_euro(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("—")).otherwise(
        F.concat(format_number_fr(value, 2), F.lit(" €"))
    )


def format_percent(value: Column, digits: int = 0) -> Column:
    return F.when(value.isNull(), F.lit("—")).otherwise(
        F.concat(format_number_fr(value * 100, digits), F.lit(" %"))
    )


def format_date_fr(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "dd/MM/yyyy"), F.lit("—"))
