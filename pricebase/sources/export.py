"""CSV export of the price grid in the French spreadsheet format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.numbers import decimal_comma
from pricebase.sources.dims import UNIT_LABELS

BOM = "﻿"
# Header of the export.
HEADER = (
    "Lot", "Code", "Ouvrage", "Unité", "Prix de référence (HT)", "Prix bas", "Prix haut",
    "Moyenne", "Min", "Max", "n", "Chantiers", "Prix TS", "n TS", "Écart TS (%)", "Fiabilité",
    "Dernier devis",
)


def _quoted(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _plain(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def csv_rows(grid: DataFrame, indexed: bool = False) -> DataFrame:
    """item_id and the finished text line of every grid row."""
    kind = "indexed" if indexed else "price"
    unit = F.lit("")
    for code, label in UNIT_LABELS.items():
        unit = F.when(F.col("item_unit") == code, label).otherwise(unit)

    def number(name: str) -> Column:
        return decimal_comma(F.col(name))

    cells = [
        _quoted(F.col("category_code")),
        _quoted(F.col("code")),
        _quoted(F.col("label_print")),
        _quoted(unit),
        *[number(f"normal_{kind}_{p}") for p in ("median", "p25", "p75", "mean", "min", "max")],
        _plain(F.col("normal_n")),
        _plain(F.col("normal_n_documents")),
        number(f"extra_{kind}_median"),
        _plain(F.col("extra_n")),
        number("extra_gap_percent"),
        _quoted(F.coalesce("normal_reliability", "extra_reliability")),
        _quoted(F.coalesce("normal_last_date", "extra_last_date")),
    ]
    return grid.select("item_id", F.concat_ws(";", *cells).alias("csv_line"))


def header_line() -> str:
    return ";".join(f'"{name}"' for name in HEADER)


def write_csv(
    grid: DataFrame, order: list[Column], path: str, indexed: bool = False, max_rows: int | None = None
) -> None:
    """UTF-8 part files with byte-order mark and header; their names and rows are in sort order.

    All rows are written unless the caller bounds them, as a screen with one download would.
    """
    rows = grid.orderBy(*order)
    if max_rows is not None:
        rows = rows.limit(max_rows)
    lines = csv_rows(rows, indexed).select(F.col("csv_line").alias(BOM + header_line()))
    lines.write.mode("overwrite").options(
        header="true", quote="", sep="\u0001", escapeQuotes="false", lineSep="\n",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)
