"""Arithmetic controls of extracted lines and documents, and one-off repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up
from pricebase.functions.text import is_administrative

TOLERANCE_ABS = 0.02
TOLERANCE_REL = 0.005


def close_to(value: Column, printed: Column) -> Column:
    tolerance = F.greatest(F.lit(TOLERANCE_ABS), F.abs(printed) * F.lit(TOLERANCE_REL))
    return F.abs(value - printed) <= tolerance


def line_controls(lines: DataFrame) -> DataFrame:
    """Adds control and gap: quantity x price against the printed line total."""
    expected = F.col("quantity").cast("double") * F.col("unit_price").cast("double")
    printed = F.col("total").cast("double")
    unverifiable = F.col("is_title") | (expected + printed).isNull()
    right = close_to(expected, printed)
    return lines.withColumn(
        "control", F.when(unverifiable, "non_verifiable").when(right, "ok").otherwise("ecart")
    ).withColumn(
        "gap",
        F.when(unverifiable, F.lit(None).cast("double"))
        .when(right, F.lit(0.0))
        .otherwise(half_up(printed - expected, 2)),
    )


def document_controls(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Sum of the lines against the printed total, VAT check, review status per document.

    ``documents`` carries document_id, type, total, vat and total_vat; the VAT check is reported
    but does not change the status.
    """
    sums = lines.groupBy("document_id").agg(
        F.sum(F.when(~F.col("is_title"), F.col("total"))).alias("_sum"),
        F.count_if(F.col("control") == "ecart").alias("_errors"),
        F.count(F.lit(1)).alias("_lines"),
        F.avg("confidence").alias("_confidence"),
    )
    summed = F.coalesce(F.col("_sum").cast("double"), F.lit(0.0))
    printed = F.col("total").cast("double")
    control = (
        F.when(printed.isNull(), "non_verifiable")
        .when(close_to(summed, printed), "ok")
        .otherwise("ecart")
    )
    gross = printed * (F.lit(1.0) + F.col("vat").cast("double") / 100.0)
    gross_printed = F.col("total_vat").cast("double")
    vat_control = (
        F.when((gross + gross_printed).isNull(), "non_verifiable")
        .when(close_to(gross, gross_printed), "ok")
        .otherwise("ecart")
    )
    errors = F.coalesce("_errors", F.lit(0))
    return (
        documents.join(sums, "document_id", "left")
        .withColumn("control_total", control)
        .select(
            "document_id",
            "control_total",
            half_up(summed - printed, 2).alias("gap_total"),
            vat_control.alias("control_vat"),
            errors.alias("lines_in_error"),
            F.coalesce("_lines", F.lit(0)).alias("n_lines"),
            half_up(F.col("_confidence"), 4).alias("mean_confidence"),
            F.when(
                (F.col("control_total") == "ok") & (errors == 0) & (F.col("type") != "indetermine"),
                "valide",
            )
            .otherwise("a_revoir")
            .alias("review_status"),
        )
    )


def repaired_lines(lines: DataFrame) -> DataFrame:
    """Idempotent repairs: several 'ens' are pieces; a priced, worded line is not off scope."""
    contested = (
        F.col("off_scope")
        & (F.col("off_scope_reason") == "llm")
        & (F.col("unit_price") > 0)
        & (F.col("quantity") > 0)
        & ~is_administrative(F.col("search_text"))
    )
    pieces = (F.col("unit") == "ens") & (F.col("quantity") > 1)
    fixed = F.coalesce(contested, F.lit(False))
    return lines.withColumns(
        {
            "unit": F.when(pieces, "u").otherwise(F.col("unit")),
            "off_scope": F.col("off_scope") & ~fixed,
            "off_scope_reason": F.when(fixed, "llm-conteste").otherwise(F.col("off_scope_reason")),
        }
    )


def backfilled_units(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lines whose unit was unknown take it from a spelling learned since, with their quantity.

    Spellings are compared trimmed and without case (of several, the first in order); units already
    known and the quantities that go with them are left alone.
    """
    learned = aliases.groupBy(F.lower("alias").alias("_spelling")).agg(
        F.min(F.struct("alias", "code", "factor")).alias("_m")
    )
    unknown = F.col("unit").isNull() & F.col("_m.code").isNotNull()
    quantity = half_up(F.col("quantity").cast("double") * F.col("_m.factor").cast("double"), 3)
    return (
        lines.withColumn("_spelling", F.lower(F.trim("unit_raw")))
        .join(learned, "_spelling", "left")
        .withColumns(
            {
                "quantity_norm": F.when(unknown, quantity.cast("decimal(14,3)")).otherwise(F.col("quantity_norm")),
                "unit": F.when(unknown, F.col("_m.code")).otherwise(F.col("unit")),
            }
        )
        .select(*lines.columns)
    )


def dated_documents(documents: DataFrame) -> DataFrame:
    """Documents dated before the provenance existed got their date from the document."""
    missing = F.col("document_date").isNotNull() & F.col("date_source").isNull()
    return documents.withColumn(
        "date_source", F.when(missing, "document").otherwise(F.col("date_source"))
    )


def off_scope_guard(lines: DataFrame) -> DataFrame:
    """Of the lines proposed as off scope, only those not plainly priced work are accepted."""
    plain_work = (
        F.coalesce(F.col("unit_price") > 0, F.lit(False))
        & F.coalesce(F.col("quantity") > 0, F.lit(False))
        & ~is_administrative(F.col("search_text"))
    )
    return lines.withColumn("accepted", ~plain_work)
