"""Site fees: lump-sum items weighed against the total of their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up, scaled, unscaled


def site_fees(linked: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Amounts and shares per lump-sum item and work type.

    Titles, prices and the lump flag of the line play no part; lines without amount count in n.
    Lines with equal amount and share are counted first, so that the medians of an item with any
    number of lines see each value once per task.
    """
    lump = items.where(F.col("is_lump")).select("item_id")
    rows = (
        linked.where(F.col("validated") & ~F.col("excluded") & (F.col("control") != "ecart"))
        .join(lump, "item_id", "left_semi")
        .join(
            documents.where((F.col("status") != "rejete") & (F.col("document_total") > 0)).select(
                "document_id", "is_extra", "document_total"
            ),
            "document_id",
        )
        .withColumn("_share", F.col("total").cast("double") / F.col("document_total").cast("double"))
        .withColumn("_amount", scaled(F.col("total"), 2))
    )
    keys = ["item_id", "is_extra"]
    counted = rows.groupBy(*keys, "_amount", "_share").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.count("total").alias("_n"),
        F.sum("total").alias("_sum"),
        F.sum("_share").alias("_shares"),
        F.min("document_total").alias("_lo"),
        F.max("document_total").alias("_hi"),
    )
    block = counted.groupBy(*keys).agg(
        F.sum("_lines").alias("n"),
        F.sum("_n").alias("_n"),
        F.sum("_sum").alias("_sum"),
        F.sum("_shares").alias("_shares"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.percentile("_amount", F.lit(0.5), F.col("_lines")).alias("_amount"),
        F.percentile("_share", F.lit(0.5), F.col("_lines")).alias("_median_share"),
    )
    return block.select(
        *keys,
        "n",
        half_up(F.col("_sum").cast("double") / F.col("_n"), 2).alias("amount_mean"),
        unscaled(F.col("_amount"), 2, 2).alias("amount_median"),
        half_up(F.col("_shares") / F.col("_n") * 100.0, 2).alias("share_mean"),
        half_up(F.col("_median_share") * 100.0, 2).alias("share_median"),
        F.col("_lo").cast("double").alias("document_min"),
        F.col("_hi").cast("double").alias("document_max"),
    )


def fee_listing(fees: DataFrame, items: DataFrame) -> DataFrame:
    """All active lump-sum items, normal and extra side by side."""

    def pick(column: str, extra: bool) -> Column:
        return F.max(F.when(F.col("is_extra") == extra, F.col(column)))

    columns = ("n", "amount_median", "share_median")
    pivot = fees.groupBy("item_id").agg(
        *[pick(c, False).alias(f"normal_{c}") for c in columns],
        *[pick(c, True).alias(f"extra_{c}") for c in columns],
        F.max("share_median").alias("top_share"),
    )
    return (
        items.where(F.col("active") & F.col("is_lump"))
        .select("item_id", "code", "label_print")
        .join(pivot, "item_id", "left")
    )


def fee_order() -> list[Column]:
    return [F.col("top_share").desc_nulls_last(), F.col("label_print"), F.col("item_id")]
