"""Point series, quantity threshold and trend lines of every item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up, scaled, unscaled

MIN_SIDE = 4
DROP = 0.95


def point_series(base: DataFrame, zones: DataFrame) -> DataFrame:
    """Dated price points of each item with their zone."""
    return base.join(zones.select("zone_id", "zone_code"), "zone_id", "left").select(
        "item_id",
        "line_id",
        "document_id",
        F.col("document_date").cast("string").alias("date"),
        F.col("quantity").cast("double").alias("quantity"),
        F.col("unit_price").cast("double").alias("price"),
        F.col("price_indexed").cast("double").alias("price_indexed"),
        "is_extra",
        "zone_code",
    )


def _best(candidates: DataFrame) -> DataFrame:
    """Largest drop, then smallest threshold, per item."""
    kept = candidates.where(
        (F.col("n_below") >= MIN_SIDE)
        & (F.col("n_above") >= MIN_SIDE)
        & (F.col("below") > F.col("above"))
        & (F.col("above") < F.col("below") * DROP)
    )
    choice = F.struct(
        (F.col("below") - F.col("above")).alias("drop"),
        (-F.col("threshold")).alias("smallest"),
        "threshold", "below", "above", "n_below", "n_above",
    )
    return (
        kept.groupBy("item_id")
        .agg(F.max(choice).alias("b"))
        .select(
            "item_id",
            F.col("b.threshold").cast("double").alias("threshold"),
            unscaled(F.col("b.below"), 2).alias("median_below"),
            unscaled(F.col("b.above"), 2).alias("median_above"),
            F.col("b.n_below").cast("bigint").alias("n_below"),
            F.col("b.n_above").cast("bigint").alias("n_above"),
        )
    )


def quantity_threshold(points: DataFrame, indexed: bool = False) -> DataFrame:
    """Quantity from which an item's median price drops by more than 5 percent.

    Each distinct quantity of an item is a candidate cut. Equal points of an item are counted
    first; the distinct ones meet the item's cuts, and the medians of both sides weigh the counts.
    """
    price = scaled(F.col("price_indexed" if indexed else "unit_price"))
    counted = (
        points.select("item_id", "quantity", price.alias("_p"))
        .groupBy("item_id", "quantity", "_p")
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    keys = ["item_id", "threshold", "n_below", "n_above"]
    lower = F.when(F.col("quantity") < F.col("threshold"), F.col("_p"))
    upper = F.when(F.col("quantity") >= F.col("threshold"), F.col("_p"))
    medians = (
        counted.join(_cuts(counted), "item_id")
        .groupBy(*keys)
        .agg(
            F.percentile(lower, F.lit(0.5), F.col("_w")).alias("below"),
            F.percentile(upper, F.lit(0.5), F.col("_w")).alias("above"),
        )
    )
    return _best(medians)


def _cuts(counted: DataFrame) -> DataFrame:
    """Distinct quantities of each item with at least four points on both sides."""
    per_quantity = counted.groupBy("item_id", "quantity").agg(F.sum("_w").alias("c"))
    item = Window.partitionBy("item_id")
    until = item.orderBy("quantity").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_quantity.withColumn("n_below", F.sum("c").over(until) - F.col("c"))
        .withColumn("n_above", F.sum("c").over(item) - F.col("n_below"))
        .where((F.col("n_below") >= MIN_SIDE) & (F.col("n_above") >= MIN_SIDE))
        .select("item_id", F.col("quantity").alias("threshold"), "n_below", "n_above")
    )


def trend_lines(points: DataFrame, x: str, indexed: bool = False) -> DataFrame:
    """Least-squares line of each item with its two end points; at least three distinct points.

    ``x`` is 'date' (days) or 'quantity'.
    """
    abscissa = F.unix_date("document_date") if x == "date" else F.col("quantity")
    price = F.col("price_indexed" if indexed else "unit_price").cast("double")
    rows = points.select("item_id", abscissa.cast("double").alias("x"), price.alias("y")).where(
        F.col("x").isNotNull()
    )
    fit = rows.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.min("x").alias("x_first"),
        F.max("x").alias("x_last"),
    )
    return fit.where((F.col("n") >= 3) & (F.col("x_first") < F.col("x_last"))).select(
        "item_id",
        "n",
        "x_first",
        half_up(F.col("intercept") + F.col("slope") * F.col("x_first"), 2).alias("y_first"),
        "x_last",
        half_up(F.col("intercept") + F.col("slope") * F.col("x_last"), 2).alias("y_last"),
    )
