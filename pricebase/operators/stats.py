"""Price statistics: per item, per level, per zone, per year, with the derived flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up, percent_gap, scaled, unscaled
from pricebase.plans.filters import PriceFilters

QUARTILES = (0.25, 0.5, 0.75)


def counted_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Line counts per key, price and indexed price, and one row without lines per key and document.

    Statistics need no more than that. The shuffle is spread by prices and documents, so it does not
    matter how many lines a key has, and documents are counted without a distinct aggregate.
    """
    price, indexed = scaled(F.col("unit_price")), scaled(F.col("price_indexed"))
    none = F.lit(None)
    reliable = F.col("zone_reliable") if "zone_reliable" in rows.columns else none.cast("boolean")
    line = F.struct(
        none.cast("bigint").alias("_document"), price.alias("_price"), indexed.alias("_indexed"),
        F.lit(1).alias("_one"), F.col("quantity").alias("_quantity"), F.col("document_date").alias("_date"),
        reliable.alias("_reliable"),
    )
    document = F.struct(
        F.col("document_id").cast("bigint").alias("_document"), none.cast("bigint").alias("_price"),
        none.cast("bigint").alias("_indexed"), F.lit(0).alias("_one"),
        none.cast(rows.schema["quantity"].dataType).alias("_quantity"),
        none.cast(rows.schema["document_date"].dataType).alias("_date"), none.cast("boolean").alias("_reliable"),
    )
    return (
        rows.select(*keys, F.inline(F.array(line, document)))
        .groupBy(*keys, "_document", "_price", "_indexed")
        .agg(
            F.sum("_one").alias("_lines"),
            F.sum("_quantity").alias("_quantity"),
            F.min("_date").alias("_first"),
            F.max("_date").alias("_last"),
            F.every("_reliable").alias("_reliable"),
        )
    )


def _figures() -> list[Column]:
    """The raw block out of counted lines; sums are exact decimals."""
    lines, probabilities = F.col("_lines"), F.array(*[F.lit(p) for p in QUARTILES])

    def total(value: str) -> Column:
        return F.sum(F.col(value).cast("decimal(18,0)") * lines)

    priced = F.sum(F.when(F.col("_price").isNotNull(), lines))
    squares = F.sum((F.col("_price").cast("decimal(18,0)") * F.col("_price").cast("decimal(18,0)")).cast("decimal(38,0)") * lines)
    mean = (total("_price").cast("decimal(28,0)") / priced.cast("decimal(18,0)")).cast("decimal(28,6)")
    deviations = squares.cast("double") - (total("_price").cast("decimal(28,0)") * mean).cast("double")
    spread = F.sqrt(F.greatest(deviations, F.lit(0.0)) / (priced - 1)) / 10_000.0
    return [
        F.sum(lines).alias("n"),
        F.count("_document").alias("n_documents"),
        F.min("_price").alias("_min"),
        F.max("_price").alias("_max"),
        (total("_price").cast("double") / 10_000.0).alias("_sum"),
        F.when(priced > 1, spread).alias("_stddev"),
        F.min("_indexed").alias("_min_indexed"),
        F.max("_indexed").alias("_max_indexed"),
        (total("_indexed").cast("double") / 10_000.0).alias("_sum_indexed"),
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
        F.sum("_quantity").alias("_quantity"),
        F.every("_reliable").alias("zone_always_reliable"),
        F.percentile("_price", probabilities, lines).alias("_q"),
        F.percentile("_indexed", probabilities, lines).alias("_qi"),
    ]


def raw_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unrounded statistics per key."""
    return counted_lines(rows, keys).groupBy(*keys).agg(*_figures())


def reliability(n: Column, variation: Column) -> Column:
    return (
        F.when((n >= 10) & (variation < 0.25), "haute").when(n >= 4, "moyenne").otherwise("faible")
    )


def _mean(total: str) -> Column:
    return F.col(total).cast("double") / F.col("n")


def finished_block(block: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded statistics: quartiles from four lines on, variation to three decimals."""
    variation = F.when(_mean("_sum") > 0, half_up(F.col("_stddev") / _mean("_sum"), 3))
    enough = F.col("n") >= 4

    def quartile(column: str, index: int) -> Column:
        return unscaled(F.get(F.col(column), F.lit(index)), 2)

    return block.select(
        *keys,
        "n",
        "n_documents",
        unscaled(F.col("_min"), 2).alias("price_min"),
        unscaled(F.col("_max"), 2).alias("price_max"),
        half_up(_mean("_sum"), 2).alias("price_mean"),
        quartile("_q", 1).alias("price_median"),
        F.when(enough, quartile("_q", 0)).alias("price_p25"),
        F.when(enough, quartile("_q", 2)).alias("price_p75"),
        half_up(F.col("_stddev"), 2).alias("price_stddev"),
        variation.alias("variation"),
        quartile("_qi", 1).alias("indexed_median"),
        half_up(_mean("_sum_indexed"), 2).alias("indexed_mean"),
        unscaled(F.col("_min_indexed"), 2).alias("indexed_min"),
        unscaled(F.col("_max_indexed"), 2).alias("indexed_max"),
        F.when(enough, quartile("_qi", 0)).alias("indexed_p25"),
        F.when(enough, quartile("_qi", 2)).alias("indexed_p75"),
        F.col("first_date").cast("string").alias("first_date"),
        F.col("last_date").cast("string").alias("last_date"),
        F.col("_quantity").cast("double").alias("quantity_total"),
        reliability(F.col("n"), variation).alias("reliability"),
        "zone_always_reliable",
    )


def price_stats(
    base: DataFrame,
    keys: list[str],
    filters: PriceFilters | None = None,
) -> DataFrame:
    """Filtered statistics per key, computed on the fly."""
    chosen = filters or PriceFilters()
    rows = base.where(chosen.row_condition(work_type=True))
    return finished_block(raw_block(rows, keys), keys)


def values(stats: DataFrame, indexed: bool) -> DataFrame:
    """The raw or the indexed figures of a block under common names."""
    prefix = "indexed" if indexed else "price"
    picks = [F.col(f"{prefix}_{p}").alias(p) for p in ("min", "max", "mean", "median", "p25", "p75")]
    return stats.select("*", *picks)


def price_stats_levels(base: DataFrame) -> DataFrame:
    """Three granularities in one pass: per zone, per work type, all together.

    The level comes from the grouping set, never from NULLs: a zone may really be unknown.
    Levels overlap, so readers must pick one (``at_level``). A document has one zone and one work
    type, so that its row at the finest level counts at every level.
    """
    level = (
        F.when(F.grouping("zone_id") == 0, "zone")
        .when(F.grouping("is_extra") == 0, "type")
        .otherwise("global")
    )
    finest = ["item_id", "is_extra", "zone_id"]
    sets = [finest, finest[:2], finest[:1]]
    block = counted_lines(base, finest).groupingSets(sets, *finest).agg(level.alias("level"), *_figures())
    variation = F.col("_stddev") / F.nullif(_mean("_sum"), F.lit(0.0))
    return block.select(
        "item_id",
        "is_extra",
        "zone_id",
        "level",
        "n",
        "n_documents",
        (F.col("_min") / 10000.0).alias("price_min"),
        (F.col("_max") / 10000.0).alias("price_max"),
        half_up(_mean("_sum"), 2).alias("price_mean"),
        *[
            unscaled(F.get("_q", F.lit(i)), 2).alias(f"price_{name}")
            for i, name in ((0, "p25"), (1, "median"), (2, "p75"))
        ],
        half_up(F.col("_stddev"), 2).alias("price_stddev"),
        half_up(variation, 3).alias("variation"),
        unscaled(F.get("_qi", F.lit(1)), 2).alias("indexed_median"),
        half_up(_mean("_sum_indexed"), 2).alias("indexed_mean"),
        F.col("first_date").cast("string").alias("first_date"),
        F.col("last_date").cast("string").alias("last_date"),
        F.col("_quantity").cast("double").alias("quantity_total"),
        "zone_always_reliable",
        # unrounded variation, undefined counts as 1
        reliability(F.col("n"), F.coalesce(variation, F.lit(1.0))).alias("reliability"),
    )


def at_level(levels: DataFrame, level: str) -> DataFrame:
    return levels.where(F.col("level") == level)


def stats_by_zone(
    base: DataFrame,
    zones: DataFrame,
    filters: PriceFilters | None = None,
) -> DataFrame:
    """Every item with every zone, empty ones included, and the gap to the item's own median.

    The reference median ignores the zone filter but keeps the period and work type.
    """
    chosen = filters or PriceFilters()
    rows = base.where(chosen.row_condition(zones=False, work_type=True))
    median = "indexed_median" if chosen.indexed else "price_median"
    per_zone = finished_block(
        raw_block(rows.where(F.col("zone_id").isNotNull()), ["item_id", "zone_id"]),
        ["item_id", "zone_id"],
    ).select("item_id", "zone_id", "n", "n_documents", "reliability", F.col(median).alias("median"))
    overall = finished_block(raw_block(rows, ["item_id"]), ["item_id"]).select(
        "item_id", F.col(median).alias("item_median")
    )
    # the zones are a fixed handful: hang their list on every item and unfold it
    zone_list = zones.agg(
        F.collect_list(F.struct("zone_id", "zone_code", "zone_label", "zone_ord")).alias("z")
    )
    frame = overall.withColumn("_z", F.explode(zone_list.scalar())).select(
        "item_id", "item_median", "_z.*"
    )
    reference = F.col("item_median")
    return frame.join(per_zone, ["item_id", "zone_id"], "left").select(
        "item_id",
        "zone_code",
        "zone_label",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        "median",
        "reliability",
        F.when(reference > 0, percent_gap(F.col("median"), reference)).alias("gap_percent"),
        (F.coalesce("n", F.lit(0)) < 3).alias("insufficient"),
    )


def line_outliers(base: DataFrame, stats: DataFrame, indexed: bool = False) -> DataFrame:
    """Lines further than two standard deviations from their item's median."""
    price = F.col("price_indexed" if indexed else "unit_price").cast("double")
    median = "indexed_median" if indexed else "price_median"
    scale = stats.select(
        "item_id", F.col(median).alias("median"), F.col("price_stddev").alias("stddev")
    )
    return (
        base.join(scale, "item_id")
        .where((F.col("stddev") > 0) & (F.abs(price - F.col("median")) > 2 * F.col("stddev")))
        .select("line_id", "item_id", price.alias("price"), "median", "stddev")
    )


def display_bounds(stats: DataFrame, indexed: bool = False) -> DataFrame:
    """Scale of each block; an extreme maximum is cut at one and a half times the third quartile."""
    v = values(stats, indexed)
    cut = F.col("p25").isNotNull() & (F.col("max") > F.col("p75") * 3)
    return v.select(
        "item_id",
        F.col("min").alias("lower_bound"),
        F.when(cut, F.col("p75") * 1.5).otherwise(F.col("max")).alias("upper_bound"),
        F.coalesce(cut, F.lit(False)).alias("truncated"),
    )


def common_scale(by_type: DataFrame, indexed: bool = False) -> DataFrame:
    """One scale for the normal and the extra-work block of an item."""
    v = values(by_type, indexed)
    return v.groupBy("item_id").agg(
        F.min("min").alias("scale_min"), F.max("max").alias("scale_max")
    )


def deduced_zone_documents(base: DataFrame) -> DataFrame:
    """Number of documents of each item whose zone was deduced rather than printed."""
    deduced = F.when(~F.col("zone_reliable"), F.col("document_id"))
    return base.groupBy("item_id").agg(F.count_distinct(deduced).alias("n_deduced"))


def compare_by_year(base: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Statistics of every item for each of the given years."""
    dated = base.withColumn("year", F.year("document_date")).where(F.col("year").isin(*years))
    keys = ["item_id", "year"]
    return finished_block(raw_block(dated, keys), keys)


def compare_by_work_type(base: DataFrame) -> DataFrame:
    """Normal against extra work on indexed medians, with the gap in percent."""
    by_type = finished_block(raw_block(base, ["item_id", "is_extra"]), ["item_id", "is_extra"])

    def side(extra: bool, column: str) -> Column:
        return F.max(F.when(F.col("is_extra") == extra, F.col(column)))

    normal, extra = F.col("normal_median"), F.col("extra_median")
    return (
        by_type.groupBy("item_id")
        .agg(
            F.coalesce(side(False, "n"), F.lit(0)).alias("normal_n"),
            F.coalesce(side(True, "n"), F.lit(0)).alias("extra_n"),
            side(False, "indexed_median").alias("normal_median"),
            side(True, "indexed_median").alias("extra_median"),
        )
        .withColumn(
            "extra_gap_percent",
            F.when(
                (normal > 0) & (extra > 0),
                F.floor((extra - normal) / normal * 1000.0 + 0.5) / 10.0,
            ),
        )
    )
