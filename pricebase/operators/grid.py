"""The price grid: normal and extra work side by side for every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.text import search_text
from pricebase.operators.search import grid_search
from pricebase.operators.stats import finished_block, raw_block
from pricebase.operators.tree import descendants
from pricebase.plans.filters import RELIABILITY_ORDER, PriceFilters

SIDE_COLUMNS = (
    "n", "n_documents", "price_min", "price_max", "price_mean", "price_median", "price_p25",
    "price_p75", "indexed_min", "indexed_max", "indexed_mean", "indexed_median", "indexed_p25",
    "indexed_p75", "reliability", "first_date", "last_date",
)


def _rank(reliability: Column) -> Column:
    rank = F.lit(-1)
    for name, order in RELIABILITY_ORDER.items():
        rank = F.when(reliability == name, order).otherwise(rank)
    return rank


def chosen_items(
    items: DataFrame,
    categories: DataFrame | None,
    filters: PriceFilters,
    linked_texts: DataFrame | None = None,
) -> DataFrame:
    """Active items that pass the item-side filters (a category includes its descendants)."""
    kept = items.where(F.col("active"))
    if not filters.include_lump:
        kept = kept.where(~F.col("is_lump"))
    if filters.units:
        kept = kept.where(F.col("item_unit").isin(*filters.units))
    if filters.category_id is not None:
        if filters.with_subcategories:
            subtree = descendants(categories, filters.category_id)
            kept = kept.join(subtree, "category_id", "left_semi")
        else:
            kept = kept.where(F.col("category_id") == filters.category_id)
    if filters.search and filters.search.strip():
        if linked_texts is None:
            raise ValueError("a search needs the wordings of the linked lines")
        kept = kept.join(grid_search(items, linked_texts, filters.search), "item_id", "left_semi")
    return kept


def price_grid(
    base: DataFrame,
    items: DataFrame,
    categories: DataFrame | None = None,
    filters: PriceFilters | None = None,
    linked_texts: DataFrame | None = None,
) -> DataFrame:
    """One row per item; a search needs the linked wordings. The work-type filter only drops items lacking that side."""
    f = filters or PriceFilters()
    kept = chosen_items(items, categories, f, linked_texts)
    rows = base.where(f.row_condition())
    if f.units or f.category_id is not None or f.search:
        rows = rows.join(kept.select("item_id"), "item_id", "left_semi")
    by_type = finished_block(raw_block(rows, ["item_id", "is_extra"]), ["item_id", "is_extra"])

    def pick(column: str, extra: bool) -> Column:
        return F.max(F.when(F.col("is_extra") == extra, F.col(column)))

    pivot = by_type.groupBy("item_id").agg(
        *[pick(c, False).alias(f"normal_{c}") for c in SIDE_COLUMNS],
        *[pick(c, True).alias(f"extra_{c}") for c in SIDE_COLUMNS],
    )
    priced = F.col("normal_n").isNotNull() | F.col("extra_n").isNotNull()
    unpriced_too = f.include_unpriced and not f.restricts_scope
    grid = kept.join(pivot, "item_id", "left" if unpriced_too else "inner")
    kind = "indexed" if f.indexed else "price"
    normal, extra = F.col(f"normal_{kind}_median"), F.col(f"extra_{kind}_median")
    # the indexed normal median must be positive even when raw prices are shown
    gap = F.when(
        (F.col("normal_indexed_median") > 0) & F.col("extra_n").isNotNull(),
        F.floor((extra / normal - 1.0) * 1000.0 + 0.5) / 10.0,
    )
    grid = grid.withColumn("extra_gap_percent", gap)
    if f.work_type == "normal":
        grid = grid.where(F.col("normal_n").isNotNull())
    elif f.work_type == "extra":
        grid = grid.where(F.col("extra_n").isNotNull())
    elif not unpriced_too:
        grid = grid.where(priced)
    if f.min_n > 0:
        best = F.greatest(F.coalesce("normal_n", F.lit(0)), F.coalesce("extra_n", F.lit(0)))
        grid = grid.where(best >= f.min_n)
    if f.min_reliability:
        best = F.greatest(_rank(F.col("normal_reliability")), _rank(F.col("extra_reliability")))
        grid = grid.where(best >= RELIABILITY_ORDER[f.min_reliability])
    return grid


def sort_key(column: str, indexed: bool = False) -> Column:
    """Sort key of a grid column; text sorts without accents or case."""
    kind = "indexed" if indexed else "price"
    keys = {
        "label": search_text(F.col("label_print")),
        "category": F.coalesce("category_code", F.lit("")),
        "unit": F.coalesce("item_unit", F.lit("")),
        "price": F.coalesce(f"normal_{kind}_median", f"extra_{kind}_median"),
        "n": F.coalesce("normal_n", F.lit(0)) + F.coalesce("extra_n", F.lit(0)),
        "last_date": F.greatest("normal_last_date", "extra_last_date"),
    }
    return keys[column]


def grid_order(column: str, ascending: bool = True, indexed: bool = False) -> list[Column]:
    """Missing keys last in both directions; ties by item id."""
    key = sort_key(column, indexed)
    direction = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return [direction, F.col("item_id").asc()]
