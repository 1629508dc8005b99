"""The shared views: the lines that count in prices, and the flat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up


def link_lines(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Lines with their link (one link per line)."""
    return lines.join(links, "line_id")


def indexed_price(price: Column, latest: Column, of_month: Column) -> Column:
    """Price brought to the latest index month; a month missing from the index divides by 1."""
    ratio = latest.cast("double") / F.coalesce(of_month.cast("double"), F.lit(1.0))
    return half_up(price.cast("double") * ratio, 4).cast("decimal(18,4)")


def with_indexed_price(rows: DataFrame, price_index: DataFrame) -> DataFrame:
    """Adds price_indexed and month_found. The index has one row per month, so it is broadcast."""
    latest = price_index.agg(F.max_by("coefficient", "month").alias("latest"))
    months = price_index.select(
        F.col("month").alias("_month"), F.col("coefficient").alias("_coefficient")
    )
    return (
        rows.withColumn("_of_month", F.trunc("document_date", "month"))
        .join(F.broadcast(months), F.col("_of_month") == F.col("_month"), "left")
        .withColumn(
            "price_indexed",
            indexed_price(F.col("unit_price"), latest.scalar(), F.col("_coefficient")),
        )
        .withColumn("month_found", F.col("_month").isNotNull())
        .drop("_of_month", "_month", "_coefficient")
    )


def counted(status: Column, control: Column) -> Column:
    """Rule of a counted line: document not rejected, arithmetic right."""
    return (status != "rejete") & (control != "ecart")


def aggregable_lines(
    linked: DataFrame,
    documents: DataFrame,
    items: DataFrame,
    units: DataFrame,
    price_index: DataFrame,
) -> DataFrame:
    """The lines every unit price is computed from.

    A line of unknown unit has an unknown lump flag and is therefore left out, even though an
    unknown unit counts as aggregable.
    """
    lines = linked.where(
        F.col("validated")
        & ~F.col("excluded")
        & ~F.col("is_title")
        & (F.col("control") != "ecart")
        & (F.col("unit_price") > 0)
        & ~F.col("is_lump_line")
    )
    priced_items = items.where(~F.col("is_lump")).select("item_id")
    kept_documents = documents.where(F.col("status") != "rejete")
    unit_rules = F.broadcast(units.select(F.col("code").alias("unit"), "aggregable"))
    rows = (
        lines.join(priced_items, "item_id", "left_semi")
        .join(kept_documents, "document_id")
        .join(unit_rules, "unit", "left")
        .where(F.coalesce("aggregable", F.lit(True)))
    )
    columns = [
        c
        for c in (
            "line_id", "item_id", "document_id", "document_date", "is_extra", "zone_id",
            "zone_reliable", "client_id", "quantity", "unit_price", "total", "unit",
            "status", "control",
        )
        if c in rows.columns
    ]
    return with_indexed_price(rows.select(*columns), price_index)


def quantity_points(base: DataFrame) -> DataFrame:
    """Lines usable for the quantity effect."""
    return base.where(F.col("quantity") > 0)


def history(
    lines: DataFrame,
    documents: DataFrame,
    links: DataFrame,
    items: DataFrame,
    categories: DataFrame,
    clients: DataFrame,
    zones: DataFrame,
) -> DataFrame:
    """Every line that is not a title, with all its context; nothing is averaged here.

    Documents and links get their context before the lines meet them, so that the lines, by far the
    widest rows, move for two joins only.
    """
    link_columns = [
        c
        for c in ("line_id", "item_id", "validated", "excluded", "exclusion_reason")
        if c in links.columns
    ]
    named_clients = clients.select("client_id", F.col("name").alias("client"))
    placed = documents.join(named_clients, "client_id", "left").join(
        F.broadcast(zones.select("zone_id", "zone_code", "zone_label")), "zone_id", "left"
    )
    labelled = (
        links.select(*link_columns)
        .join(items.select("item_id", F.col("label_print").alias("item_label"), "category_id"), "item_id", "left")
        .join(categories.select("category_id", "category_label"), "category_id", "left")
    )
    keys = ["zone_id", "client_id", "category_id", "item_id", "line_id", "document_id"]
    context = [c for c in documents.columns if c not in keys] + [c for c in link_columns if c not in keys]
    named = ["item_label", "category_label", "client", "zone_code", "zone_label"]
    return (
        lines.where(~F.col("is_title"))
        .join(placed, "document_id")
        .join(labelled, "line_id", "left")
        .select(*keys, *[c for c in lines.columns if c not in keys], *context, *named)
    )
