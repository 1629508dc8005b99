"""Documents and lines as they are: lists, details, review screens. Nothing is averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.text import search_literal
from pricebase.plans.filters import HistoryFilters, PriceFilters
from pricebase.plans.views import counted, with_indexed_price


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines that are not titles, and lines in error, per document."""
    return lines.groupBy("document_id").agg(
        F.count_if(~F.col("is_title")).alias("n_lines"),
        F.count_if(F.col("control") == "ecart").alias("n_errors"),
    )


def documents_list(
    documents: DataFrame,
    lines: DataFrame,
    clients: DataFrame,
    zones: DataFrame,
    filters: HistoryFilters | None = None,
    linked_items: DataFrame | None = None,
) -> DataFrame:
    """Documents with client, zone and number of lines; filters by item keep them by semi-join."""
    f = filters or HistoryFilters()
    rows = documents.join(
        F.broadcast(zones.select("zone_id", "zone_code")), "zone_id", "left"
    ).where(f.document_condition())
    condition = f.item_condition()
    if condition is not None:
        rows = rows.join(linked_items.where(condition), "document_id", "left_semi")
    return (
        rows.join(clients.select("client_id", F.col("name").alias("client")), "client_id", "left")
        .join(line_counts(lines), "document_id", "left")
        .fillna(0, ["n_lines", "n_errors"])
    )


def documents_order() -> list[Column]:
    return [
        F.col("document_date").desc_nulls_last(),
        F.col("number").desc_nulls_first(),
        F.col("document_id"),
    ]


def document_lines(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Lines of every document in their order, with the exclusion of their link."""
    state = links.select("line_id", "excluded", "exclusion_reason")
    return (
        lines.where(~F.col("is_title"))
        .join(state, "line_id", "left")
        .withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    )


def history_lines(
    history_rows: DataFrame, price_index: DataFrame, filters: HistoryFilters | None = None
) -> DataFrame:
    """Flat history with indexed prices."""
    f = filters or HistoryFilters()
    rows = history_rows.where(f.document_condition())
    condition = f.item_condition()
    if condition is not None:
        rows = rows.where(condition)
    return with_indexed_price(rows, price_index)


def history_order() -> list[Column]:
    return [
        F.col("document_date").desc_nulls_last(),
        F.col("number").desc_nulls_first(),
        F.col("ord"),
        F.col("line_id"),
    ]


def item_lines(
    linked: DataFrame,
    documents: DataFrame,
    clients: DataFrame,
    zones: DataFrame,
    price_index: DataFrame,
    filters: PriceFilters | None = None,
) -> DataFrame:
    """Validated counted lines behind each item's price; excluded ones stay visible."""
    f = filters or PriceFilters()
    rows = (
        linked.where(F.col("validated"))
        .join(documents, "document_id")
        .where(counted(F.col("status"), F.col("control")))
        .join(F.broadcast(zones.select("zone_id", "zone_code")), "zone_id", "left")
        .where(f.row_condition(work_type=True))
        .join(clients.select("client_id", F.col("name").alias("client")), "client_id", "left")
    )
    return with_indexed_price(rows, price_index)


def item_lines_order() -> list[Column]:
    return [F.col("document_date").desc_nulls_first(), F.col("ord"), F.col("line_id")]


def off_scope_lines(
    lines: DataFrame, documents: DataFrame, only_unreviewed: bool = True, search: str | None = None
) -> DataFrame:
    """Lines set aside as off scope; by default those no human has reviewed."""
    rows = lines.where(F.col("off_scope"))
    if only_unreviewed:
        rows = rows.where(F.col("off_scope_reason") == "llm")
    if search:
        rows = rows.where(F.contains("search_text", F.lit(search_literal(search))))
    return rows.join(
        documents.where(F.col("status") != "rejete").select("document_id", "document_date"),
        "document_id",
    )


def off_scope_order() -> list[Column]:
    return [(F.col("unit_price") > 0).desc_nulls_last(), F.col("search_text"), F.col("line_id")]


def incomplete_documents(documents: DataFrame) -> DataFrame:
    """Not rejected, with date, zone or client missing."""
    missing = (
        F.col("document_date").isNull() | F.col("zone_id").isNull() | F.col("client_id").isNull()
    )
    return documents.where((F.col("status") != "rejete") & missing)


def review_documents(
    documents: DataFrame, lines: DataFrame, incomplete: bool = False
) -> DataFrame:
    """Documents to review, one row per line in error (one row without line when there is none).

    The errors stay flat: a document may have any number of lines.
    """
    chosen = (
        incomplete_documents(documents)
        if incomplete
        else documents.where(F.col("status") == "a_revoir")
    )
    errors = lines.where(~F.col("is_title") & (F.col("control") == "ecart")).select(
        "document_id", "line_id", "ord", "quantity", "unit_price", "total"
    )
    return (
        chosen.join(line_counts(lines), "document_id", "left")
        .fillna(0, ["n_lines", "n_errors"])
        .join(errors, "document_id", "left")
    )


def review_documents_order() -> list[Column]:
    return [
        F.col("document_date").desc_nulls_last(),
        F.col("created_on").desc(),
        F.col("document_id"),
        F.col("ord"),
        F.col("line_id"),
    ]
