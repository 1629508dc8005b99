"""The closed set of questions an assistant may ask, each over whole-catalogue operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from pricebase.operators import cooccurrence as cooc
from pricebase.operators import fees, history, search, stats
from pricebase.plans.filters import HistoryFilters, PriceFilters, page
from pricebase.session import materialized

MAX_LIMIT = 10


@dataclass(frozen=True)
class Catalogue:
    """The tables the questions read."""

    base: DataFrame
    linked: DataFrame
    linked_texts: DataFrame
    lines: DataFrame
    links: DataFrame
    documents: DataFrame
    items: DataFrame
    categories: DataFrame
    clients: DataFrame
    client_aliases: DataFrame
    zones: DataFrame

    def site_fees(self, term: str = "") -> DataFrame:
        """Lump-sum items with statistics, optionally by label; normal work wins over extra."""
        rows = fees.site_fees(self.linked, self.documents, self.items)
        labels = self.items.where(F.col("active")).select("item_id", "label_print")
        if term:
            labels = labels.where(
                F.contains(F.lower("label_print"), F.lit(term.strip().lower()))
            )
        preferred = F.min_by(F.struct(*[c for c in rows.columns if c != "item_id"]), "is_extra")
        return (
            rows.groupBy("item_id")
            .agg(preferred.alias("s"))
            .join(labels, "item_id")
            .select("item_id", "label_print", "s.*")
            .orderBy(F.col("share_median").desc_nulls_last(), "label_print", "item_id")
        )

    def find_items(
        self, term: str, limit: int = 5, category: str | None = None, unit: str | None = None
    ) -> DataFrame:
        """Search, then category prefix and unit (after the limit), with the raw median."""
        found = materialized(
            search.item_search(self.items, self.linked_texts, [term], min(limit or 5, MAX_LIMIT))
        )
        rows = found.join(
            self.items.select("item_id", "item_unit", "is_lump", "category_id"), "item_id"
        ).join(
            self.categories.select("category_id", "category_code", "category_label"),
            "category_id",
            "left",
        )
        if category:
            rows = rows.where(F.startswith(F.upper("category_code"), F.lit(category.upper())))
        if unit:
            rows = rows.where(F.col("item_unit") == unit)
        chosen = self.base.join(F.broadcast(found.select("item_id")), "item_id", "left_semi")
        medians = stats.price_stats(chosen, ["item_id"]).select("item_id", "n", "price_median")
        return rows.join(medians, "item_id", "left").fillna(0, ["n"]).orderBy("rank")

    def item_stats(self, item_id: int, filters: PriceFilters | None = None) -> DataFrame:
        """Statistics of one item; no row when nothing matches."""
        rows = self.base.where(F.col("item_id") == item_id)
        return stats.price_stats(rows, ["item_id"], filters)

    def compare_items(
        self, item_ids: list[int], dimension: str = "type", years: tuple[int, ...] = ()
    ) -> DataFrame:
        """Items side by side by 'zone', 'type' or 'year'."""
        rows = self.base.where(F.col("item_id").isin(*item_ids))
        if dimension == "zone":
            return stats.stats_by_zone(rows, self.zones, PriceFilters(indexed=True))
        if dimension == "type":
            return stats.compare_by_work_type(rows)
        return stats.compare_by_year(rows, years)

    def find_client(self, term: str) -> DataFrame:
        return search.client_search(
            self.clients, self.client_aliases, self.documents, [term], MAX_LIMIT
        ).orderBy("rank")

    def client_documents(
        self, client_id: int, since: str | None = None, until: str | None = None
    ) -> DataFrame:
        rows = history.documents_list(
            self.documents,
            self.lines,
            self.clients,
            self.zones,
            HistoryFilters(client_id=client_id, since=since, until=until),
        )
        return page(rows, history.documents_order(), 1, 25)

    def document_lines(self, document_id: int) -> DataFrame:
        rows = history.document_lines(
            self.lines.where(F.col("document_id") == document_id), self.links
        )
        return rows.orderBy("ord", "line_id")

    def cooccurrences(self, item_id: int, limit: int = 5, min_documents: int = cooc.MIN_DOCUMENTS) -> DataFrame:
        """Partners of one item, out of the documents that hold it: rates are relative to the item."""
        holding = self.base.where(F.col("item_id") == item_id).select("document_id").distinct()
        near = self.base.join(holding, "document_id", "left_semi")
        pairs = cooc.cooccurrence(near, min_documents)
        pairs = pairs.where((F.col("item_a") == item_id) | (F.col("item_b") == item_id))
        best = cooc.cooccurrence_topk(pairs, self.items, min(limit or 5, MAX_LIMIT))
        return best.where(F.col("item_id") == item_id).orderBy("rank")


def distinct_sources(sources: DataFrame) -> DataFrame:
    """The sources of each answer once per item and filters, the first mention of them.

    ``sources``: answer_id, position, item_id, filters; missing filters are none.
    """
    first = F.min(F.struct("position", "filters"))
    return (
        sources.groupBy("answer_id", "item_id", F.coalesce("filters", F.lit("")).alias("_filters"))
        .agg(first.alias("_f"))
        .select("answer_id", F.col("_f.position").alias("position"), "item_id", F.col("_f.filters").alias("filters"))
    )
