"""Filter objects and the predicates they stand for; an absent filter adds no predicate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricebase.functions.text import search_literal, search_text

RELIABILITY_ORDER = {"faible": 0, "moyenne": 1, "haute": 2}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_text(text: Column, term: str) -> Column:
    """The term is taken literally: no wildcard."""
    return F.contains(text, F.lit(search_literal(term)))


def _work_type(kind: str) -> list[Column]:
    if kind == "normal":
        return [~F.col("is_extra")]
    if kind == "extra":
        return [F.col("is_extra")]
    return []


def _period(since: str | None, until: str | None) -> list[Column]:
    conditions = []
    if since:
        conditions.append(F.col("document_date") >= F.lit(since).cast("date"))
    if until:
        conditions.append(F.col("document_date") <= F.lit(until).cast("date"))
    return conditions


@dataclass(frozen=True)
class PriceFilters:
    search: str | None = None
    category_id: int | None = None
    with_subcategories: bool = True
    zones: tuple[str, ...] = ()
    work_type: str = "all"  # normal | extra | all
    units: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    min_n: int = 0
    min_reliability: str | None = None
    indexed: bool = False
    include_lump: bool = False
    include_unpriced: bool = False

    def row_condition(self, zones: bool = True, work_type: bool = False) -> Column:
        """Predicate on aggregable lines; work type only where the caller wants it."""
        conditions = _period(self.since, self.until)
        if zones and self.zones:
            conditions.append(F.col("zone_code").isin(*self.zones))
        if work_type:
            conditions += _work_type(self.work_type)
        return all_of(conditions)

    @property
    def needs_zone(self) -> bool:
        return bool(self.zones)

    @property
    def restricts_scope(self) -> bool:
        return bool(self.zones or self.since or self.until)


@dataclass(frozen=True)
class HistoryFilters:
    client_id: int | None = None
    zones: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    work_type: str = "all"
    since: str | None = None
    until: str | None = None
    min_total: float | None = None
    max_total: float | None = None
    item_id: int | None = None
    category_id: int | None = None

    def document_condition(self) -> Column:
        conditions = _period(self.since, self.until) + _work_type(self.work_type)
        if self.client_id is not None:
            conditions.append(F.col("client_id") == self.client_id)
        if self.zones:
            conditions.append(F.col("zone_code").isin(*self.zones))
        if self.types:
            conditions.append(F.col("type").isin(*self.types))
        if self.min_total is not None:
            conditions.append(F.col("document_total") >= self.min_total)
        if self.max_total is not None:
            conditions.append(F.col("document_total") <= self.max_total)
        return all_of(conditions)

    def item_condition(self) -> Column | None:
        """Predicate on a linked line (the category without its descendants)."""
        conditions = []
        if self.item_id is not None:
            conditions.append(F.col("item_id") == self.item_id)
        if self.category_id is not None:
            conditions.append(F.col("category_id") == self.category_id)
        return all_of(conditions) if conditions else None


@dataclass(frozen=True)
class CurationFilters:
    category_ids: tuple[int, ...] = field(default=())
    method: str | None = None  # 'auto' = validated automatically
    status: str | None = None
    search: str | None = None

    def condition(self) -> Column:
        conditions = []
        if self.category_ids:
            conditions.append(F.col("category_id").isin(*self.category_ids))
        if self.method == "auto":
            conditions.append(F.col("validated_by").isin("auto", "auto-llm"))
        elif self.method:
            conditions.append(F.col("method") == self.method)
        if self.status:
            conditions.append(F.col("status") == self.status)
        if self.search:
            conditions.append(
                contains_text(F.col("search_text"), self.search)
                | contains_text(search_text(F.col("label_print")), self.search)
                | contains_text(F.col("label_norm"), self.search)
            )
        return all_of(conditions)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; the order must end with a unique key."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page plus the size of the whole result, counted apart (no window over everything)."""
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return page(rows, order, number, size).withColumn("total_rows", total.scalar())
