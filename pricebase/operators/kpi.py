"""Single-row reports over the whole base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebase.operators.curation import AUTO
from pricebase.operators.history import incomplete_documents


def _beside(rows: list[DataFrame]) -> DataFrame:
    """Single-row frames side by side, as scalar subqueries of the first one."""
    first, *others = rows

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        packed = right.select(F.struct(*right.columns).alias("_s"))
        return left.withColumn("_s", packed.scalar()).select(
            *left.columns, *[F.col(f"_s.{c}").alias(c) for c in right.columns]
        )

    return reduce(attach, others, first)


def summary_kpis(
    items: DataFrame, base: DataFrame, categories: DataFrame, zones: DataFrame,
    documents: DataFrame, lines: DataFrame,
) -> DataFrame:
    count = F.count(F.lit(1))
    kept = documents.where(F.col("status") != "rejete").select("document_id")
    return _beside(
        [
            items.agg(F.count_if("active").alias("n_items")),
            base.agg(F.count_distinct("item_id").alias("n_priced_items")),
            categories.agg(F.count_if(F.col("parent_id").isNull()).alias("n_categories")),
            zones.agg(count.alias("n_zones")),
            documents.agg(
                F.count_if(F.col("status") != "rejete").alias("n_documents"),
                F.count_distinct("client_id").alias("n_clients"),
                F.min("document_date").cast("string").alias("first_date"),
                F.max("document_date").cast("string").alias("last_date"),
                F.max("created_on").cast("string").alias("last_write"),
            ),
            lines.where(~F.col("is_title"))
            .join(kept, "document_id", "left_semi")
            .agg(count.alias("n_lines")),
        ]
    )


def progress_kpis(
    lines: DataFrame, links: DataFrame, linked: DataFrame, documents: DataFrame, items: DataFrame,
    proposals: DataFrame, category_proposals: DataFrame,
) -> DataFrame:
    """Curation progress: what is validated and what every queue still holds."""
    count = F.count(F.lit(1))
    kept = documents.where(F.col("status") != "rejete").select("document_id")
    validated_items = links.where(F.col("validated")).select("item_id").distinct()
    active = items.where(F.col("active")).select("item_id")
    open_pairs = (
        proposals.where(F.col("status") == "proposee")
        .join(active.withColumnRenamed("item_id", "source_id"), "source_id", "left_semi")
        .join(active.withColumnRenamed("item_id", "target_id"), "target_id", "left_semi")
    )
    return _beside(
        [
            lines.agg(F.count_if(~F.col("is_title")).alias("n_lines")),
            links.agg(
                F.count_if("validated").alias("n_validated"),
                F.count_if(F.col("validated") & F.col("validated_by").isin(*AUTO)).alias("n_auto"),
            ),
            documents.agg(F.count_if(F.col("status") == "a_revoir").alias("n_to_review")),
            active.join(validated_items, "item_id", "left_anti").agg(
                count.alias("n_items_unvalidated")
            ),
            linked.where(~F.col("validated"))
            .join(kept, "document_id", "left_semi")
            .agg(count.alias("n_pending")),
            orphan_count(lines, links, documents),
            open_pairs.agg(count.alias("n_duplicates")),
            lines.where(F.col("off_scope") & (F.col("off_scope_reason") == "llm"))
            .join(kept, "document_id", "left_semi")
            .agg(count.alias("n_off_scope")),
            category_proposals.agg(
                F.count_if(F.col("status") == "propose").alias("n_category_proposals")
            ),
            incomplete_documents(documents).agg(count.alias("n_incomplete")),
        ]
    ).withColumn(
        "percent_validated",
        F.when(
            F.col("n_lines") > 0,
            F.floor(F.col("n_validated") / F.col("n_lines") * 100.0 + 0.5).cast("double"),
        ),
    )


def orphan_count(lines: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    return (
        lines.where(~F.col("is_title") & ~F.col("off_scope") & (F.col("unit_price") > 0))
        .join(links.select("line_id"), "line_id", "left_anti")
        .join(documents.where(F.col("status") != "rejete").select("document_id"), "document_id",
              "left_semi")
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )
