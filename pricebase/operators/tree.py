"""The category tree: closure, roll-up of counts, checks on changes.

Categories are a small curated dimension (hundreds of rows), so the closure is a recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_closure(categories: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth), each category being its own ancestor at depth 0."""
    return categories.sparkSession.sql(
        """
        WITH RECURSIVE closure(ancestor_id, descendant_id, depth) AS (
            SELECT category_id, category_id, 0 FROM {tree}
            UNION ALL
            SELECT c.ancestor_id, t.category_id, c.depth + 1
            FROM closure c JOIN {tree} t ON t.parent_id = c.descendant_id
        )
        SELECT ancestor_id, descendant_id, depth FROM closure
        """,
        tree=categories,
    )


def descendants(categories: DataFrame, category_id: int) -> DataFrame:
    """The category and everything below it."""
    return categories.sparkSession.sql(
        """
        WITH RECURSIVE subtree(category_id) AS (
            SELECT category_id FROM {tree} WHERE category_id = {root}
            UNION ALL
            SELECT t.category_id FROM subtree s JOIN {tree} t ON t.parent_id = s.category_id
        )
        SELECT category_id FROM subtree
        """,
        tree=categories,
        root=category_id,
    )


def category_rollup(categories: DataFrame, items: DataFrame, base: DataFrame) -> DataFrame:
    """Active and priced items of each category, alone and with all its descendants."""
    priced = base.select("item_id").distinct().withColumn("priced", F.lit(1))
    own = (
        items.where(F.col("active"))
        .join(priced, "item_id", "left")
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("priced").alias("p"))
    )
    closure = category_closure(categories)
    cumulated = (
        closure.join(own, closure.descendant_id == own.category_id)
        .groupBy("ancestor_id")
        .agg(F.sum("n").alias("n_all"), F.sum("p").alias("p_all"))
    )
    known = categories.select(F.col("category_id").alias("known_id"))

    def zero(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    return (
        categories.join(own, "category_id", "left")
        .join(cumulated, F.col("category_id") == F.col("ancestor_id"), "left")
        .join(known, F.col("parent_id") == F.col("known_id"), "left")
        .select(
            "category_id",
            "category_code",
            F.col("known_id").isNull().alias("is_root"),
            zero("n").alias("items"),
            zero("p").alias("priced_items"),
            zero("n_all").alias("items_all"),
            zero("p_all").alias("priced_items_all"),
        )
    )


def tree_checks(categories: DataFrame, items: DataFrame) -> DataFrame:
    """For each category: may it be deleted, and which order does its next child get."""
    used = items.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_items"))
    children = (
        categories.where(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("category_id"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.max("category_ord").alias("last"))
    )
    n_items = F.coalesce("n_items", F.lit(0)).cast("bigint")
    n_children = F.coalesce("n_children", F.lit(0)).cast("bigint")
    return (
        categories.join(used, "category_id", "left")
        .join(children, "category_id", "left")
        .select(
            "category_id",
            n_items.alias("n_items"),
            n_children.alias("n_children"),
            ((n_items == 0) & (n_children == 0)).alias("deletable"),
            (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("next_child_order"),
        )
    )


def move_checks(moves: DataFrame, categories: DataFrame) -> DataFrame:
    """Moves (category_id, new_parent_id) that would put a category below itself are refused."""
    closure = category_closure(categories).select(
        F.col("ancestor_id").alias("category_id"),
        F.col("descendant_id").alias("new_parent_id"),
        F.lit(True).alias("below"),
    )
    return moves.join(closure, ["category_id", "new_parent_id"], "left").select(
        "category_id", "new_parent_id", F.col("below").isNull().alias("allowed")
    )
