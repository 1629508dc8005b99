"""Items billed together: joint document counts, conditional rates, quantity ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebase.functions.numbers import half_up
from pricebase.session import materialized

MIN_DOCUMENTS = 3
# frequent items of a document that meet in one task
TILE = 500


def pairs_within(memberships: DataFrame, tile: int = TILE) -> DataFrame:
    """(item_a, item_b, document_id), a < b, of every two items of a document.

    A document's items are dealt into tiles of about ``tile``, and pairs of tiles meet: a document
    with very many items spreads over a triangle of tasks instead of filling one.
    """
    sizes = memberships.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = memberships.join(sizes, "document_id").withColumn(
        "tile", F.pmod(F.xxhash64("item_id"), F.col("tiles").cast("bigint")).cast("int")
    )
    left = placed.select(
        "document_id", F.col("item_id").alias("one"), F.col("tile").alias("tile_a"),
        F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tile_b"),
    )
    right = placed.select(
        "document_id", F.col("item_id").alias("other"), F.col("tile").alias("tile_b"),
        F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("tile_a"),
    )
    # inside one tile each pair is met from both sides, across two tiles once
    once = (F.col("tile_a") < F.col("tile_b")) | (F.col("one") < F.col("other"))
    return left.join(right, ["document_id", "tile_a", "tile_b"]).where(once).select(
        F.least("one", "other").alias("item_a"), F.greatest("one", "other").alias("item_b"), "document_id"
    )


def cooccurrence(base: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Pairs (a < b) found together in at least ``min_documents`` documents.

    Counts are over distinct documents, the quantity ratio over line pairs. An item in fewer
    documents than the minimum cannot be part of a pair, so it leaves before any pair is formed;
    quantities are looked up only in the documents that a remaining pair really shares.
    """
    # equal quantities of a document collapse into a weight; read several times, so written once
    quantities = materialized(
        base.groupBy("document_id", "item_id", F.col("quantity").cast("double").alias("q")).agg(
            F.count(F.lit(1)).alias("w")
        )
    )
    memberships = quantities.select("document_id", "item_id").distinct()
    totals = memberships.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    frequent = totals.where(F.col("n_documents") >= min_documents)
    kept = memberships.join(frequent.select("item_id"), "item_id", "left_semi")
    pairs = pairs_within(kept)
    joint = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_together"))
    joint = materialized(joint.where(F.col("n_together") >= min_documents))

    shared = pairs.join(joint.select("item_a", "item_b"), ["item_a", "item_b"], "left_semi")
    known = quantities.where(F.col("q").isNotNull())
    a = known.select(
        "document_id", F.col("item_id").alias("item_a"), F.col("q").alias("qa"), F.col("w").alias("wa")
    )
    b = known.select(
        "document_id", F.col("item_id").alias("item_b"), F.col("q").alias("qb"), F.col("w").alias("wb")
    )
    ratios = (
        shared.join(a.where(F.col("qa") != 0), ["document_id", "item_a"])
        .join(b, ["document_id", "item_b"])
        .groupBy("item_a", "item_b", (F.col("qb") / F.col("qa")).alias("ratio"))
        .agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
    )
    medians = ratios.groupBy("item_a", "item_b").agg(
        F.percentile("ratio", F.lit(0.5), F.col("w")).alias("median")
    )
    n_a = totals.select(F.col("item_id").alias("item_a"), F.col("n_documents").alias("n_a"))
    n_b = totals.select(F.col("item_id").alias("item_b"), F.col("n_documents").alias("n_b"))
    return (
        joint.join(medians, ["item_a", "item_b"], "left")
        .join(n_a, "item_a")
        .join(n_b, "item_b")
        .select(
            "item_a",
            "item_b",
            "n_together",
            "n_a",
            "n_b",
            half_up(F.col("n_together") / F.col("n_a"), 3).alias("rate_given_a"),
            half_up(F.col("n_together") / F.col("n_b"), 3).alias("rate_given_b"),
            half_up(F.col("median"), 3).alias("ratio_b_over_a"),
        )
    )


def cooccurrence_topk(pairs: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """The k best partners of every item, whichever side of the pair it is on."""
    ratio = F.col("ratio_b_over_a")
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("item_a").alias("item_id"),
                    F.col("item_b").alias("partner_id"),
                    F.col("rate_given_a").alias("rate"),
                    "n_together",
                    ratio.alias("ratio"),
                ),
                F.struct(
                    F.col("item_b").alias("item_id"),
                    F.col("item_a").alias("partner_id"),
                    F.col("rate_given_b").alias("rate"),
                    "n_together",
                    F.when(ratio != 0, half_up(1.0 / ratio, 3)).alias("ratio"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    active = items.where(F.col("active")).select(
        F.col("item_id").alias("partner_id"), F.col("label_print").alias("partner_label")
    )
    order = Window.partitionBy("item_id").orderBy(
        F.col("rate").desc_nulls_last(), F.col("n_together").desc(), F.col("partner_id")
    )
    return (
        sides.join(active, "partner_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "partner_id", "partner_label", "rate", "n_together", "ratio")
    )
