"""Shards of near-equal bytes by sampled splitters.

Size-weighted samples of the key (hash of the text, id) give quantile boundaries; records are range-partitioned by
them. Boundaries fall between groups of equal texts; a group too large for one range (an overfull range) is subdivided
by id. The exact bytes of the ranges, one row per range, then give every record its exact position among all bytes, and
the shard is where its group begins, or where it begins itself if its group outweighs ``group_share`` of a shard.

No text is shuffled: only id, size, checksum and hash travel.

Defined results: a null text has size 1 and the checksum of no bytes; rows with null ids are placed like others; empty
tables give empty results; further columns are ignored; repeated rows are placed separately.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebase.llm.common import prepared, range_of, sampled_splitters, shuffle_partitions, written

LOWEST = -(1 << 63)


def _between_groups(splitters: list[tuple]) -> list[tuple]:
    """A boundary goes before the whole group of its hash, unless that group holds several boundaries."""
    seen = Counter(h for h, _ in splitters)
    hot = {h for h, n in seen.items() if n > 1}
    return sorted({(h, d if h in hot else LOWEST) for h, d in splitters} | {(h, LOWEST) for h in hot})


def shards(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", group_share: float = 0.01
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless in the shard), grown_shard (null)."""
    spark = prepared(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST + 1)).alias("tie"),
    )
    ranges = max(shuffle_partitions(spark), 8 * n_shards)
    splitters = _between_groups(sampled_splitters(rows, ["hash", "tie"], ranges, "size"))
    placed = rows.withColumn("part", range_of(splitters, [F.col("hash"), F.col("tie")]).cast("int"))
    placed = written(placed, "sharding")

    # one row per range: exact bytes before it
    sums = sorted((r["part"], r["bytes"]) for r in placed.groupBy("part").agg(F.sum("size").alias("bytes")).collect())
    total, before = 0, {}
    for part, size in sums:
        before[part], total = total, total + size
    base = spark.createDataFrame(list(before.items()), "part int, before long")
    limit = int(max(total, 1) / n_shards * group_share)

    order = Window.partitionBy("part").orderBy("hash", "tie", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("part", "hash")
    positioned = placed.join(base, "part").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    positioned = positioned.withColumn("group_at", F.min("at").over(group)).withColumn("group_bytes", F.sum("size").over(group))
    anchor = F.when(F.col("group_bytes") > limit, F.col("at")).otherwise(F.col("group_at"))
    positioned = positioned.withColumn("anchor", anchor)
    positioned = positioned.withColumn("shard", F.expr(f"int(anchor * {n_shards} div {max(total, 1)})"))
    positioned = written(positioned.select("doc_id", "size", "text_crc32", "part", "at", "shard"), "sharded")

    counts = positioned.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part", "shard").orderBy("at", "doc_id")
    return positioned.withColumn("nth", F.row_number().over(inside)).join(counts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
