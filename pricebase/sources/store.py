"""Snapshots of the aggregates and co-located tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_BUCKETS = 256


def write_snapshot(rows: DataFrame, root: str, name: str, version: str) -> str:
    """Writes a full snapshot to a new version folder; readers switch by version."""
    path = f"{root.rstrip('/')}/{name}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def with_item_bucket(rows: DataFrame, buckets: int = ITEM_BUCKETS) -> DataFrame:
    return rows.withColumn("item_bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int"))


def touched_buckets(touched: DataFrame, buckets: int = ITEM_BUCKETS) -> DataFrame:
    return with_item_bucket(touched.select("item_id").distinct(), buckets).select(
        "item_bucket"
    ).distinct()


def refresh_touched(
    rows: DataFrame, touched: DataFrame, path: str, buckets: int = ITEM_BUCKETS
) -> None:
    """Rewrites only the partitions of the touched items (``rows`` holds all current statistics).

    The touched buckets are a bounded list of small integers, so they can prune the write. A bucket
    that has no rows left is removed, as the write alone would keep its old files.
    """
    changed = [r.item_bucket for r in touched_buckets(touched, buckets).collect()]
    if not changed:
        return
    fresh = with_item_bucket(rows, buckets).where(F.col("item_bucket").isin(changed))
    (
        fresh.repartition("item_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("item_bucket")
        .parquet(path)
    )
    filled = {r.item_bucket for r in fresh.select("item_bucket").distinct().collect()}
    jvm, hadoop = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    for bucket in set(changed) - filled:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/item_bucket={bucket}")
        folder.getFileSystem(hadoop).delete(folder, True)


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Table bucketed by its join key: lines and links stored so need no shuffle to meet."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows
