"""Session settings the jobs rely on. Nothing already set by the cluster is overridden."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # small shuffles of CPU-heavy text jobs keep using every core
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Turn adaptive skew handling on; UTC so that dates do not depend on the driver's zone."""
    for key, value in _RUNTIME_DEFAULTS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="pricebase-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialized(rows: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, without their lineage."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame) -> DataFrame:
    """As ``materialized``, but as a compressed table that is read column by column and whose size Spark knows."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
