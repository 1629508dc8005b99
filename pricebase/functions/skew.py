"""Guards against one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.session import materialized

# sampled keys per range
SAMPLED = 40


def salts_for(rows: Column, limit: int) -> Column:
    """Number of salts that bring a group of ``rows`` rows under ``limit``."""
    return F.greatest(F.ceil(rows / F.lit(limit)), F.lit(1)).cast("int")


def count_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """df plus the row count of its key, by an aggregate joined back (never a keyed window)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, key, "left")


def range_parts(rows: DataFrame, keys: list[str], parts: int) -> Column:
    """The number (from 0) of the range of near-equal size that a row's keys are in; equal keys share it.

    ``rows`` are read twice, for their number and a sample of about SAMPLED keys per range.
    """
    space, total = 1 << 40, rows.count()
    wanted = F.pmod(F.xxhash64(*keys), F.lit(space)) < min(space, space * SAMPLED * parts // max(total, 1))
    sample = rows.where(wanted).dropna(subset=keys).select(*keys).orderBy(*keys).collect()
    chosen = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    limits = list(dict.fromkeys(map(tuple, chosen)))
    if not limits:
        return F.lit(0)
    types = [rows.schema[k].dataType for k in keys]

    def entry(values: list[Column]) -> Column:
        return F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)])

    table = F.array(*[entry([F.lit(v).cast(t) for v, t in zip(limit, types)]) for limit in limits])
    key = entry([F.col(k) for k in keys])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(limits).bit_length()))])
    # binary search: the number of limits not above the key
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(limits)) & F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step
        ).otherwise(at),
    )


def running_before(
    rows: DataFrame, key: str, order: str, value: Column, name: str
) -> DataFrame:
    """rows plus the sum of ``value`` over the rows of the key that come before in ``order``.

    (key, order) must be unique. The rows are range-partitioned on both, so that a key of any size
    is spread over many tasks: sums inside a part, plus the totals of the key's earlier parts. The
    placed rows are written out once, because both steps must see the same parts.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialized(
        rows.withColumn("_value", value)
        .repartitionByRange(parts, key, order)
        .withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(key, "_part")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.join(offsets, [key, "_part"])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_part", "_offset")
    )
