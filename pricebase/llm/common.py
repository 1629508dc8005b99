"""Helpers shared by the operators: written intermediate tables, sampled splitters, range buckets."""

from __future__ import annotations

import bisect
import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebase.session import configure, ensure_checkpoint_dir

#: Sampled rows per range; bounds what reaches the driver to ranges * SAMPLE_PER_RANGE short keys.
SAMPLE_PER_RANGE = 40
#: Most ranges; larger ranges are sorted externally.
MAX_RANGES = 4096
_HASH_SPACE = 1 << 40


def prepared(spark: SparkSession) -> SparkSession:
    """Adaptive skew handling on, and Arrow batches small enough for long texts."""
    configure(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


#: Where tables are written while a run's ``scratch`` is open.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside go to a folder of this run, which is removed at the end; the function given writes one that stays."""
    outside = _folder.get() or ensure_checkpoint_dir(spark)
    own = f"{outside}/run-{uuid.uuid4().hex}"
    token = _folder.set(own)

    def kept(rows: DataFrame, name: str) -> DataFrame:
        inner = _folder.set(outside)
        try:
            return written(rows, name)
        finally:
            _folder.reset(inner)

    try:
        yield kept
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(rows: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows as a Parquet table below spark.checkpoint.dir: lineage ends there, and it survives lost executors."""
    path = f"{_folder.get() or ensure_checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = rows.write.partitionBy(*by) if by else rows.write
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, at most so many at once, without copying them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, after which its worker returns freed memory to the system: it serves later stages too, whose memory adds to what it holds."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
            if trim:
                trim(0)

    return wrapped


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, lengthened where a column is called the same (Spark compares names without case)."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """About ``size`` rows, chosen by the hash of their keys: the same rows at every run."""
    total = rows.count()
    if total <= size:
        return rows
    chosen = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(_HASH_SPACE)) < int(_HASH_SPACE * size / total)
    return rows.where(chosen)


def sampled_splitters(
    rows: DataFrame, keys: Sequence[str], ranges: int, size: str | None = None
) -> list[tuple]:
    """Boundaries (keys tuples, increasing, fewer than ``ranges``) that cut the rows into ranges of near-equal weight.

    The sample is bounded by ``ranges * SAMPLE_PER_RANGE`` rows, weighted by the column ``size`` where given.
    """
    ranges = max(1, min(ranges, MAX_RANGES))
    weight = F.col(size) if size else F.lit(1)
    sample = hash_sample(rows, keys, ranges * SAMPLE_PER_RANGE).select(*keys, weight.alias("_weight")).collect()
    ordered = sorted(
        ((tuple(r)[:-1], r["_weight"]) for r in sample if all(v is not None for v in tuple(r)[:-1])),
        key=lambda x: tuple(v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v for v in x[0]),
    )
    totals = list(itertools.accumulate(w for _, w in ordered))
    if not totals or ranges == 1:
        return []
    wanted = [bisect.bisect_left(totals, totals[-1] * i / ranges) for i in range(1, ranges)]
    return [ordered[i][0] for i in sorted(set(wanted)) if i > 0]


def range_of(splitters: Sequence[tuple], keys: Sequence[Column]) -> Column:
    """The number of splitters not above the keys (struct order), by binary search inside the row; null keys come first."""
    if not splitters:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, names)]) for s in splitters])
    key = F.struct(*[k.alias(n) for k, n in zip(keys, names)])
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(splitters)) & F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step
        ).otherwise(at),
    )
