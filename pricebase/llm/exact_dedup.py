"""Exact duplicates by a content sort.

Sampled splitters range-partition the normalised texts, an external sort inside every range places equal texts next to
each other, and neighbours are compared in full. The order of ranges is (first characters, hash of the whole text, id),
so a common beginning or one huge group of copies is spread over many ranges. A range is sorted in that same order, the
full text before the id. Only a run that has the beginning and hash of a splitter can go on in another range; these runs
are then joined by their full texts.

Defined results: a null text counts as empty, equal to other empty ones; a null id never wins over an id; of repeated
rows with the same id and text one is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.llm.common import prepared, range_of, sampled_splitters, shuffle_partitions, unused, written

#: Characters of the text in a splitter; the hash and the id divide what shares them.
SPLITTER_CHARS = 48

_MARKED = "doc_id long, text_sha256 string, part int, run long, run_rows long, run_best long, last boolean, edge_text string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int64()),
     ("run_rows", pa.int64()), ("run_best", pa.int64()), ("last", pa.bool_()), ("edge_text", pa.string())]
)


def _neighbours(batches: Iterator[pa.RecordBatch], divided: frozenset[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted range; only ids of the current run are held.

    ``divided`` holds beginning and hash of the splitters: runs that may go on in another range.
    """
    run, text, hashed, ids, part = 0, None, 0, [], 0

    def closed() -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        edge = (text[:SPLITTER_CHARS], hashed) in divided
        n = len(own)
        digest = hashlib.sha256(text.encode()).hexdigest()
        edges = pa.array([text] + [None] * (n - 1) if edge else [None] * n, pa.string())
        return pa.RecordBatch.from_arrays(
            [own, pa.array([digest] * n), pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int64()),
             pa.array([n] * n, pa.int64()), pa.array([own[n - 1].as_py()] * n, pa.int64()),
             pa.array([False] * (n - 1) + [True]), edges],
            schema=_ARROW,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, own = batch.column("text"), batch.column("doc_id")
        part = batch.column("part")[0].as_py()
        same = pc.equal(texts.slice(1), texts.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *((~same).nonzero()[0] + 1).tolist()]
        done = []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            first = texts[start].as_py()
            if text is not None and first != text:
                done.append(closed())
                run, ids = run + 1, []
            text, hashed = first, batch.column("hash")[start].as_py()
            ids.append(own.slice(start, end - start))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if text is not None:
        yield closed()


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = prepared(docs.sparkSession)
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    keyed = rows.select(
        F.substring("text", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("text").alias("hash"),
        F.coalesce("doc_id", F.lit(-1)).alias("id"), (F.octet_length("text") + 1).alias("size"),
    )
    splitters = sampled_splitters(keyed, ["head", "hash", "id"], shuffle_partitions(spark), "size")
    keys = [F.substring("text", 1, SPLITTER_CHARS), F.xxhash64("text"), F.coalesce("doc_id", F.lit(-1))]
    # the last row of a run is the one that stays
    order = F.col("doc_id").asc_nulls_first() if keep == "largest" else F.col("doc_id").desc_nulls_first()
    ranged = rows.withColumn("part", range_of(splitters, keys).cast("int"))
    dealt = ranged.repartitionById(len(splitters) + 1, "part").withColumn("head", keys[0]).withColumn("hash", keys[1])
    # ranges are sorted as they are cut, so that a run is divided only where a splitter has its beginning and hash
    ordered = dealt.sortWithinPartitions("head", "hash", "text", order).select("doc_id", "text", "part", "hash")
    divided = frozenset((head, hashed) for head, hashed, _ in splitters)
    marked = written(ordered.mapInArrow(lambda batches: _neighbours(batches, divided), _MARKED), "content-sort")

    same = Window.partitionBy("edge_text")
    best = F.col("run_best") if keep == "largest" else -F.col("run_best")
    winner = F.max(F.struct(best.isNotNull().alias("known"), best.alias("best"), "part")).over(same)
    edges = marked.where("edge_text is not null").select(
        "part", "run", F.sum("run_rows").over(same).alias("all_rows"), winner.alias("winner")
    )
    sign = 1 if keep == "largest" else -1
    edges = edges.select(
        "part", "run", "all_rows", (F.col("winner")["best"] * sign).alias("all_best"),
        (F.col("winner")["part"] == F.col("part")).alias("wins"),
    )
    size = F.coalesce("all_rows", "run_rows")
    best_id = F.when(F.col("all_rows").isNotNull(), F.col("all_best")).otherwise(F.col("run_best"))
    return marked.join(edges, ["part", "run"], "left").select(
        "doc_id", best_id.alias("keep_id"), size.alias("group_size"),
        (F.col("last") & F.coalesce("wins", F.lit(True))).alias("kept"), "text_sha256",
    )


def without_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` (columns unchanged, whatever their names) that stay."""
    own, id_, sha = unused(docs.columns, "own_sha", "kept_id", "kept_sha")
    found = exact_duplicates(docs, keep=keep)
    keys = [F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)]
    same = F.col(id_).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(sha) == F.col(own))
    marked = docs.withColumn(own, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    left = marked.join(found.where("kept").select(*keys), same, "left_semi")
    # only rows that repeat the id and text of one that stays are sought for copies, so that the other texts move once
    again = found.where("not kept and doc_id <=> keep_id").select(*keys).distinct()
    if again.isEmpty():
        return left.drop(own)
    single = left.join(again, same, "left_semi").dropDuplicates(["doc_id", own])
    return left.join(again, same, "left_anti").unionAll(single).drop(own)
