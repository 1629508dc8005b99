"""Prefix trie of conversations by truncation peeling.

A turn is known by a digest of its role and text, a conversation by its path: for each depth the digest of all turns up to
it, next to the length of the last text. Peeling goes from the greatest depth to the root: conversations that end at a
depth are merged with the nodes that the depth below left behind by stripping their last turn, equal paths are grouped,
and the group is a node, with every sum of its subtree already inside. One aggregation per depth thus finds the nodes and
their figures together; it is combined before the shuffle, so a beginning that a third of all conversations share is one
row per task. Each level is a table below ``spark.checkpoint.dir``; texts are never shuffled.

The digest of a node's ended conversations hashes their ids in order, which no two tasks can share. Ranges of (node, id)
write them as long strings first, so that the one task that a node needs reads blocks, not rows.

Below the greatest depth at which two conversations agree every node has one member and is written from its path at once;
peeling begins there, so the rounds are as many as the deepest shared beginning has turns. A path is as long as its
conversation.

Defined results: null roles and texts are empty; turns of equal number (null first) are ordered by their digest, repeated
rows stay; rows without conv_id belong to no conversation; no conversations, no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.llm.common import prepared, shuffle_partitions, written
from pricebase.session import ensure_checkpoint_dir

#: Bytes of a depth in a path: the digest of all turns so far, and the code points of the last text.
DIGEST, STEP = 16, 20
#: Ids that one block of a digest holds at most.
BLOCK = 20_000
_TURNS = "array<struct<digest: binary, size: int>>"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and code points of each turn, in order."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), _turn().alias("x"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))))


def _turn() -> Column:
    """A turn in the order of its conversation: without number first, then by number, then by digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.col("turn").cast("long")
    return F.struct(turn.isNotNull().alias("numbered"), turn.alias("turn"), digest.alias("digest"), F.length(text).alias("size"))


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of these conversations with role and text of their last turn (null for the root)."""
    place = Window.partitionBy("conv_id").orderBy(_turn())
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(place).cast("long").alias("depth"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return nodes.join(rows, ["conv_id", "depth"], "left")


def with_shared_opening(lists: DataFrame, every: int = 100, choices: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every, then its own from there; h = crc32(c) % choices."""
    shared = (F.crc32(F.col("conv_id").cast("string")) % choices).cast("int")
    opening = lists.select(F.col("conv_id").alias("opens"), F.slice("turns", 1, choices - 1).alias("opening"))
    rows = lists.select("conv_id", "turns", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("opens"))
    none = F.array().cast(_TURNS)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.join(opening, "opens", "left").select("conv_id", F.concat(F.slice(F.coalesce("opening", none), 1, F.col("h")), rest).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, depths = [], []
        for turns in batch.column("turns").to_pylist():
            own, last = [], b""
            for turn in turns:
                last = hashlib.blake2b(last + turn["digest"], digest_size=DIGEST).digest()
                own.append(last + turn["size"].to_bytes(STEP - DIGEST, "big"))
            paths.append(b"".join(own))
            depths.append(len(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(paths, pa.binary()), pa.array(depths, pa.int32())], ["conv_id", "path", "depth"]
        )


def _node(path: Column | str) -> Column:
    """What tells a node: the last digest of its path; the root has an empty one."""
    return F.substring(path, -STEP, DIGEST)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as joined ids of one node."""
    node, ids = None, []

    def block() -> tuple[bytes, int, str]:
        return node, ids[0], ",".join(map(str, ids))

    for batch in batches:
        done = []
        for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (own != node or len(ids) >= BLOCK):
                done.append(block())
                ids = []
            node = own
            ids.append(conv)
        yield _rows(done, ["node", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])
    if ids:
        yield _rows([block()], ["node", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's blocks, which come in order."""
    node, digest = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if digest is not None and own == node:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                done.append((node, digest.hexdigest()))
            node, digest = own, hashlib.sha256(ids.encode())
        yield _rows(done, ["node", "ends"], [pa.binary(), pa.string()])
    if digest is not None:
        yield _rows([(node, digest.hexdigest())], ["node", "ends"], [pa.binary(), pa.string()])


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_FIGURES = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_NODES = f"node binary, above binary, {_FIGURES}"


def _digests_of(path: bytes) -> list[bytes]:
    return [path[at : at + DIGEST] for at in range(0, len(path), STEP)]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each depth of each path; adding to what a task already met would need memory without bound, so Spark counts them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            own = [x for path in batch.column("path").slice(at, 200).to_pylist() for x in enumerate(_digests_of(path), 1)]
            yield _rows(own, ["depth", "node"], [pa.int64(), pa.binary()])


def _private(batches: Iterator[pa.RecordBatch], shared: int) -> Iterator[pa.RecordBatch]:
    """The nodes deeper than ``shared``: one member, one leaf below, nothing saved."""
    names = [f.split()[0] for f in _NODES.split(", ")]
    kinds = [pa.binary(), pa.binary()] + [pa.int64()] * 6
    for batch in batches:
        for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            own = [b"", *_digests_of(path)]
            last = len(own) - 1
            yield _rows([(own[d], own[d - 1], d, conv, 1, int(d < last), 1, 0) for d in range(shared + 1, last + 1)], names, kinds)


def peeled(paths: DataFrame) -> DataFrame:
    """The nodes of all depths, each with its own digest and that of its parent."""
    spark = paths.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/trie-{uuid.uuid4().hex}"
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    meetings = paths.select("path").mapInArrow(_steps, "depth long, node binary").groupBy("node")
    shared = meetings.agg(F.max("depth").alias("depth"), F.count("*").alias("n")).where("n > 1").agg(F.max("depth")).first()[0] or 0
    deep = paths.where(F.col("depth") > shared)
    deep.select("path", "conv_id").mapInArrow(lambda batches: _private(batches, shared), _NODES).write.parquet(f"{folder}/level={shared + 1}")
    left = deep.select(F.substring("path", 1, STEP * shared).alias("path"), "conv_id", one.alias("n_convs"), one.alias("n_leaves"), none.alias("saved_tokens"))
    schema = f"path binary, {_NODES}"
    for depth in range(shared, -1, -1):
        ended = paths.where(F.col("depth") == depth).select(
            "path", "conv_id", one.alias("n_convs"), none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens")
        )
        found = ended.unionByName(left.withColumn("n_children", one)).groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        )
        length = F.conv(F.hex(F.substring("path", DIGEST - STEP, STEP - DIGEST)), 16, 10).cast("long") if depth else none
        above = F.substring("path", 1, STEP * (depth - 1)) if depth > 1 else F.lit(b"")
        nodes = found.select(
            "path", _node("path").alias("node"), _node(above).alias("above"), F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs",
            "n_children", F.greatest("n_leaves", one).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * length).alias("saved_tokens"),
        )
        nodes.write.parquet(f"{folder}/level={depth}")
        left = spark.read.schema(schema).parquet(f"{folder}/level={depth}")
        left = left.select(above.alias("path"), "conv_id", "n_convs", "n_leaves", "saved_tokens")
    return spark.read.schema(_NODES + ", level int").parquet(folder).drop("level")


def trie(lists: DataFrame) -> DataFrame:
    """The nodes of the conversations (conv_id, turns of ``turn_lists``), one row each."""
    spark = prepared(lists.sparkSession)
    paths = written(lists.select("conv_id", "turns").mapInArrow(_paths, "conv_id long, path binary, depth int"), "trie-paths", by=["depth"])
    rows = peeled(paths)
    parts = shuffle_partitions(spark)
    ends = paths.select(_node("path").alias("node"), "conv_id")
    blocks = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_blocks, "node binary, first long, ids string")
    ends = blocks.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends string")
    rows = rows.withColumn("above", F.when(F.col("depth") > 0, F.col("above")))
    parents = rows.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return (
        rows.join(ends, "node", "left")
        .join(parents, "above", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
