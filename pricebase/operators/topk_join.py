"""The k most similar texts, exactly: inverted trigram indexes over shards of the pool.

The pool of a block is dealt into shards of bounded number and like size, the queries of a block into
groups of bounded number; every group meets every shard. A meeting builds posting lists for slices of the
shard whose texts are of like size, and reads those of a query from the rarest trigram on. From time to
time the texts met most often are compared whole, which makes some similarities certain. What is still
unread and the sizes bound the similarity of every text not met yet; once that is below the k-th best
similarity already certain (or the threshold), no new text can enter, and only the texts met that can
still reach it are compared whole. The best k of all shards are the answer, so nothing depends on a
ladder of thresholds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.functions.text import trigrams
from pricebase.operators.trigram_join import trigram_code
from pricebase.session import materialized

# texts of a shard; queries of a group, of which there are more than FEW only where MOST would be exceeded
SHARD, GROUP, FEW, MOST = 100_000, 5_000, 24, 100_000
# texts compared whole at once, only to learn what similarity is certain
PROBES = 64
# entries of a list that are read rather than a text compared whole
READ_ON = 2
# texts of a slice have at most so many times the trigrams of its smallest
LIKE = 1.1


class Postings:
    """Posting lists of texts of like size: for each trigram the numbers of its texts, ascending."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.smallest, self.largest = int(sizes.min()), int(sizes.max())
        self._starts = np.cumsum(self.sizes) - self.sizes
        self._known, numbers = np.unique(flat, return_inverse=True)
        self._grams = numbers.astype(np.int32)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        self._texts = owner[np.argsort(self._grams, kind="stable")]
        self._ends = np.append(0, np.cumsum(np.bincount(self._grams, minlength=len(self._known))))
        self._counts = np.zeros(len(sizes), np.int32)
        self._asked = np.zeros(len(self._known), bool)

    def _numbers(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._known, own), len(self._known) - 1)
        return at[self._known[at] == own]

    def best(self, own: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of all texts that may be among the k best (ties included)."""
        size, counts = len(own), self._counts
        at = self._numbers(own)
        self._asked[at] = True
        lists = sorted((self._texts[self._ends[i] : self._ends[i + 1]] for i in at), key=len)
        step = max(len(lists) // 4, 1)
        read, certain = 0, threshold

        def others() -> float:
            """A text met nowhere so far shares at most the unread lists."""
            unread = len(lists) - read
            return unread / (size + max(self.smallest - unread, 0))

        while read < len(lists) and others() >= certain - 1e-12:
            counts[lists[read]] += 1
            read += 1
            if read % step == 0:
                certain = max(certain, self._certain(np.concatenate(lists[:read]), size, k))
        met = np.concatenate([np.zeros(0, np.int32), *lists[:read]])
        met = np.unique(met[self._hopeful(met, len(lists) - read, size, certain)])
        # reading on costs less than whole comparisons of the texts it rules out
        while read < len(lists) and len(lists[read]) <= READ_ON * len(met):
            counts[lists[read]] += 1
            read += 1
            met = met[self._hopeful(met, len(lists) - read, size, certain)]
        for seen in lists[:read]:
            counts[seen] = 0
        score = self._scores(met, size)
        self._asked[at] = False
        kept = score >= threshold
        met, score = met[kept], score[kept]
        if len(met) > k:
            kept = score >= np.partition(score, len(score) - k)[len(score) - k]
            met, score = met[kept], score[kept]
        return met, score

    def _hopeful(self, met: np.ndarray, unread: int, size: int, certain: float) -> np.ndarray:
        """Which texts met can still reach a similarity."""
        shared, sizes = self._counts[met], self.sizes[met]
        most = shared + np.minimum(unread, sizes - shared)
        return most / (size + sizes - most) >= certain - 1e-12

    def _scores(self, met: np.ndarray, size: int) -> np.ndarray:
        """Similarities of whole texts to the one asked for."""
        if not len(met):
            return np.zeros(0)
        sizes = self.sizes[met]
        place = _places(self._starts[met], sizes)
        shared = np.add.reduceat(self._asked[self._grams[place]], np.cumsum(sizes) - sizes, dtype=np.int64)
        return shared / (size + sizes - shared)

    def _certain(self, seen: np.ndarray, size: int, k: int) -> float:
        """The k-th best similarity among some of the texts met most often, each as often in ``seen`` as met."""
        times = self._counts[seen]
        met = np.bincount(times)
        met[1:] //= np.arange(1, len(met))
        enough = np.flatnonzero(np.cumsum(met[::-1]) >= k)
        if not len(enough):
            return 0.0
        often = seen[times >= len(met) - 1 - enough[0]]
        score = self._scores(np.unique(often)[: max(PROBES, k)], size)
        return float(np.partition(score, len(score) - k)[len(score) - k])


class Shard:
    """Any texts, in slices of like size."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        limits: list[int] = []
        for size in np.unique(sizes[sizes > 0]):
            if not limits or size > LIKE * limits[-1]:
                limits.append(int(size))
        of = np.searchsorted(limits, sizes, side="right") - 1
        starts = np.cumsum(sizes) - sizes
        self._slices: list[tuple[np.ndarray, Postings]] = []
        for i in range(len(limits)):
            numbers = np.flatnonzero(of == i)
            self._slices.append((numbers, Postings(flat[_places(starts[numbers], sizes[numbers])], sizes[numbers])))

    def best(self, own: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """As ``Postings.best``; the slices of the likeliest size come first."""
        size = len(own)
        met, score, certain = np.zeros(0, np.int64), np.zeros(0), threshold

        def at_best(part: Postings) -> float:
            return min(part.largest / size, size / part.smallest, 1.0)

        for numbers, part in sorted(self._slices, key=lambda x: -at_best(x[1])):
            if at_best(part) < certain - 1e-12:
                break
            more, scores = part.best(own, k, certain)
            met, score = np.concatenate([met, numbers[more]]), np.concatenate([score, scores])
            if len(met) >= k:
                certain = max(certain, float(np.partition(score, len(score) - k)[len(score) - k]))
        kept = score >= certain
        return met[kept], score[kept]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - first, sizes)


def _grams(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all rows in one array, and how many each row has."""
    grams = rows["grams"].combine_chunks()
    return grams.flatten().to_numpy(), pc.list_value_length(grams).to_numpy(zero_copy_only=False)


def _asked(rows: pa.Table):
    """(place of the row, its trigrams) of the rows that have any."""
    flat, sizes = _grams(rows)
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes):
        yield i, flat[ends[i] - sizes[i] : ends[i]]


def _meet(k: int, threshold: float):
    def run(pool: pa.Table, queries: pa.Table) -> pa.Table:
        pool = pool.sort_by("item_id")
        index = Shard(*_grams(pool))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, grams in _asked(queries):
            met, score = index.best(grams, k, threshold)
            # equal similarities: the smaller item first, which comes first in the shard
            order = np.lexsort((met, -score))[:k]
            found.append((i, met[order], score[order]))
        which = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        met = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
        score = np.concatenate([np.zeros(0), *[f[2] for f in found]])
        columns = queries["query"].take(pa.array(which)), pool["item_id"].take(pa.array(met)), pa.array(score)
        return pa.table(columns, ["query", "item_id", "score"])

    return run


def _every(column: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(column) - 1))


def _parts(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """(block, size, n, before, shards, groups): how blocks that both sides have are dealt out.

    ``before`` counts the block's smaller texts of the pool.
    """
    n = F.count(F.lit(1))
    groups = F.least(F.ceil(n / GROUP), F.greatest(F.lit(FEW), F.ceil(n / MOST))).cast("bigint")
    sizes = pool.groupBy("block", F.size("grams").alias("size")).agg(n.alias("n"))
    block = Window.partitionBy("block")
    smaller = block.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sizes.withColumns({
        "before": F.coalesce(F.sum("n").over(smaller), F.lit(0)),
        "shards": F.ceil(F.sum("n").over(block) / SHARD).cast("bigint"),
    })
    return materialized(dealt.join(queries.groupBy("block").agg(groups.alias("groups")), "block"))


def _meetings(parts: DataFrame, pool: DataFrame, queries: DataFrame):
    """Every group of queries with every shard of the pool; a shard's texts are of neighbouring sizes."""
    nth = F.col("before") + F.pmod(F.xxhash64("item_id"), F.col("n"))
    group = F.pmod("query", F.col("groups")).alias("group")
    keys = ["block", "shard", "group"]
    shards = pool.withColumn("size", F.size("grams")).join(parts, ["block", "size"]).select(
        *pool.columns, F.floor(nth / SHARD).alias("shard"), _every("groups").alias("group")
    )
    blocks = parts.select("block", "shards", "groups").distinct()
    groups = queries.join(blocks, "block").select(*queries.columns, group, _every("shards").alias("shard"))
    return shards.groupBy(*keys).cogroup(groups.groupBy(*keys))


def topk_join(queries: DataFrame, pool: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(text, block, item_id, score): for each query the k pool items of its block of highest similarity.

    ``queries``: text, block (distinct rows); ``pool``: text, block, item_id. Only items that share a
    trigram and reach the threshold are found; equal scores go to the smaller item.
    """
    texts = queries.select("text").union(pool.select("text")).distinct()
    # trigrams of a text are computed once, whatever the blocks it is in
    grams = materialized(texts.withColumn("grams", F.transform(trigrams(F.col("text")), trigram_code)))
    asked = materialized(queries.withColumn("query", F.xxhash64("text", "block")))
    placed = pool.join(grams, "text").select("block", "item_id", "grams")
    wanted = asked.join(grams, "text").select("block", "query", "grams")
    met = _meetings(_parts(placed, asked), placed, wanted).applyInArrow(
        _meet(k, threshold), "query bigint, item_id bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "item_id")
    top = met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    return top.join(asked, "query").select("text", "block", "item_id", "score")
