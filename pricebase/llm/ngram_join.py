"""N-gram Jaccard join and its connected components by PartEnum signatures.

A document's set holds the hashes of its distinct word n-grams. Sets are banded by size; within a band instance the hash
domain is cut into parts, and similar sets, which differ in few elements, must agree in some part: each set's
signatures are the hashes of its first parts, one more than the elements in which it may differ. Sets of the upper end
of a band also sign in the next one, where their larger partners are.

Parts that are empty or hold only frequent n-grams are skipped, so that no signature gathers documents that merely
share a common passage. A set left with too few parts (mostly frequent n-grams, such as the copies of a large group)
also signs with the n-grams of its prefix, the rarest first, of which two similar sets always share one. Which n-grams
count as frequent is estimated from a sample of documents: it moves work between the two kinds of signatures and never
changes the result.

Spark deals packed signatures out by their hash; a task of the text pass sends on one document of those that agree
within it. Members of one signature are first compared with a common leader each. Copies of one text whose edits differ
are only about half of them similar to any one copy, so those left outside the largest component of a signature are then
compared with a few of its members, others in every round, as long as that keeps joining them. Where a signature is still in
several components, those outside its largest one are compared with every member of another. Sizes and parities of hashed
n-grams, which the text pass leaves for every document, rule most pairs out before any text is moved, and counts of hashed
n-grams more of the last ones: their differences are never more than those of the sets. Every other pair is compared by the
common n-grams of both whole texts. Equal sets are one node throughout.

Defined results: null, empty or blank texts have no n-grams and no links; shorter texts are one n-gram; a row without id
has no links and a null component; rows with one id and different texts are one node, linked with whatever any of its
texts is similar to; extra columns are ignored. Intermediate tables are removed once the result is written.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebase.llm.common import giving_back, in_parts, prepared, scratch, shuffle_partitions, unused, written

WORDS, SIMILARITY = 5, Fraction(3, 4)
#: An n-gram is frequent if it is in so many documents of one in SAMPLE_ONE_IN; at most so many are remembered, in a bitmap.
FREQUENT, SAMPLE_ONE_IN, MOST_FREQUENT, BITS = 4, 64, 1 << 19, 22
#: Extra parts of a band, as a share of its largest size, for those that are skipped.
SLACK = 0.08
#: Signatures gathered in the text pass before they are dealt out; remembered words of a worker.
CHUNK, REMEMBERED = 400_000, 150_000
#: Texts whose words and n-grams a worker of the text pass holds at once.
TEXTS_AT_ONCE = 500
#: Bytes of a signature that are dealt out. They tell the signatures of a bucket apart well enough: what meets is compared in full.
SIGNATURE_BYTES = 5
#: Words of parities that a join compares before anything else of two sets.
PARITY_WORDS = 16
#: Members of the largest component that one outside it is compared with in a round, and the most rounds.
MET_AT_ONCE, ROUNDS = 8, 6
#: Nodes whose texts are fetched by a broadcast of their ids; beyond it by a shuffle.
BROADCAST_IDS = 500_000

#: (node, text) of the nodes given, as many rows as a node has texts.
TextsOf = Callable[[DataFrame], DataFrame]

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


_WORDS = _Words()


def ngram_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    # bytes: only A-Z change case, and words end at 0x20 and 0x09-0x0D
    split = [(t or "").encode().lower().split() for t in texts]
    counts = [len(w) for w in split]
    flat = np.fromiter(map(_WORDS.__getitem__, (w for own in split for w in own)), np.uint64, sum(counts))
    grams = flat * _M1
    for k in range(1, words):
        own = grams[: max(len(flat) - k, 0)]
        own[:] = (own ^ (own >> np.uint64(29))) * _M1 + flat[k:]
    grams = _mixed(grams)
    found, at = [], 0
    for n in counts:
        if n >= words:
            found.append(np.unique(grams[at : at + n - words + 1]))
        elif n:
            found.append(np.array([xxhash.xxh64_intdigest(flat[at : at + n].tobytes(), seed=n)], np.uint64))
        else:
            found.append(np.zeros(0, np.uint64))
        at += n
    return found


class Bands:
    """Size bands and what a set signs in each; all bounds are exact integers."""

    def __init__(self, similarity: Fraction = SIMILARITY):
        self.similarity = similarity
        self.lows, self.highs = [1], [1]

    def _up_to(self, size: int) -> None:
        while self.highs[-1] < size:
            low = self.highs[-1] + 1
            self.lows.append(low)
            self.highs.append(max(low, int(low / self.similarity**2)))

    def partner(self, size: int) -> int:
        """The largest set that can be similar."""
        return int(size / self.similarity)

    def difference(self, both: int) -> int:
        """The most elements in which two similar sets of so many elements together differ."""
        s = self.similarity
        return int(both * (1 - s) / (1 + s))

    def instances(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, elements the set may differ in) where a set of this size signs."""
        largest = self.partner(size)
        self._up_to(max(size, largest))
        own = bisect.bisect_left(self.highs, size)
        return [
            (band, self.difference(2 * high) + 1 + int(SLACK * high) + 1, self.difference(size + min(high, largest)))
            for band in range(own, bisect.bisect_left(self.highs, largest) + 1)
            for high in [self.highs[band]]
        ]

    def prefix(self, size: int) -> int:
        return size - -int(-(size * self.similarity) // 1) + 1


def signatures(own: np.ndarray, frequent: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of one set, given which of its elements are frequent."""
    found, rare, mixed, few = [], ~frequent, _mixed(own + _M1), False
    for band, parts, differ in bands.instances(len(own)):
        # the parts are equal intervals of the hash domain
        part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        firm = np.add.reduceat(rare.astype(np.int64), starts) > 0
        sums = np.add.reduceat(mixed, starts)[firm][: differ + 1]
        where = part[starts][firm][: differ + 1]
        found.append(_mixed(sums ^ _mixed(where * _M2 + np.full(1, band + 1, np.uint64) * _M3)))
        few |= len(sums) <= differ
    if few:
        order = np.lexsort((own, frequent))[: bands.prefix(len(own))]
        found.append(_mixed(own[order] ^ _M3))
    return np.concatenate(found)


_DEALT = "bucket int, kind int, a binary, b binary, c binary, d binary"
_TABLE = "kind int, a long, b long, c long, d long, odd array<long>"


def _frequent_bits(docs: DataFrame, words: int) -> np.ndarray:
    """A bitmap of fixed size over n-gram hashes, from a sample of documents."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ONE_IN)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ngram_sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["gram"])

    counts = written(
        sample.select("text").mapInArrow(giving_back(run), "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(f"n >= {FREQUENT}"), "frequent"
    )
    # how many n-grams have each count: the least count at which they fit
    least, total = FREQUENT, 0
    capped = F.least(F.col("n"), F.lit(10_000))
    for row in sorted(counts.groupBy(capped.alias("n")).agg(F.count("*").alias("grams")).collect(), reverse=True):
        total += row["grams"]
        if total > MOST_FREQUENT:
            least = row["n"] + 1
            break
    slot = F.shiftrightunsigned("gram", 64 - BITS)
    bits = np.zeros(1 << BITS, bool)
    words_of = counts.where(F.col("n") >= least).groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(gram, {64 - BITS}) & 63))")).alias("bits")
    )
    for row in words_of.collect():  # at most 2^BITS / 64 rows
        own = np.unpackbits(np.array([row["bits"]], np.int64).view(np.uint8), bitorder="little")
        bits[row["word"] * 64 : row["word"] * 64 + 64] = own
    return bits


def _short(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest takes, after that number of bytes."""
    kind = np.min_scalar_type(int(values.max()))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _long(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.uint64)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Document numbers as the least one and what they are above it."""
    least = ids.min()
    return least.tobytes() + _short(ids.view(np.uint64) - least.view(np.uint64))


def _unpacked_ids(packed: bytes) -> np.ndarray:
    return (_long(packed[8:]) + np.frombuffer(packed[:8], np.uint64)).view(np.int64)


def _packed(ids: np.ndarray) -> list[bytes]:
    """Runs of document numbers: each number and how often it comes."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return [_packed_ids(ids[starts]), _short(np.diff(np.append(starts, len(ids))))]


def _unpacked(runs: bytes, lengths: bytes) -> np.ndarray:
    return np.repeat(_unpacked_ids(runs), _long(lengths).astype(np.int64))


def _sign(docs: DataFrame, bits: np.ndarray, words: int, similarity: Fraction, buckets: int) -> DataFrame:
    """The text pass. Kind 0: signatures to meet others; 1: those that met a leader in the chunk; 2: sizes, set keys and parities."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, frequent_bits = Bands(similarity), shared.value
        sigs, owners, infos, seen, gathered, chunk = [], [], [], {}, 0, 0
        first = TaskContext.get().partitionId()

        def dealt() -> pa.RecordBatch:
            rows = []
            if sigs:
                ids = np.array([o for o, _ in owners], np.int64)
                ranked = np.argsort(ids, kind="stable")
                all_sigs = np.concatenate([sigs[i] for i in ranked])
                all_owners = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(sigs[i]) for i in ranked])
                ids = ids[ranked]
                sigs.clear()
                # equal signatures stay in the order of their documents
                order = np.argsort(all_sigs, kind="stable")
                all_sigs, all_owners = all_sigs[order], all_owners[order]
                head = np.concatenate([[True], all_sigs[1:] != all_sigs[:-1]])
                leaders = all_owners[head][np.cumsum(head) - 1]
                for kind, which in ((0, head), (1, ~head)):
                    own_sigs, own_docs = all_sigs[which], all_owners[which]
                    own_leaders = ids[leaders[which]] if kind else None
                    spread = own_sigs if kind == 0 else _mixed(own_sigs ^ ids[own_docs].view(np.uint64))
                    bucket = (spread % np.uint64(buckets)).astype(np.int64)
                    # the signatures of a document lie together
                    order = np.argsort(bucket * len(ids) + own_docs, kind="stable")
                    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)):
                        part = order[cuts[b] : cuts[b + 1]]
                        tops = (own_sigs[part] >> np.uint64(64 - 8 * SIGNATURE_BYTES)).view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES].tobytes()
                        led = _packed_ids(own_leaders[part]) if kind else b""
                        rows.append((int(b), kind, tops, *_packed(ids[own_docs[part]]), led))
            if infos:
                numbers, sizes, highs, lows, odd = zip(*infos)
                null = np.array([i is None for i in numbers], np.uint8).tobytes()
                plain = np.array([0 if i is None else i for i in numbers], np.int64).tobytes()
                keys = np.array([highs, lows], np.uint64).tobytes() + b"".join(odd)
                rows.append(((first + chunk) % buckets, 2, plain, null, np.array(sizes, np.int64).tobytes(), keys))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "kind", "a", "b", "c", "d"])

        for batch in in_parts(batches, TEXTS_AT_ONCE):
            sets = ngram_sets(batch.column("text").to_pylist(), words)
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), sets):
                key = xxhash.xxh128_intdigest(own.tobytes())
                signed = key in seen
                odd = seen[key] if signed else parities(own).tobytes()
                infos.append((doc_id, len(own), key >> 64, key & (1 << 64) - 1, odd))
                if doc_id is None or not len(own) or signed:
                    continue  # an equal set has signed for it
                seen[key] = odd
                sigs.append(signatures(own, frequent_bits[(own >> np.uint64(64 - BITS)).astype(np.int64)], bands))
                owners.append((doc_id, len(sigs[-1])))
                gathered += len(sigs[-1])
            if gathered >= CHUNK or len(infos) >= CHUNK // 8:
                yield dealt()
                sigs, owners, infos, seen, gathered, chunk = [], [], [], {}, 0, chunk + 1
        if infos:
            yield dealt()

    return docs.mapInArrow(giving_back(run), _DEALT)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Who met whom: kind 1 holds signature, document and its leader, the smallest id; kind 2 passes through."""
    tops, owners = [], []

    def table(kind: int, *columns: np.ndarray, null: np.ndarray | None = None, odd: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        size = len(columns[0])
        for at in range(0, size, 100_000):
            part = [c[at : at + 100_000] for c in columns]
            n = len(part[0])
            arrays = [pa.array(np.full(n, kind, np.int32))]
            arrays.append(pa.array(part[0], mask=null[at : at + n]) if null is not None else pa.array(part[0]))
            arrays += [pa.array(c) for c in part[1:]]
            arrays += [pa.array(np.zeros(n, np.int64))] * (5 - len(arrays))
            if odd is None:
                arrays.append(pa.nulls(n, pa.list_(pa.int64())))
            else:
                ends = np.arange(0, (n + 1) * PARITY_WORDS, PARITY_WORDS, dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, odd[at : at + n].ravel()))
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "a", "b", "c", "d", "odd"])

    def wide(packed: bytes) -> np.ndarray:
        found = np.zeros((len(packed) // SIGNATURE_BYTES, 8), np.uint8)
        found[:, :SIGNATURE_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, SIGNATURE_BYTES)
        return found.view(np.int64).ravel()

    for batch in batches:
        for kind, a, b, c, d in zip(*[batch.column(name) for name in ("kind", "a", "b", "c", "d")]):
            a, b, c, d = a.as_py(), b.as_py(), c.as_py(), d.as_py()
            if kind.as_py() == 2:
                ids, sizes = np.frombuffer(a, np.int64), np.frombuffer(c, np.int64)
                keys = np.frombuffer(d, np.int64, 2 * len(ids)).reshape(2, -1)
                odd = np.frombuffer(d, np.int64, offset=16 * len(ids)).reshape(-1, PARITY_WORDS)
                yield from table(2, ids, sizes, keys[0], keys[1], null=np.frombuffer(b, np.uint8).astype(bool), odd=odd)
            elif kind.as_py() == 1:
                yield from table(1, wide(a), _unpacked(b, c), _unpacked_ids(d))
            else:
                tops.append(wide(a))
                owners.append(_unpacked(b, c))
    if tops:
        all_tops, all_owners = np.concatenate(tops), np.concatenate(owners)
        tops.clear()
        owners.clear()
        order = np.lexsort((all_owners, all_tops))
        all_tops, all_owners = all_tops[order], all_owners[order]
        head = np.concatenate([[True], all_tops[1:] != all_tops[:-1]])
        leaders = all_owners[head][np.cumsum(head) - 1]
        yield from table(1, all_tops[~head], all_owners[~head], leaders[~head])


def similar(a: np.ndarray, b: np.ndarray, similarity: Fraction = SIMILARITY) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * similarity.denominator >= similarity.numerator * (len(a) + len(b) - common) and common > 0


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _links(pairs: DataFrame, texts_of: TextsOf, words: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar; the texts of ``b``, often shared by many pairs, join last."""
    texts = written(texts_of(_ends(pairs)), "texts")
    a, b = (texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab")
    both = _broadcast_if_small(pairs).join(a, "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            sets = ngram_sets(batch.column("text_a").to_pylist(), words)
            kept = []
            for own, other, text in zip(sets, b.to_pylist(), batch.column("text_b")):
                if other != last:
                    last, last_set = other, ngram_sets([text.as_py()], words)[0]
                kept.append(similar(own, last_set, similarity))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(giving_back(run), "a long, b long")


def sketch(own: np.ndarray) -> bytes:
    """Counts of the elements by the top bits of their hash, about half as many counts as elements; 255 is the most."""
    bits = max(len(own) // 2, 8).bit_length()
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes, size_a: int, size_b: int, bands: Bands) -> bool:
    """False only where sizes or counts show that the sets differ in too many elements."""
    if max(size_a, size_b) > bands.partner(min(size_a, size_b)):
        return False
    x, y = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (a, b))
    if len(x) != len(y):  # counts at the limit cannot be added up
        x, y = (x, y) if len(x) > len(y) else (y, x)
        if x.max() == 255 or y.max() == 255:
            return True
        x = x.reshape(len(y), -1).sum(1)
    return int(np.abs(x - y).sum()) <= bands.difference(size_a + size_b)


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of 64 * PARITY_WORDS intervals of the hash domain holds an odd number of elements, as bits.

    A difference of sets in one element turns one bit, so sets differ in at least as many elements as their bits do.
    """
    bits = (64 * PARITY_WORDS - 1).bit_length()
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """Per node: size and the counts of ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ngram_sets(batch.column("text").to_pylist(), words)
            columns = [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "sketch"])

    return texts.mapInArrow(giving_back(run), "node long, size long, sketch binary")


def _near(pairs: DataFrame, known: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) that sizes and parities do not rule out."""
    own, other = known.alias("x"), known.alias("y")
    both = pairs.select("a", "b").join(own, F.col("a") == F.col("x.node")).join(other, F.col("b") == F.col("y.node"))
    return both.where(_not_ruled_out("x", "y", similarity)).select("a", "b").distinct()


def _not_ruled_out(a: str, b: str, similarity: Fraction) -> Column:
    """What ``may_be_similar`` tests, on sizes and parities: a condition that the join itself evaluates."""
    more, less = similarity.denominator + similarity.numerator, similarity.denominator - similarity.numerator
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = reduce(add, [F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITY_WORDS)])
    near = F.least(size_a, size_b) * similarity.denominator >= F.greatest(size_a, size_b) * similarity.numerator
    return near & (apart * more <= (size_a + size_b) * less)


def _members(met: DataFrame, shares: DataFrame, grouped: DataFrame) -> DataFrame:
    """(sig, node) of the signatures whose documents are in several components; one of those with the same documents."""
    component = grouped.select("node", "component")
    led = grouped.select(F.col("node").alias("leader_node"), F.col("component").alias("leader_component"))
    placed = shares.join(component, "node", "left").join(led, "leader_node", "left")
    split = placed.where(F.coalesce("component", "node") != F.coalesce("leader_component", "leader_node"))
    split = _broadcast_if_small(written(split.select("doc_id", "leader"), "split"))
    # the signatures in which someone is not in the leader's component, with all their documents
    mixed = _broadcast_if_small(written(met.join(split, ["doc_id", "leader"], "left_semi").select("sig").distinct(), "mixed"))
    members = met.join(mixed, "sig", "left_semi").select("sig", F.explode(F.array("doc_id", "leader")).alias("doc_id"))
    node_of = shares.select(F.explode(F.array(F.struct("doc_id", "node"), F.struct(F.col("leader").alias("doc_id"), F.col("leader_node").alias("node")))).alias("x"))
    members = written(members.join(node_of.select("x.*").distinct(), "doc_id").select("sig", "node").distinct(), "members")
    content = members.groupBy("sig").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")
    )
    single = content.groupBy("n", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig")
    return written(members.join(single, "sig", "left_semi"), "members")


def _placed(members: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their components, and the largest component of each signature (sig, main, size)."""
    placed = members.join(grouped, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    per = placed.groupBy("sig", "component").agg(F.count("*").alias("n"))
    return placed, per.groupBy("sig").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"))


def _joined(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """The components after some more links."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = written(grouped.unionByName(ends.join(grouped, "node", "left_anti").select("node", F.col("node").alias("component"))), "labels")
    a, b = (known.select(F.col("node").alias(side), F.col("component").alias(f"component_{side}")) for side in "ab")
    between = links.join(a, "a").join(b, "b").where("component_a <> component_b")
    moves = components(between.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
    moves = moves.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return written(known.join(moves, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "labels")


def _attached(members: DataFrame, grouped: DataFrame, known: DataFrame, texts_of: TextsOf, words: int, similarity: Fraction) -> DataFrame:
    """Components after rounds in which nodes outside the largest component of a signature meet some of its members."""
    left = None
    for nth in range(ROUNDS):
        placed, main = _placed(members, grouped)
        # in a small signature it is no more work to compare with everybody
        main = main.where(F.col("size") > 4 * MET_AT_ONCE)
        outside = placed.join(main, "sig").where("component <> main")
        outside = outside.groupBy("node").agg(F.max_by("sig", F.struct("size", "sig")).alias("sig"))
        outside = written(outside, "outside")
        count = outside.count()
        if not count or left is not None and 10 * count > 9 * left:
            break
        left = count
        inside = placed.join(main, "sig").where("component = main").join(outside.select("sig").distinct(), "sig", "left_semi")
        some = Window.partitionBy("sig").orderBy(F.xxhash64("node", F.lit(nth)), "node")
        inside = inside.withColumn("nth", F.row_number().over(some)).where(F.col("nth") <= MET_AT_ONCE)
        pairs = outside.select("sig", F.col("node").alias("a")).join(inside.select("sig", F.col("node").alias("b")), "sig").select("a", "b")
        pairs = written(_near(pairs, known, similarity), "met-inside")
        links = written(_links(pairs, texts_of, words, similarity), "links")
        if links.isEmpty():
            break
        grouped = _joined(grouped, links)
    return grouped


def _crossed(
    members: DataFrame, grouped: DataFrame, stars: DataFrame, known: DataFrame, texts_of: TextsOf, words: int, similarity: Fraction
) -> DataFrame:
    """Pairs (a, b) of one signature that are in different components, were not compared yet and may be similar."""
    members, main = _placed(members, grouped)
    counted = members.join(known, "node")
    few = counted.join(main.select("sig", "main"), "sig").where("component <> main").alias("x")
    met_again = F.col("x.sig") == F.col("y.sig")
    pairs = few.join(counted.alias("y"), met_again & (F.col("x.component") != F.col("y.component")) & _not_ruled_out("x", "y", similarity))
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    pairs = written(pairs.join(stars, ["a", "b"], "left_anti"), "may-cross")
    counts = written(_sketches(texts_of(_ends(pairs)), words), "sketches")
    for side in "ab":
        pairs = pairs.join(counts.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for batch in batches:
            own = [batch.column(f"{kind}_{side}").to_pylist() for kind in ("sketch", "size") for side in "ab"]
            mask = pa.array([may_be_similar(*x, bands) for x in zip(*own)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(side).filter(mask) for side in "ab"], ["a", "b"])

    found = pairs.mapInArrow(giving_back(run), "a long, b long").distinct()
    return written(found, "crossed")


def _broadcast_if_small(keys: DataFrame) -> DataFrame:
    return keys if keys.count() > BROADCAST_IDS else F.broadcast(keys)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, by least labels and pointer jumping over written tables."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("component", "heard").alias("near"), "component")
        ahead = labels.select(F.col("node").alias("near"), F.col("component").alias("ahead"))
        jumped = nearer.join(ahead, "near", "left").select(
            "node", F.least("near", F.coalesce("ahead", "near")).alias("component"), (F.least("near", F.coalesce("ahead", "near")) < F.col("component")).alias("moved")
        )
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: Fraction = SIMILARITY
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    with scratch(prepared(docs.sparkSession)) as kept:
        return kept(_components_of(docs, id_col, text_col, words, similarity), "components")


def _components_of(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: Fraction) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = shuffle_partitions(spark)
    dealt = _sign(rows, _frequent_bits(rows, words), words, similarity, buckets).repartitionById(buckets, "bucket")
    table = written(dealt.mapInArrow(giving_back(_met), _TABLE), "signatures", by=["kind"])
    sizes = table.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").cast("int").alias("n_shingles"), "c", "d")
    # equal sets are one node, named by the smallest id
    classes = sizes.where("n_shingles > 0 and doc_id is not null").groupBy("c", "d").agg(F.min("doc_id").alias("set_node"))
    named = sizes.join(classes, ["c", "d"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_node")).alias("set_node"))
    named = written(named, "set-nodes")
    # an id with several texts joins their nodes
    node_of = named.where("set_node is not null").groupBy("doc_id").agg(F.min("set_node").alias("node"))
    split = written(named.where("set_node is not null").join(node_of, "doc_id").where("set_node <> node").select("doc_id", "set_node", "node"), "split")

    met = table.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("doc_id"), F.col("c").alias("leader"))
    shares = met.groupBy("doc_id", "leader").agg(F.count("*").alias("n"))
    leader_node = node_of.select(F.col("doc_id").alias("leader"), F.col("node").alias("leader_node"))
    shares = written(shares.join(node_of, "doc_id").join(leader_node, "leader"), "shares")
    apart = shares.where("node <> leader_node")
    # each node against the leader with which it shares most signatures
    stars = apart.groupBy(F.col("node").alias("a"), F.col("leader_node").alias("b")).agg(F.sum("n").alias("n"))
    stars = written(stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")), "stars")

    several = not split.isEmpty()  # a node holds every text of the ids that name it
    names = split.select("doc_id", "node").distinct()

    def rows_of(table: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
        nodes = _broadcast_if_small(nodes)
        own = table.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), *columns)
        if several:
            own = own.union(table.join(names.join(nodes, "node", "left_semi"), "doc_id").select("node", *columns)).distinct()
        return own

    def texts_of(nodes: DataFrame) -> DataFrame:
        return rows_of(rows, nodes, ["text"])

    infos = table.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("size"), *[F.col("odd")[i].alias(f"p{i}") for i in range(PARITY_WORDS)])
    wanted = written(apart.select(F.explode(F.array("node", "leader_node")).alias("node")).distinct(), "wanted")
    known = written(rows_of(infos, wanted, [c for c in infos.columns if c != "doc_id"]).distinct(), "parities")

    near = written(_near(stars, known, similarity), "near")
    links = written(_links(near, texts_of, words, similarity).union(split.select(F.col("set_node").alias("a"), F.col("node").alias("b"))), "links")
    grouped = components(links)
    members = _members(met, shares, grouped)
    grouped = _attached(members, grouped, known, texts_of, words, similarity)
    crossed = _crossed(members, grouped, stars, known, texts_of, words, similarity)
    more = written(_links(crossed, texts_of, words, similarity), "links")
    if not more.isEmpty():
        grouped = _joined(grouped, more)

    result = named.join(node_of, "doc_id", "left").join(grouped, "node", "left")
    return result.select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component, and those without id; columns unchanged."""
    (kept_id,) = unused(docs.columns, "kept_id")
    kept = ngram_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col("doc_id") == F.col(kept_id), "left_semi").unionAll(docs.where("doc_id is null"))
