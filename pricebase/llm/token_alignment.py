"""Alignment of two tokenizers by the bytes of their tokens, with corpus-wide counts of linked ids.

The first pass encodes every text with both tokenizers, keeps the ids, and counts the links of a stretch of documents per
id pair. The distinct pairs, dealt into shards by their hash, get one minimal perfect hash function per shard (levels of
bit arrays: a pair alone in its slot of a level is placed, the others go on to the next). Counts become dense vectors
indexed by that function and are summed as a tree: stretches into branches, branches into the shard's vector. The second
pass aligns the kept ids again and looks up the count of every link; the pair stored at a place verifies the answer.

What a lookup needs is bounded by the product of the vocabularies, not by the corpus. It is sent to the tasks in groups
of shards of at most ``MOST_BYTES``; with several groups the documents are passed over once for each.

Defined results: a null or empty text, or one whose tokens of either side do not spell " " + text, has no tokens and zeros
(groups ''); repeated rows count each; a null id stays null; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebase.llm import byte_bpe
from pricebase.llm.common import prepared, shuffle_partitions, written

#: Shards of the pairs; branches of the tree of sums.
SHARDS, BRANCHES = 64, 16
#: Links gathered before a task counts them; bytes of lookup tables sent at once.
STRETCH, MOST_BYTES = 3_000_000, 256 << 20
#: Bits of a level per pair that reaches it; documents aligned at once.
ROOM, AT_ONCE = 2, 64

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shard_of(pairs: np.ndarray) -> np.ndarray:
    return (_mixed(pairs.astype(np.uint64) + _M1) >> np.uint64(40)).astype(np.int64) % SHARDS


@dataclass(frozen=True)
class PerfectHash:
    """A minimal perfect hash function: distinct keys to 0 .. n-1 without gaps."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(keys.astype(np.uint64) * _M1 + np.array([level + 1], np.uint64) * _M3) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(keys):
            size = -(-ROOM * len(keys) // 64) * 64
            slots = cls._slots(keys, len(sizes), size)
            alone = np.bincount(slots, minlength=size) == 1
            keys = keys[~alone[slots]]
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
        return cls.read(np.array(sizes, np.int64), np.concatenate([*bits, np.zeros(0, np.uint8)]).view(np.uint64))

    @classmethod
    def read(cls, sizes: np.ndarray, words: np.ndarray) -> PerfectHash:
        return cls(sizes, words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some of the keys that were not among those hashed, any place for the others."""
        place, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            slots = self._slots(keys[open_], level, size) + start
            word, bit = self.words[slots >> 6], (slots & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            place[open_[here]] = (self.ranks[slots >> 6] + np.bitwise_count(below))[here]
            open_, start = open_[~here], start + size
            if not len(open_):
                break
        return place


class Sides:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self._a = byte_bpe.tokenizer_encoder(path_a, pattern)
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_bpe.token_table(path_a), piece_table(path_b)
        self.lengths_a, self.lengths_b = (np.array([*map(len, t)], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.kind_a, self.kind_b = (np.uint16 if len(t) <= 1 << 16 else np.uint32 for t in (self.bytes_a, self.bytes_b))
        # every id as it is written in a group, by what follows it
        numbers_a, numbers_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        self.written = [n + s for numbers, ends in ((numbers_a, ",|"), (numbers_b, ",;")) for s in ends for n in numbers]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, self.kind_a), np.zeros(0, self.kind_b)
        found = []
        for text, ids_b in zip(texts, self._b.encode([t or "" for t in texts], num_threads=1)):
            if not text:
                found.append(none)
                continue
            ids_a = np.frombuffer(self._a.encode(" " + text), np.uint32)
            raw = b" " + text.encode()
            whole = b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))
            found.append((ids_a.astype(self.kind_a), np.array(ids_b, self.kind_b)) if whole else none)
        return found


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> list[bytes]:
    """The bytes of every id: U+2581 is a space, <0xHH> a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if single else p.replace("▁", " ").encode() for p, single in pieces]


@functools.lru_cache(maxsize=2)
def _sides(path_a: str, pattern: str, path_b: str) -> Sides:
    return Sides(path_a, pattern, path_b)


@dataclass(frozen=True)
class Aligned:
    """A batch of documents, tokens in one row: links are pairs of positions of the two sides whose bytes end together."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray

    @classmethod
    def of(cls, encoded: list[tuple[np.ndarray, np.ndarray]], sides: Sides) -> Aligned:
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in encoded)]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in encoded], np.int64) for k in (0, 1))
        # no token is empty and both sides spell the same bytes, so ends are distinct, and equal where documents end
        ends_a, ends_b = np.cumsum(sides.lengths_a[ids_a]), np.cumsum(sides.lengths_b[ids_b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[ends_a], in_b[ends_b] = True, True
        return cls(ids_a, ids_b, n_a, n_b, np.flatnonzero(in_b[ends_a]), np.flatnonzero(in_a[ends_b]))

    def pairs(self, vocabulary_b: int) -> np.ndarray:
        return self.ids_a[self.at_a] * vocabulary_b + self.ids_b[self.at_b]

    def documents(self) -> np.ndarray:
        """The document of each link."""
        return np.searchsorted(np.cumsum(self.n_a), self.at_a, side="right")

    def groups(self, sides: Sides) -> list[str]:
        """Each document's groups, ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(self.ids_a), len(self.ids_b)
        last_a, last_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
        last_a[self.at_a], last_b[self.at_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # a group's tokens of A stand after the tokens of B of the groups before it, those of B after its tokens of A
        before_b = np.concatenate([[0], self.at_b + 1])
        codes = np.zeros(na + nb, np.int64)
        va, vb = len(sides.bytes_a), len(sides.bytes_b)
        codes[np.arange(na) + before_b[group_a]] = self.ids_a + last_a * va
        codes[np.arange(nb) + (self.at_a + 1)[group_b]] = self.ids_b + 2 * va + last_b * vb
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        words = list(map(sides.written.__getitem__, codes.tolist()))
        return ["".join(words[start:end])[:-1] for start, end in zip([0, *ends], ends)]


_FIRST = "kind int, doc_id long, a binary, b binary, shard int, branch int, pairs binary, counts binary"
_NAMES = [f.split()[0] for f in _FIRST.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, AT_ONCE) for batch in batches for at in range(0, batch.num_rows, AT_ONCE))


def _batch(*columns: list, names: list[str] = _NAMES, kinds: list[pa.DataType] = _KINDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _encoded(docs: DataFrame, tokenizers: tuple[str, str, str]) -> DataFrame:
    """Kind 0: the ids of both sides of each document; kind 1: pairs and their counts in a stretch, per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*tokenizers)
        gathered, links, stretch = [], 0, TaskContext.get().partitionId()

        def counted() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(gathered), return_counts=True)
            shard = shard_of(pairs)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            own = [(s, order[cuts[s] : cuts[s + 1]]) for s in range(SHARDS) if cuts[s] < cuts[s + 1]]
            none = [None] * len(own)
            return _batch(
                [1] * len(own), none, none, none, [s for s, _ in own], [stretch % BRANCHES] * len(own),
                [pairs[x].tobytes() for _, x in own], [counts[x].astype(np.int64).tobytes() for _, x in own],
            )

        for batch in _slices(batches):
            encoded = sides.encode(batch.column("text").to_pylist())
            gathered.append(Aligned.of(encoded, sides).pairs(len(sides.bytes_b)))
            links += len(gathered[-1])
            n, ids = len(encoded), batch.column("doc_id").to_pylist()
            none = [None] * n
            yield _batch([0] * n, ids, [a.tobytes() for a, _ in encoded], [b.tobytes() for _, b in encoded], none, none, none, none)
            if links >= STRETCH:
                yield counted()
                gathered, links, stretch = [], 0, stretch + 1
        if links:
            yield counted()

    return docs.mapInArrow(run, _FIRST)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each shard of the task, as far as its rows tell."""
    known: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for shard, pairs in zip(batch.column("shard").to_pylist(), batch.column("pairs").to_pylist()):
            own = known.setdefault(shard, [])
            own.append(np.frombuffer(pairs, np.int64))
            if len(own) > 1 and sum(map(len, own[1:])) > len(own[0]):
                known[shard] = [np.unique(np.concatenate(own))]
    for shard, own in known.items():
        yield _batch([shard], [np.unique(np.concatenate(own)).tobytes()], names=["shard", "pairs"], kinds=[pa.int32(), pa.binary()])


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash function of each shard, and its pairs in the order of their places."""
    for batch in _distinct(batches):
        shard, pairs = batch.column("shard")[0].as_py(), np.frombuffer(batch.column("pairs")[0].as_py(), np.int64)
        own = PerfectHash.of(pairs)
        keys = np.zeros(len(pairs), np.int64)
        keys[own(pairs)] = pairs
        yield _batch(
            [shard], [own.sizes.tobytes()], [own.words.tobytes()], [keys.tobytes()],
            names=["shard", "sizes", "words", "keys"], kinds=[pa.int32()] + [pa.binary()] * 3,
        )


_SUM = "shard int, counts binary"


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A branch's dense vector per shard: the shard's function comes first, then the stretches."""
    shard, own, total = None, None, None

    def done() -> pa.RecordBatch:
        return _batch([shard], [total.tobytes()], names=["shard", "counts"], kinds=[pa.int32(), pa.binary()])

    for batch in batches:
        for row in batch.to_pylist():
            if row["sizes"] is not None:
                if total is not None:
                    yield done()
                own = PerfectHash.read(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
                shard, total = row["shard"], np.zeros(int(own.ranks[-1]), np.int64)
            else:
                total[own(np.frombuffer(row["pairs"], np.int64))] += np.frombuffer(row["counts"], np.int64)
    if total is not None:
        yield done()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, counts in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(counts, np.int64)
            totals[shard] = totals[shard] + own if shard in totals else own
    for shard, total in totals.items():
        yield _batch([shard], [total.tobytes()], names=["shard", "counts"], kinds=[pa.int32(), pa.binary()])


def _count_tables(partial: DataFrame) -> DataFrame:
    """One row per shard: its function, the pairs by place and their counts over all documents."""
    parts = shuffle_partitions(partial.sparkSession)
    branched = partial.select("shard", "pairs").repartition(parts, "shard", partial["branch"]).mapInArrow(_distinct, "shard int, pairs binary")
    functions = branched.repartition(parts, "shard").mapInArrow(_functions, "shard int, sizes binary, words binary, keys binary")
    functions = written(functions, "pair-functions")
    none = F.lit(None).cast("binary")
    every = functions.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("branch"), F.lit(0).alias("nth"),
        "sizes", "words", none.alias("pairs"), none.alias("counts"),
    )
    stretches = partial.select("shard", "branch", F.lit(1).alias("nth"), none.alias("sizes"), none.alias("words"), "pairs", "counts")
    streams = every.unionByName(stretches).repartition(parts, "shard", "branch").sortWithinPartitions("shard", "branch", "nth")
    sums = streams.mapInArrow(_dense, _SUM).repartition(parts, "shard").mapInArrow(_summed, _SUM)
    return written(functions.join(sums, "shard"), "pair-counts")


def _best(tables: DataFrame, vocabulary_b: int) -> np.ndarray:
    """The highest count of any pair of each id of B."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(vocabulary_b, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                np.maximum.at(best, np.frombuffer(keys, np.int64) % vocabulary_b, np.frombuffer(counts, np.int64))
        yield _batch([best.tobytes()], names=["best"], kinds=[pa.binary()])

    best = np.zeros(vocabulary_b, np.int64)
    for row in tables.select("keys", "counts").coalesce(8).mapInArrow(run, "best binary").collect():  # eight vectors of one vocabulary
        best = np.maximum(best, np.frombuffer(row["best"], np.int64))
    return best


class Counts:
    """Lookup tables of some shards."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes, bytes]]):
        self._of = {
            shard: (PerfectHash.read(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64)), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64))
            for shard, sizes, words, keys, counts in rows
        }

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each distinct pair; 0 for those of other shards."""
        found, shard = np.zeros(len(pairs), np.int64), shard_of(pairs)
        for own, (function, keys, counts) in self._of.items():
            here = np.flatnonzero(shard == own)
            if len(here):
                place = function(pairs[here])
                if (place < 0).any() or (keys[place] != pairs[here]).any():
                    raise ValueError("a pair of the second pass was not counted in the first")
                found[here] = counts[place]
        return found


_ALIGNED = "doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _looked_up(rows: DataFrame, tokenizers: tuple[str, str, str], counts: Counts, best: np.ndarray, last: bool) -> DataFrame:
    """Adds what the given shards tell to n_best and count_sum; the last pass writes the groups and drops the ids."""
    shared = rows.sparkSession.sparkContext.broadcast((counts, best))
    schema = _ALIGNED.replace("a binary, b binary, ", "") if last else _ALIGNED.replace(", groups string", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, (looked, highest) = _sides(*tokenizers), shared.value
        for batch in _slices(batches):
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            encoded = [(np.frombuffer(a, sides.kind_a), np.frombuffer(b, sides.kind_b)) for a, b in zip(*ids)]
            own = Aligned.of(encoded, sides)
            distinct, which = np.unique(own.pairs(len(sides.bytes_b)), return_inverse=True)
            count = looked(distinct)[which.ravel()]
            document, n = own.documents(), len(encoded)
            links = np.bincount(document, minlength=n)
            is_best = (count > 0) & (count == highest[own.ids_b[own.at_b]])
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], document, is_best)
            np.add.at(sums[1], document, count)
            sums += np.array([batch.column("n_best").to_pylist(), batch.column("count_sum").to_pylist()], np.int64).reshape(2, n)
            columns = [batch.column("doc_id")] + [pa.array(x, pa.int64()) for x in (own.n_a, own.n_b, links, links, *sums)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
            if last:
                columns.append(pa.array(own.groups(sides), pa.string()))
                names.append("groups")
            else:
                columns[1:1], names[1:1] = [batch.column("a"), batch.column("b")], ["a", "b"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def _first_pass(docs: DataFrame, tokenizers: tuple[str, str, str], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(_encoded(rows, tokenizers), "token-ids", by=["kind"])
    return table.where("kind = 0").select("doc_id", "a", "b"), _count_tables(table.where("kind = 1"))


def pair_counts(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, count): the links of all documents per pair of ids."""
    _, tables = _first_pass(docs, (path_a, pattern, path_b), id_col, text_col)
    size = len(piece_table(path_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                a, b = np.divmod(np.frombuffer(keys, np.int64), size)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.frombuffer(counts, np.int64))], ["id_a", "id_b", "count"])

    return tables.select("keys", "counts").mapInArrow(run, "id_a long, id_b long, count long")


def aligned(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``)."""
    tokenizers = (path_a, pattern, path_b)
    rows, tables = _first_pass(docs, tokenizers, id_col, text_col)
    best = _best(tables, len(piece_table(path_b)))
    sizes = tables.select("shard", sum((F.octet_length(c) for c in ("sizes", "words", "keys", "counts")), F.lit(0).cast("long")).alias("size"))
    groups, room = [[]], MOST_BYTES
    for shard, size in sorted(map(tuple, sizes.collect())):
        if groups[-1] and size > room:
            groups.append([])
            room = MOST_BYTES
        groups[-1].append(shard)
        room -= size
    rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("n_best", "count_sum")})
    for nth, group in enumerate(groups, 1):
        own = [tuple(r) for r in tables.where(F.col("shard").isin(group)).select("shard", "sizes", "words", "keys", "counts").collect()]
        rows = _looked_up(rows, tokenizers, Counts(own), best, last=nth == len(groups))
        rows = rows if nth == len(groups) else written(rows, "partly-looked-up").select("doc_id", "a", "b", "n_best", "count_sum")
    return rows
