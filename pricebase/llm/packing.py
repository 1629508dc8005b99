"""Best-fit packing of token pieces into sequences by a configuration linear program.

The histogram of piece lengths, at most ``capacity`` numbers, is all that reaches the driver. The configuration program
(how often each way to fill one sequence is used, every length covered) is solved by multiplicative weights: the price of
a length falls as its covered share grows, and a knapsack by dynamic programming prices fillings, for every length the
best that holds it. The sums of the rounds are scaled to a feasible cover, whose gap to the bound of the prices ends the
rounds. It is rounded, solved again for the pieces that rounding leaves, and best fit places the last ones. Best fit is
tried after every such stage, and the stage with the fewest sequences stays, so there are never more than with best fit alone.

Spark does the rest: pieces are numbered within their length from counts per task, and the numbers of a length are
dealt to the fillings in order, so places follow by arithmetic, whatever the size of a length's group.

Defined results: a null or empty text is one piece holding the closing id; only texts longer than the capacity are cut,
with a shorter first piece; null ids are kept; repeated rows are packed separately; no rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebase.llm.byte_bpe import encoder
from pricebase.llm.common import giving_back, prepared, written

#: Most rounds of multiplicative weights (halved each time the remainder is solved again), how often that is, the share of a
#: length's count that a round may cover, how fast a price falls, how near the best price a used filling comes, and the
#: gap between a cover and its bound that is small enough; and the preference for long pieces (hard to place later).
ROUNDS, REPEATS, STEP, FALL, NEAR, GAP, TILT = 160, 4, 0.3, 0.3, 0.01, 0.005, 0.02

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first may be shorter."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int, closing_id: int, added_tokens: bool = False) -> DataFrame:
    """Pieces of the encoded documents, numbered within task and length."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    closing = closing_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = encoder(path, pattern, added_tokens), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(own.encode(text) + closing)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        own.forget()

    return rows.mapInArrow(giving_back(run), _PIECES)


class Program:
    """The covering program of a histogram: fillings with at most as many pieces of a length as there are, every length covered."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.counts, self.capacity = lengths, counts, capacity
        self.most = np.minimum(counts, capacity // lengths)
        parts = []  # a length's copies as 1, 2, 4, ... and the rest: each part is taken or not
        for k, most in enumerate(self.most.tolist()):
            size = 1
            while most > 0:
                parts.append((k, min(size, most)))
                most, size = most - size, size * 2
        self.part, self.copies = np.array(parts, np.int64).T
        self.material = float((lengths * counts).sum()) / capacity

    def good_fillings(self, prices: np.ndarray, behind: np.ndarray, rng: np.random.Generator) -> tuple[list[dict[int, int]], float]:
        """A filling of the greatest price, for every length the best one that holds it if its price is near that, lengths
        most behind first; and the greatest price. One knapsack serves them all; ties fall by the order of the parts."""
        order = rng.permutation(len(self.part))
        sizes = self.lengths[self.part] * self.copies
        value, taken = np.zeros(self.capacity + 1), np.zeros((len(order), self.capacity + 1), bool)
        for at, i in enumerate(order.tolist()):
            size = int(sizes[i])
            more = value[: self.capacity + 1 - size] + prices[self.part[i]] * self.copies[i]
            np.greater(more, value[size:] + 1e-12, out=taken[at, size:])
            np.maximum(value[size:], more, out=value[size:])
        top = float(value[-1])
        held = np.flatnonzero(prices + value[self.capacity - self.lengths] >= (1 - NEAR) * top)
        held = held[np.argsort(behind[held], kind="stable")]
        room = np.concatenate([[self.capacity], self.capacity - self.lengths[held]])
        found: list[dict[int, int]] = [{}, *({k: 1} for k in held.tolist())]
        for at in range(len(order) - 1, -1, -1):
            if len(rows := np.flatnonzero(taken[at][room])):
                i = int(order[at])
                room[rows] -= sizes[i]
                k, n = int(self.part[i]), int(self.copies[i])
                for row in rows.tolist():
                    found[row][k] = found[row].get(k, 0) + n
        return [f for f in found if f and all(n <= self.most[k] for k, n in f.items())], top

    def cover(self, rounds: int) -> tuple[dict[tuple, float], float, float]:
        """Fillings and how often each is used, the value of the cover they belong to, and a lower bound of all covers.

        Multiplicative weights: a length's price falls with its covered share. In a round no length gets more than ``STEP``
        of its count. The sums of all rounds are scaled down; what a length then lacks is covered by fillings of its own.
        """
        rng = np.random.default_rng(len(self.lengths))
        covered, done, used = np.zeros(len(self.lengths)), 0.0, Counter()
        bound, value, scale = self.material, np.inf, 1.0
        for nth in range(1, rounds + 1):
            share = covered / self.counts
            prices = self.lengths / self.capacity * (1 + TILT * self.lengths / self.capacity) * np.exp(np.clip(FALL * (done / self.material - share), -4, 4))
            found, top = self.good_fillings(prices, share, rng)
            bound = max(bound, float((self.counts * prices).sum()) / top)  # prices / top are feasible in the dual
            room = STEP * self.counts
            for filling in found:
                if (amount := min(room[k] / n for k, n in filling.items())) > 1e-9:
                    for k, n in filling.items():
                        room[k] -= amount * n
                        covered[k] += amount * n
                    used[tuple(sorted(filling.items()))] += amount
                    done += amount
            if nth % 10 == 0 or nth == rounds:
                tried = [s for s in np.quantile(covered / self.counts, (0, 0.02, 0.05, 0.1, 0.2, 0.4)) if s > 0]
                lacks = [float((np.maximum(0, self.counts - covered / s) / (self.capacity // self.lengths)).sum()) for s in tried]
                if tried:
                    value, scale = min((done / s + lack, s) for s, lack in zip(tried, lacks))
                if value <= (1 + GAP) * bound:
                    break
        return {f: x / scale for f, x in used.items()}, value, bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Counter:
    """Fillings for the last pieces: the longest first, then always the longest that still fits."""
    left, made = counts.copy(), Counter()
    while left.any():
        filling, room = Counter(), capacity
        while room:
            fits = np.flatnonzero((left > 0) & (lengths <= room))
            if not len(fits):
                break
            at = int(fits[-1])
            take = min(int(left[at]), room // int(lengths[at]))
            filling[at] += take
            left[at] -= take
            room -= take * int(lengths[at])
        # the same filling as often as its pieces last
        again = min(int(left[k]) // n for k, n in filling.items())
        for k, n in filling.items():
            left[k] -= n * again
        made[tuple(sorted(filling.items()))] += 1 + again
    return made


def rounded(cover: dict[tuple, float], left: np.ndarray) -> Counter:
    """Whole numbers of the fillings, out of the pieces left (which it lowers): whole parts first, then one for each
    remaining fraction while its pieces last, the greatest first."""
    made: Counter = Counter()

    def take(filling: tuple, times: int) -> None:
        if (times := min(times, *(int(left[k]) // n for k, n in filling))) > 0:
            for k, n in filling:
                left[k] -= times * n
            made[filling] += times

    largest = sorted(cover, key=lambda f: (-cover[f], f))
    for filling in largest:
        take(filling, int(cover[filling]))
    for filling in sorted(largest, key=lambda f: -(cover[f] % 1)):
        take(filling, 1)
    return made


def stages(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Iterator[tuple[Counter, np.ndarray]]:
    """Fillings that the program gives and the pieces left: none yet, then after each time it is solved for what rounding left."""
    left, made = counts.copy(), Counter()
    yield made.copy(), left.copy()
    for repeat in range(REPEATS):
        open_at = np.flatnonzero(left)
        if not len(open_at):
            break
        own = left[open_at]
        cover, _, _ = Program(lengths[open_at], own, capacity).cover(ROUNDS >> repeat)
        own = own.copy()
        for filling, times in rounded(cover, own).items():
            made[tuple((int(open_at[k]), n) for k, n in filling)] += times
        left[open_at] = own
        yield made.copy(), left.copy()


def solved(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[Counter, Counter]:
    """The program's fillings and those of best fit for the rest, at the stage with the fewest in all; of equal ones, the last."""
    best, fewest = (Counter(), Counter()), None
    for made, left in stages(lengths, counts, capacity):
        rest = best_fit(lengths, left, capacity)
        total = made.total() + rest.total()
        if fewest is None or total <= fewest:
            best, fewest = (made, rest), total
    return best


def fillings(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of one sequence, number of such sequences), using every piece once."""
    lengths = np.array(sorted(k for k in histogram if histogram[k] > 0), np.int64)
    counts = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    made, rest = solved(lengths, counts, capacity)
    made.update(rest)
    return [({int(lengths[k]): n for k, n in key}, times) for key, times in made.items()]


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first number, copies in a sequence, first sequence and offset of every filling that holds it."""
    found: dict[int, list] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for length, n in sorted(filling.items(), reverse=True):
            rows = found.setdefault(length, [])
            first = rows[-1][0] + rows[-1][1] * rows[-1][4] if rows else 0
            rows.append((first, n, sequence, offset, times))
            offset += length * n
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*rows)) for k, rows in found.items()}


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, closing_id: int = 0, added_tokens: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. With ``added_tokens``, a text that spells an
    added token of the tokenizer holds its id, as ``Tokenizer.encode`` has it; else it is ordinary text."""
    spark = prepared(docs.sparkSession)
    pieces = written(token_pieces(docs, path, pattern, capacity, closing_id, added_tokens), "pieces")
    counts = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(fillings(histogram, capacity)))  # bounded by the capacity

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["task", "length"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.col("nth")).alias("number")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                firsts, copies, sequences, offsets, _ = places.value[int(value)]
                row = np.searchsorted(firsts, number[at], side="right") - 1
                inside = number[at] - firsts[row]
                sequence[at] = sequences[row] + inside // copies[row]
                offset[at] = offsets[row] + inside % copies[row] * value
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(
        giving_back(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
