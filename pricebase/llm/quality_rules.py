"""Quality rules: counted base rules, then a hashed n-gram logistic regression against a fixed threshold.

The model weighs hashed word n-grams and character n-grams. Every kind of n-gram contributes the mean weight of its
occurrences, so a text of any length is scored whole by gathering weights. It is fitted by adaptive gradient steps on at
most about ``TRAINING_ROWS`` labelled documents (chosen by the hash of their ids, the same at every input size); a fold of
them that the weights never see turns margins into probabilities (a logistic curve in the margin). Scoring passes over
the documents once, in Arrow batches, without a shuffle.

Defined results: a null text has no words and fails the base rules; labels that are null or whose document is missing are
not learned from; without labels of both kinds every probability is the share of label 1 (0.5 without any); repeated rows
get the same verdict; other columns pass through unread and are replaced if they are named like an added one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from pricebase.llm.common import hash_sample, prepared

#: Bound of the training sample, its calibration fold included.
TRAINING_ROWS = 6_000
#: Hash buckets, word n-grams and character n-grams of the model.
BUCKETS, WORD_GRAMS, CHARACTER_GRAMS = 1 << 16, (1, 2), (2, 3)
EPOCHS, BATCH, RATE, SHRINK = 6, 128, 0.5, 1e-6
#: crc32 of the id modulo FOLDS: fold 0 is never learned from, fold 1 calibrates.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: A document is kept from this probability on, with at least so many words and at most this share of repeated ones.
KEEP_FROM, LEAST_WORDS, MOST_REPEATED_PERCENT = 0.3, 50, 50

_WHITE, _SYMBOLS = [9, 10, 11, 12, 13, 32], list(b"#*$%&|<>")
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
KINDS = len(WORD_GRAMS) + len(CHARACTER_GRAMS)


def repeated_words(codes: np.ndarray) -> int:
    """Words in a window of three that is found twice or more; the codes tell words apart."""
    if len(codes) < 4:
        return 0
    pairs = np.unique(codes[:-1] * (int(codes.max()) + 1) + codes[1:], return_inverse=True)[1].ravel()
    windows = pairs[:-1] * (int(codes.max()) + 1) + codes[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which.ravel()] > 1
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[k : len(again) + k] |= again
    return int(inside.sum())


@dataclass(frozen=True)
class Read:
    """One text: its base counts and what its n-grams are hashed from."""

    counts: tuple[int, int, int, int, int]
    words: np.ndarray
    characters: np.ndarray

    def grams(self) -> list[np.ndarray]:
        """The bucket of every n-gram occurrence, per kind."""
        found = []
        for units, sizes in ((self.words, WORD_GRAMS), (self.characters, CHARACTER_GRAMS)):
            for n in sizes:
                hashed = np.full(max(len(units) - n + 1, 0), np.uint64(len(found) + 1)) * _MIX2
                for k in range(n):
                    hashed = (hashed ^ units[k : k + len(hashed)]) * _MIX
                    hashed ^= hashed >> np.uint64(29)
                found.append((hashed >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1))
        return found


def read(text: str | None) -> Read:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes: words end at 0x20 and 0x09-0x0D alone
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    counts = (
        len(words), len(text) - int(per_byte[_WHITE].sum()), int(per_byte[_SYMBOLS].sum()),
        len(lines) - len(set(lines)), repeated_words(codes),
    )
    return Read(counts, hashes[codes], np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64))


def fails_base(counts: tuple[int, int, int, int, int]) -> bool:
    n_words, _, _, _, n_repeat = counts
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED_PERCENT * n_words


@dataclass(frozen=True)
class Model:
    """Weights of all buckets, and the curve that turns a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, grams: list[np.ndarray]) -> float:
        return self.bias + sum(float(self.weights[g].mean()) for g in grams if len(g))

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def shares(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares, summed over the kinds: the sparse row whose product with the weights is the margin."""
    if not any(map(len, grams)):
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    parts = np.concatenate([np.full(len(g), 1 / max(len(g), 1)) for g in grams])
    buckets, which = np.unique(np.concatenate(grams), return_inverse=True)
    return buckets.astype(np.uint16), np.bincount(which.ravel(), parts).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, calibrates: np.ndarray) -> Model:
    """A model of the rows (buckets, shares) with labels 0 or 1; rows that calibrate only shape the curve."""
    learned = np.flatnonzero(~calibrates)
    share = float(y.mean()) if len(y) else 0.5
    if not len(learned) or not 0 < y[learned].mean() < 1:
        base = share * 0.98 + 0.01
        return Model(np.zeros(BUCKETS), 0.0, 0.0, math.log(base / (1 - base)))
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    bias = math.log(y[learned].mean() / (1 - y[learned].mean()))
    # both labels weigh the same
    heavy = np.where(y > 0, 0.5 / y[learned].mean(), 0.5 / (1 - y[learned].mean()))
    rng = np.random.default_rng(0)
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(learned), max(1, len(learned) // BATCH)):
            buckets = np.concatenate([rows[i][0] for i in batch]).astype(np.int64)
            values = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            margins = bias + np.bincount(owner, weights[buckets] * values, len(batch))
            error = (1 / (1 + np.exp(-np.clip(margins, -40, 40))) - y[batch]) * heavy[batch]
            gradient = np.bincount(buckets, values * error[owner], BUCKETS) / len(batch) + SHRINK * weights
            squares += gradient**2
            weights -= RATE * gradient / np.sqrt(squares)
            bias -= 0.05 / (1 + epoch) * float(error.mean())
    held = np.flatnonzero(calibrates) if 0 < y[calibrates].sum() < calibrates.sum() else learned
    margins = np.array([bias + float(weights[rows[i][0].astype(np.int64)] @ rows[i][1]) for i in held])
    return Model(weights, bias, *_curve(margins, y[held]))


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by damped Newton steps; smoothed targets keep them finite."""
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        at = at + np.clip(step, -2, 2)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (0.0, float(np.log(target.mean() / (1 - target.mean()))))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """The model of about ``rows`` labelled documents outside the held-out fold."""
    prepared(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    known = known.withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
    chosen = F.broadcast(hash_sample(known, ["doc_id"], rows))  # bounded by ``rows``
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality", "fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shares(read(t).grams()) for t in batch.column("text").to_pylist()]
            packed = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *packed, batch.column("quality"), batch.column("fold")], ["doc_id", "buckets", "shares", "y", "fold"]
            )

    schema = "doc_id long, buckets binary, shares binary, y double, fold long"
    sample = texts.mapInArrow(run, schema).toArrow()
    order = np.lexsort((np.array(sample["buckets"].to_pylist(), object), sample["doc_id"].to_numpy())) if sample.num_rows else []
    sparse = list(zip(sample["buckets"].to_pylist(), sample["shares"].to_pylist()))
    sparse = [(np.frombuffer(sparse[i][0], np.uint16), np.frombuffer(sparse[i][1], np.float32)) for i in order]
    y = (sample["y"].to_numpy() > 0).astype(float)[order] if len(order) else np.zeros(0)
    return fit(sparse, y, (sample["fold"].to_numpy() == CALIBRATION)[order] if len(order) else np.zeros(0, bool))


_ADDED = [
    *[StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    StructField("base_failed", BooleanType()), StructField("probability", DoubleType()), StructField("kept", BooleanType()),
]


def judge(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of ``docs``, then the base counts, base_failed, probability and kept."""
    spark = prepared(docs.sparkSession)
    added = {f.name for f in _ADDED}
    fields = [f for f in docs.schema.fields if f.name.lower() not in added]
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [read(t) for t in batch.column("text").to_pylist()]
            margins = np.array([own.margin(x.grams()) for x in found], float)
            probability = own.probability(margins)
            failed = np.array([fails_base(x.counts) for x in found], bool)
            counts = np.array([x.counts for x in found], np.int64).reshape(-1, 5).T
            columns = [*map(pa.array, counts), pa.array(failed), pa.array(probability), pa.array(~failed & (probability >= keep_from))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + columns, [f.name for f in fields] + [f.name for f in _ADDED]
            )

    return docs.select(*[f.name for f in fields]).mapInArrow(run, StructType(fields + _ADDED))
