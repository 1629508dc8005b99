"""Quality scores by histogram gradient-boosted trees over document statistics.

The trees are fitted on at most about ``TRAINING_ROWS`` labelled rows (chosen by the hash of their ids, at every input
size) and flattened into arrays, so that a batch is scored by vectorised traversal. Scoring reads every whole text once,
without a shuffle.

Defined results: a null text is scored as an empty one; labels that are null, or whose document is missing, are not
learned from; without labels of both kinds every score is the share of label 1 (0.5 without any); repeated rows get the
same score; other columns pass through unread and are replaced if they are named like the scores.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pricebase.llm.common import giving_back, hash_sample, prepared, unused

#: Bound of the training sample.
TRAINING_ROWS = 24_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 60, 4, 0.15, 64, 20, 1.0
#: Score from which a document counts as good.
THRESHOLD = 0.3

_SYMBOLS = b"*#$%&@^~|<>{}[]\\/_=+!?"


def statistics(text: str) -> list[float]:
    """Numbers about one whole text; none depends on its language, source or id."""
    raw = text.encode()
    size = len(raw) or 1
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n = len(words) or 1
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    frequent = seen.most_common(1)[0][1] if seen else 0
    repeats = sum(map(str.__eq__, words, words[1:]))
    marked = sum(not w[-1].isalnum() for w in words)
    shouted = sum(map(str.isupper, words))
    share = counts[counts > 0] / size
    return [
        math.log1p(size),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        float(lengths.mean()),
        float(lengths.max()),
        float(lengths.std()),
        len(seen) / n,
        len(seen) / math.sqrt(n),
        frequent / n,
        repeats / n,
        marked / n,
        shouted / n,
        sum(map(str.istitle, words)) / n,
        1 - len(set(lines)) / len(lines),
        max(map(len, lines)) / size,
        float(-(share * np.log2(share)).sum()),
        counts[65:91].sum() / size,
        counts[97:123].sum() / size,
        counts[48:58].sum() / size,
        counts[128:].sum() / size,
        (counts[32] + counts[9] + counts[10] + counts[13]) / size,
        counts[list(_SYMBOLS)].sum() / size,
        counts[33] / size,
        counts[124] / size,
        counts[[46, 63]].sum() / n,
        counts[44] / n,
    ]


N_FEATURES = len(statistics(""))


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return _flattened(math.log((share * 0.98 + 0.01) / (1 - share * 0.98 - 0.01)), [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    cells = binned + np.arange(x.shape[1]) * BINS
    base = math.log(share / (1 - share))
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_tree(binned, cells, edges, y - p, p * (1 - p), margin))
    return _flattened(base, trees)


def _tree(binned, cells, edges, gradient, hessian, margin) -> list[list[float]]:
    """Nodes [feature, threshold, left, right, value] grown level by level; adds the leaves to ``margin``."""
    nodes, width = [[0, 0.0, 0, 0, 0.0]], cells.shape[1] * BINS
    place, level = np.zeros(len(cells), np.int64), [0]
    for depth in range(DEPTH + 1):
        slot = {node: i for i, node in enumerate(level)}
        index = np.full(len(nodes), -1)
        index[level] = range(len(level))
        own = index[place]
        rows = np.flatnonzero(own >= 0)
        flat = (own[rows, None] * width + cells[rows]).ravel()
        sums = [
            np.bincount(flat, np.repeat(v, cells.shape[1]), len(level) * width).reshape(len(level), -1, BINS)
            for v in (gradient[rows], hessian[rows], np.ones(len(rows)))
        ]
        following = []
        for node in level:
            g, h, n = (s[slot[node]] for s in sums)
            total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
            nodes[node] = [0, math.inf, node, node, RATE * total_g / (total_h + L2)]
            if depth == DEPTH:
                continue
            lg, lh, ln = g.cumsum(1), h.cumsum(1), n.cumsum(1)
            gain = lg**2 / (lh + L2) + (total_g - lg) ** 2 / (total_h - lh + L2) - total_g**2 / (total_h + L2)
            gain[(ln < LEAST_LEAF) | (total_n - ln < LEAST_LEAF)] = 0
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                continue
            left, right = len(nodes), len(nodes) + 1
            nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
            nodes[node] = [int(f), float(edges[f][b]), left, right, 0.0]
            inside = place == node
            place[inside] = np.where(binned[inside, f] <= b, left, right)
            following += [left, right]
        level = following
        if not level:
            break
    margin += np.array([n[4] for n in nodes])[place]
    return nodes


def _flattened(base: float, trees: list[list[list[float]]]) -> Trees:
    roots, rows, start = [], [], 0
    for nodes in trees:
        roots.append(start)
        rows += [[f, t, left + start, right + start, v] for f, t, left, right, v in nodes]
        start += len(nodes)
    columns = np.array(rows, float).reshape(-1, 5).T
    whole = [c.astype(np.int64) for c in (columns[0], columns[2], columns[3])]
    return Trees(base, np.array(roots, np.int64), whole[0], columns[1], whole[1], whole[2], columns[4])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Trees:
    """Trees fitted on about ``rows`` labelled documents, none of them held out."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    chosen = F.broadcast(hash_sample(known.where(~held_out()), ["doc_id"], rows))  # bounded by ``rows``
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("quality")], ["doc_id", "x", "y"]
            )

    sample = texts.select("doc_id", "text", "quality").mapInArrow(giving_back(run), "doc_id long, x array<double>, y double").toArrow()
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    x = np.array(sample["x"].combine_chunks().flatten(), float).reshape(-1, N_FEATURES)
    return fit(x[order], (sample["y"].to_numpy() > 0).astype(float)[order])


def score(
    docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted"
) -> DataFrame:
    """All columns of ``docs``, then the score and the prediction."""
    prepared(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in (score_col, predicted_col)]
    schema = StructType(fields + [StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, N_FEATURES)
            scores = trees.score(x)
            predicted = (scores >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.array(scores), pa.array(predicted)], [f.name for f in schema.fields]
            )

    return docs.select(*[f.name for f in fields]).mapInArrow(giving_back(run), schema)


def remainder(doc_id: object) -> int:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 5


def good_documents(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that are predicted to be good."""
    scores, predicted = unused(docs.columns, "own_score", "own_predicted")
    scored = score(docs, trees, threshold, scores, predicted)
    return scored.where(F.col(predicted) == 1).drop(scores, predicted)
