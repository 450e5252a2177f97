"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, taken by hash of the id), and kept as flat
arrays: every tree is a full binary tree, so a step down is one comparison for all documents and all trees of a batch.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import held_out, per_batch, texts_of, utf8

#: most labelled rows that the trees are fitted on
TRAIN_ROWS = 30_000
TREES, DEPTH, RATE, BINS, L2, LEAST_HESSIAN = 60, 4, 0.15, 64, 1.0, 2.0
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
#: groups of bytes whose share of a text is a statistic
BYTE_GROUPS = (tuple(_UPPER), tuple(_LOWER), tuple(_DIGIT), tuple(b" "), tuple(b"\n"), tuple(b".,"), tuple(b"#*$%&|<>"), tuple(b"!"),
               tuple(b"?;:'\"()-"), tuple(b"=_{}[]\\/~^`@+"), tuple(range(128, 256)))
N_STATS = len(BYTE_GROUPS) + 11


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text: size, shares of byte groups, words, repetition, lines. All are finite; 0 where undefined."""
    size = len(text)
    if not size:
        return [0.0] * N_STATS
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = count[count > 0] / size
    words = text.split()
    n = len(words)
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same_next = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return [
        math.log1p(size), math.log1p(n), (size - n) / max(n, 1), len(tally) / max(n, 1), max(tally.values(), default=0) / max(n, 1),
        same_next / max(n, 1), ends / max(n, 1), len(set(lines)) / max(len(lines), 1), math.log1p(len(lines)),
        len(zstandard.compress(text, 1)) / size, float(-(share * np.log2(share)).sum()),
        *(float(count[list(g)].sum()) / size for g in BYTE_GROUPS),
    ]


@dataclass
class Trees:
    """Trees as arrays (tree, node): inner nodes of a full tree from the root down, then its leaves."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + math.exp(-self.start)))
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        depth = int(math.log2(self.leaf.shape[1]))
        for _ in range(depth):
            right = x[rows, self.feature[trees, node]] > self.limit[trees, node]
            node = 2 * node + 1 + right
        total = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with histograms of at most BINS bins; no rows or one class give the class share alone."""
    good, n = float(y.sum()), len(y)
    start = math.log((good + 0.5) / (n - good + 0.5))
    inner, feats = 2 ** DEPTH - 1, x.shape[1]
    if n == 0 or good in (0, n):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(feats)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(feats) * BINS
    total = np.full(n, start)
    feature, limit, leaf = (np.zeros((TREES, k)) for k in (inner, inner, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, first = 2 ** level, 2 ** level - 1
            place = ((node - first)[:, None] * (feats * BINS) + flat).ravel()
            size = width * feats * BINS
            g = np.bincount(place, np.repeat(grad, feats), size).reshape(width, feats, BINS).cumsum(axis=2)
            h = np.bincount(place, np.repeat(hess, feats), size).reshape(width, feats, BINS).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g ** 2 / (all_h + L2)
            gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            splits = gain.reshape(width, -1).max(axis=1) > 1e-9
            for k in range(width):
                has = splits[k] and b[k] < len(edges[f[k]])
                feature[t, first + k] = f[k] if has else 0
                limit[t, first + k] = edges[f[k]][b[k]] if has else np.inf  # a node without a split sends all to the left
            at = feature[t, node].astype(np.int64)
            node = 2 * node + 1 + (x[np.arange(n), at] > limit[t, node])
        own = node - inner
        g, h = np.bincount(own, grad, inner + 1), np.bincount(own, hess, inner + 1)
        leaf[t] = -RATE * g / (h + L2)
        total += leaf[t][own]
    return Trees(feature.astype(np.int64), limit, leaf, start)


def _stats_of(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in utf8(column)], np.float64).reshape(-1, N_STATS)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents that are not held out.

    A document labelled twice counts with its smaller label; NULL ids and labels are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    sample = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the sample is bounded by ``rows``
    labelled = texts_of(docs).join(F.broadcast(sample), "doc_id")

    def step(batch):
        x = _stats_of(batch["text"])
        return {"doc_id": batch["doc_id"], "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float64())),
                "y": batch["y"].cast(pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = per_batch(labelled, step, f"doc_id {kind}, x array<double>, y double").toArrow().sort_by("doc_id")
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_STATS)
    return fit_trees(x, found["y"].to_numpy())


def score_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    A NULL text is empty; an empty text has a score too. Repeated rows and NULL ids are kept; an empty table gives no
    rows; without usable labels every score is one half.
    """
    rows = texts_of(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = per_batch(rows, lambda batch: {"doc_id": batch["doc_id"], "score": pa.array(trees.score(_stats_of(batch["text"])))},
                       f"doc_id {kind}, score double", rows=1000)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` without the rows that the trees reject: those of a score below THRESHOLD; a score equal to it stays.

    A NULL text scores as an empty one and, like any short text, stays or goes by its score; rows of equal text stay or
    go together, whatever their ids; without usable labels every score is one half and all rows stay. Columns may have
    any name and type. An empty table gives no rows.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(trees.score(_stats_of(texts.fill_null(""))))

    return docs.filter(score("text") >= THRESHOLD)
