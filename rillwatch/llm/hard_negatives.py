"""Hard-negative mining with angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. For an anchor a and a row v, the angle between
them is at least the largest |angle(a, r) - angle(v, r)| and at most the smallest of the sums (or 2 pi minus the sum)
over the references r. The cosines of both ends, times the norms, widened by more than rounding can take away, bound
the score. Blocks of rows, then single rows, whose bounds miss every window that is still open get no integer score.

Anchors are a stated set of queries: they are taken in blocks of bounded size, and each block passes over all rows. No
vector is shuffled, so a label, or a vector, that a third of all rows share is dealt out as the table's files are.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwatch.llm.tables import per_batch, staged
from rillwatch.llm.vectors import integer_vectors, unpack
from rillwatch.session import run_dir

#: reference directions, and the rows (of smallest id hash) among which they are chosen
REFERENCES, SAMPLE = 16, 512
#: anchors that pass over the table at once; anchors and rows that meet at once in a task
BLOCK, ANCHOR_ROWS, ROWS = 4096, 512, 1024
#: two angles held as 32-bit floats, with their difference or sum, are off by less than the first; relative to both
#: norms, cosines are off by less than the second
ANGLE_SLACK, SCORE_SLACK = np.float32(4e-6), 1e-6
_NONE = -(1 << 62)


class Block(NamedTuple):
    """Rows side by side: ids, labels, integer vectors, norms, angles to the references."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    def part(self, chosen) -> Block:
        return Block(*(c[chosen] for c in self))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and their norms; a row of zeros stays."""
    x = x.astype(np.float64)
    norms = np.sqrt(np.square(x).sum(axis=1))
    return x / np.where(norms > 0, norms, 1.0)[:, None], norms


def angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to the references. A row of zeros, whose scores are all 0, gets right angles."""
    u, norms = unit(x)
    return norms, np.arccos(np.clip(u @ references.T, -1, 1)).astype(np.float32)


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` directions among the rows of ``x``, each next one the farthest from those before it."""
    u = unit(x[np.any(x, axis=1)])[0]
    chosen, near = [], np.full(len(u), -np.inf)
    while len(chosen) < min(k, len(u)):
        at = int(near.argmin())
        chosen.append(at)
        near = np.maximum(near, u @ u[at])
    return u[chosen].reshape(len(chosen), x.shape[1])


def _scores(cosine: np.ndarray, norms_a, norms_low, norms_high, up: bool) -> np.ndarray:
    """A bound on cosine times both norms, widened and rounded outwards."""
    outer = norms_high if up else norms_low
    inner = norms_low if up else norms_high
    product = norms_a * np.where(cosine >= 0, outer, inner)
    slack = SCORE_SLACK * norms_a * norms_high + 1
    return np.ceil(cosine * product + slack) if up else np.floor(cosine * product - slack)


def _least_and_most(gap, wide, norms_a, norms_low, norms_high):
    low = _scores(np.cos(np.minimum(wide + ANGLE_SLACK, np.float32(math.pi))), norms_a, norms_low, norms_high, False)
    return low, _scores(np.cos(np.maximum(gap - ANGLE_SLACK, 0)), norms_a, norms_low, norms_high, True)


def block_bounds(a: Block, rows: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score of each anchor with any row of the block."""
    if not a.angles.shape[1]:
        most = np.ceil(a.norms * rows.norms.max() * (1 + SCORE_SLACK) + 1)
        return -most, most
    first, last = rows.angles.min(axis=0), rows.angles.max(axis=0)
    gap = np.maximum(np.maximum(first - a.angles, a.angles - last).max(axis=1), 0)
    wide = np.minimum(a.angles + last, np.float32(2 * math.pi) - a.angles - first).min(axis=1)
    return _least_and_most(gap, wide, a.norms, rows.norms.min(), rows.norms.max())


def pair_bounds(a: Block, rows: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score of each anchor with each row."""
    gap = np.zeros((len(a.ids), len(rows.ids)), np.float32)
    wide = np.full_like(gap, math.pi)
    for mine, theirs in zip(a.angles.T[:, :, None], rows.angles.T[:, None, :]):
        np.maximum(gap, np.abs(mine - theirs), out=gap)
        total = mine + theirs
        np.minimum(wide, total, out=wide)
        np.minimum(wide, np.float32(2 * math.pi) - total, out=wide)
    return _least_and_most(gap, wide, a.norms[:, None], rows.norms, rows.norms)


def integer_scores(a: Block, rows: Block) -> np.ndarray:
    """Inner products, exact: as doubles where no sum can pass 2^53, else as Python's integers (they must fit a long)."""
    if not len(a.ids) or a.norms.max() * rows.norms.max() < 2.0 ** 52:
        return (a.x.astype(np.float64) @ rows.x.astype(np.float64).T).astype(np.int64)
    return (a.x.astype(object) @ rows.x.astype(object).T).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each window of each anchor: high scores first, then small ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k, self.shape = low.ravel(), high.ravel(), k, low.shape
        self.score = np.full((low.size, k), _NONE, np.int64)
        self.id = np.full((low.size, k), np.iinfo(np.int64).max, np.int64)

    def least(self, anchors) -> np.ndarray:
        """Scores below this change no window (anchor, window)."""
        return np.maximum(self.low, self.score[:, -1]).reshape(self.shape)[anchors]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        own = np.unique(group)
        group = np.concatenate([np.repeat(own, self.k), group])
        score = np.concatenate([self.score[own].ravel(), score])
        ids = np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, -score, group))
        group = group[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        order, group, rank = order[rank < self.k], group[rank < self.k], rank[rank < self.k]
        self.score[group, rank], self.id[group, rank] = score[order], ids[order]

    def found(self) -> tuple[np.ndarray, ...]:
        """(anchor, window, score, id) of all that was kept."""
        group, rank = np.nonzero(self.score != _NONE)
        return group // self.shape[1], group % self.shape[1], self.score[group, rank], self.id[group, rank]


def meet(a: Block, rows: Block, best: Best, same: bool) -> int:
    """Takes rows of the same label (not the anchor's id), or of other labels, into ``best``; returns how many pairs were scored."""
    scored = 0
    high = best.high.reshape(best.shape)
    for at in range(0, len(a.ids), ANCHOR_ROWS):
        anchors = np.arange(at, min(at + ANCHOR_ROWS, len(a.ids)))
        low, most = block_bounds(a.part(anchors), rows)
        anchors = anchors[((most[:, None] >= best.least(anchors)) & (low[:, None] <= high[anchors])).any(axis=1)]
        if not len(anchors):
            continue
        mine = a.part(anchors)
        fits = mine.labels[:, None] == rows.labels
        fits = fits & (mine.ids[:, None] != rows.ids) if same else ~fits
        low, most = pair_bounds(mine, rows)
        least, upto = best.least(anchors), high[anchors]
        fits &= np.logical_or.reduce([(most >= least[:, [w]]) & (low <= upto[:, [w]]) for w in range(best.shape[1])])
        here, there = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
        if not len(here):
            continue
        fits = fits[np.ix_(here, there)]
        scored += int(fits.sum())
        score = integer_scores(mine.part(here), rows.part(there))
        for w in range(best.shape[1]):
            i, j = np.nonzero(fits & (score >= least[here, w][:, None]) & (score <= upto[here, w][:, None]))
            if len(i):
                best.add(anchors[here[i]] * best.shape[1] + w, score[i, j], rows.ids[there[j]])
    return scored


_STORED = "vec_id long, label long, x binary, norm double, angles binary"


def _block(batch, width: int | None = None) -> Block:
    stored = np.frombuffer(b"".join(batch["angles"].to_pylist()), np.float32)
    return Block(batch["vec_id"].to_numpy(), batch["label"].to_numpy(), unpack(batch["x"].to_pylist(), width),
                 batch["norm"].to_numpy(), stored.reshape(batch.num_rows, -1) if batch.num_rows else stored.reshape(0, 0))


def stored_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, label, x) with norm and angles, near ones side by side in each partition."""
    width = references.shape[1]

    def step(batch):
        x = unpack(batch["x"].to_pylist())
        # what lies beyond the references' width counts in the norm and is at right angles to them
        wide = np.zeros((len(x), max(width, x.shape[1])), np.int64)
        wide[:, :x.shape[1]] = x
        norms, found = angles(wide, np.pad(references, ((0, 0), (0, wide.shape[1] - width))))
        near = found.argmin(axis=1) if found.shape[1] else np.zeros(len(x), np.int64)
        return {"vec_id": batch["vec_id"], "label": batch["label"], "x": batch["x"], "norm": pa.array(norms),
                "angles": pa.array([a.tobytes() for a in found], pa.binary()), "near": pa.array(near.astype(np.int32)),
                "away": pa.array(found.min(axis=1, initial=9).astype(np.float64))}

    return per_batch(rows, step, _STORED + ", near int, away double").sortWithinPartitions("near", "away").drop("near", "away")


def _search(stored: DataFrame, a: Block, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """anchor (its number), window, score, id, rank: the ``k`` best rows of each window low..high of each anchor."""

    def run(batches):
        best = Best(low, high, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                meet(a, _block(batch.slice(at, ROWS), a.x.shape[1]), best, same)
        yield pa.RecordBatch.from_pydict(dict(zip(("anchor", "window", "score", "id"), map(pa.array, best.found()))))

    found = stored.mapInArrow(run, "anchor long, window long, score long, id long")
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose score lies in the window.

    The score of two rows is the inner product of their integer vectors; high scores come first, ties by smaller id.
    The window of a positive score p holds the scores s with low * p <= 100 * s <= high * p; a negative p has none.
    Rows with a NULL id, label or vector, or a NULL, NaN or infinite entry, take no part. Rows that repeat an id are
    rows of their own, but rows with the anchor's id are never its positives, and an anchor row that repeats is one
    anchor. A shorter vector counts as ending in zeros. Anchors without a positive, and positives without a negative,
    give no rows, nor does an empty table. Ids and labels are integers; other columns play no part.
    """
    spark = df.sparkSession
    known = df.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    rows = staged(integer_vectors(known, vector_col, F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                  F.col(f"`{label_col}`").cast("long").alias("label"), anchors.alias("is_anchor")), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").collect()
    references = spread_out(unpack([bytes(r.x) for r in sample]), REFERENCES)
    stored = staged(stored_angles(rows.drop("is_anchor"), references), "angles")
    asked = staged(stored_angles(rows.filter("is_anchor").drop("is_anchor").distinct(), references), "anchors")
    blocks = math.ceil(asked.count() / BLOCK)
    out, written = run_dir(spark, "negatives"), []
    for b in range(blocks):
        a = _block(asked.filter(F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks)) == b).toArrow().combine_chunks())
        if not len(a.ids):
            continue
        every = np.full((len(a.ids), 1), _NONE + 1, np.int64)
        best = _search(stored, a, every, -every, positives, same=True).toArrow()
        at, rank = best["anchor"].to_numpy(), best["rank"].to_numpy() - 1
        mine = np.full((len(a.ids), positives), -1, np.int64)
        theirs = np.zeros((len(a.ids), positives), np.int64)
        mine[at, rank], theirs[at, rank] = best["score"].to_numpy(), best["id"].to_numpy()
        # an open window of low > high takes nothing: no positive, or a negative score
        least = np.where(mine >= 0, -((-low * mine) // 100), 1)
        most = np.where(mine >= 0, (high * mine) // 100, 0)
        i, w = np.nonzero(mine >= 0)
        named = spark.createDataFrame(pa.table({"anchor": i, "window": w, "anchor_id": a.ids[i], "positive_id": theirs[i, w],
                                                "positive_score": mine[i, w]}))
        _search(stored, a, least, most, negatives, same=False).join(F.broadcast(named), ["anchor", "window"]).select(  # at most BLOCK * positives rows
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.parquet(f"{out}/block{b}")
        written.append(f"{out}/block{b}")
    return spark.read.schema(_RESULT).parquet(*written) if written else spark.createDataFrame([], _RESULT)
