"""Embedding whitening over distinct vectors.

Rows with the same integer vector are grouped first. The covariance is a centred matrix product over the groups, each
with a weight: one, or its number of rows. Every distinct vector is whitened once and joined back to its rows, so a
vector that a third of all rows share costs one product.

What reaches the driver is bounded by the dimension alone: sums, the covariance matrix and its eigenvectors.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import per_batch, staged
from rillwatch.llm.vectors import integer_vectors, unpack

COMPONENTS = 4
ONE, COPIES = "one", "copies"
_EXACT = 1 << 62


def exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted column sums as integers of any size."""
    if float(np.abs(x).max(initial=0)) * float(weight.sum()) < _EXACT:
        return [int(s) for s in weight @ x]
    return [int(s) for s in weight.astype(object) @ x.astype(object)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sum) squared, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * most * most < _EXACT:
        return (np.square(n * x - np.array(sums, np.int64)).sum(axis=1)).tolist()
    wide = n * x.astype(object) - np.array(sums, object)
    return [int(s) for s in (wide * wide).sum(axis=1)] if x.shape[1] else [0] * len(x)


class Fit:
    """Mean, eigenvectors (columns) and eigenvalues, falling, of the covariance over the fit list."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        values, vectors = np.linalg.eigh(covariance)
        self.values = values[::-1][:components]
        self.vectors = vectors[:, ::-1][:, :components]
        self.trace = float(np.trace(covariance))
        # a direction without spread, up to rounding, cannot be scaled to spread one
        self.flat = self.values <= len(sums) * np.finfo(float).eps * max(values[-1], 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        out = (x - self.mean) @ self.vectors
        out[:, self.flat] = 0.0
        return out / np.sqrt(np.where(self.flat, 1.0, self.values))

    def explained(self) -> list[float]:
        return [0.0 if f else float(e / self.trace) for e, f in zip(self.values, self.flat)]


def _totals(cells: DataFrame, kind: str) -> dict:
    """Sums by cell of what each task found."""
    return {r.cell: r.v for r in cells.groupBy("cell").agg(F.sum("v").cast(kind).alias("v")).collect()}


def fit(distinct: DataFrame, components: int = COMPONENTS, weights: str = ONE) -> Fit | None:
    """Fit over ``distinct`` (x: packed vector, copies: its rows), with weight one or ``copies`` for each; None without a dimension."""
    width = distinct.agg(F.max(F.when(F.substring("x", 1, 1) == F.lit(b"\x02"), (F.octet_length("x") - 1) / 2).otherwise(
        (F.octet_length("x") - 1) / 8)).cast("int")).first()[0]
    if not width:
        return None

    def weight_of(batch):
        return np.ones(batch.num_rows, np.int64) if weights == ONE else batch["copies"].to_numpy()

    def first(batches):
        n, sums = 0, [0] * width
        for batch in batches:
            w = weight_of(batch)
            n += int(w.sum())
            sums = [a + b for a, b in zip(sums, exact_sums(unpack(batch["x"].to_pylist(), width), w))]
        if n:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(-1, width), pa.int32()),
                                              "v": pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))})

    found = _totals(distinct.mapInArrow(first, "cell int, v decimal(38,0)"), "decimal(38,0)")
    n, sums = int(found[-1]), [int(found[i]) for i in range(width)]
    mean, upper = np.array([s / n for s in sums]), np.triu_indices(width)

    def second(batches):
        total = None
        for batch in batches:
            x = unpack(batch["x"].to_pylist(), width) - mean
            part = (x * weight_of(batch)[:, None]).T @ x
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(upper[0]), dtype=np.int32)), "v": pa.array(total[upper])})

    found = _totals(distinct.mapInArrow(second, "cell int, v double"), "double")
    covariance = np.zeros((width, width))
    covariance[upper] = [found[i] / n for i in range(len(upper[0]))]
    return Fit(n, sums, covariance + np.triu(covariance, 1).T, components)


def identity_error(whitened: DataFrame, components: int, weights: str = ONE) -> float:
    """Largest absolute entry of the covariance of ``w`` over the fit list, centred first, minus the identity."""
    weight = F.lit(1) if weights == ONE else F.col("copies")
    w = [F.col("w")[i] for i in range(components)]
    means = whitened.agg(F.sum(weight).alias("n"), *[(F.sum(weight * c) / F.sum(weight)).alias(f"m{i}") for i, c in enumerate(w)]).first()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    cov = whitened.agg(*[F.sum(weight * (w[i] - means[f"m{i}"]) * (w[j] - means[f"m{j}"])) / means["n"] for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, cov))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = ONE) -> DataFrame:
    """For each row with a usable vector and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is NULL or holds NULL, NaN or infinite entries are left out. A vector shorter than the longest
    counts as ending in zeros. Rows that repeat keep their rows, a NULL id is kept. A component without any spread is
    whitened to 0 and explains 0, and its covariance is not the identity's: identity_error is then 1. ``deviation``
    is decimal(38,0). No usable vector, or only empty ones: no rows. Other columns play no part, whatever their names.
    """
    rows = staged(integer_vectors(df, vector_col, F.col(f"`{id_col}`").alias("vec_id")), "vectors")
    distinct = staged(rows.groupBy("x").agg(F.count("*").alias("copies")), "distinct-vectors")
    found = fit(distinct, components, weights)
    schema = "x binary, copies long, deviation decimal(38,0), w array<double>"
    kind = rows.schema["vec_id"].dataType.simpleString()
    if found is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                                   "explained double, identity_error double")
    width, explained = len(found.sums), found.explained()

    def step(batch):
        x = unpack(batch["x"].to_pylist(), width)
        return {"x": batch["x"], "copies": batch["copies"],
                "deviation": pa.array([Decimal(d) for d in deviations(x, found.n, found.sums)], pa.decimal128(38, 0)),
                "w": pa.array(found.whiten(x).tolist(), pa.list_(pa.float64()))}

    whitened = staged(per_batch(distinct, step, schema), "whitened")
    error = identity_error(whitened, len(explained), weights)
    # both sides are written tables: a vector that very many rows share is a partition that the engine splits
    back = rows.join(whitened.select("x", "deviation", "w"), "x").select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return back.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                       F.array(*map(F.lit, explained))[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
