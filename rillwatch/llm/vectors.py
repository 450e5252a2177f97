"""Embeddings as integer vectors: each entry c becomes floor(256 * c), and a vector becomes one binary key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import per_batch

SCALE = 256.0
#: entries beyond this are held at it; nothing near it comes from an embedding
EDGE = 2.0 ** 62
_NARROW, _WIDE = b"\x02", b"\x08"


def usable(vector_col: str) -> Column:
    """True for a vector that is not NULL and holds neither NULL nor NaN nor infinite entries."""
    return F.coalesce(F.forall(f"`{vector_col}`", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))


def integers(vectors: pa.ListArray) -> np.ndarray:
    """One row of integers for each vector; shorter vectors end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.clip(np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -EDGE, EDGE).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """Equal rows get equal bytes, whatever number of zeros they end in."""
    last = x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1) if x.shape[1] else np.zeros(len(x), np.int64)
    last = np.where(x.any(axis=1), last, 0)
    narrow = (np.abs(x) < 1 << 15).all(axis=1)
    small = x.astype("<i2")
    return [_NARROW + small[i, :n].tobytes() if narrow[i] else _WIDE + x[i, :n].astype("<i8").tobytes() for i, n in enumerate(last)]


def unpack(keys: list[bytes], width: int | None = None) -> np.ndarray:
    """Integers of packed vectors, cut or filled with zeros to ``width`` (the longest one's, if not given)."""
    rows = [np.frombuffer(k, "<i2" if k[:1] == _NARROW else "<i8", offset=1) for k in keys]
    width = max(map(len, rows), default=0) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r[:width]
    return out


def integer_vectors(df: DataFrame, vector_col: str, *kept: Column) -> DataFrame:
    """The columns ``kept`` and ``x``, the packed integer vector, of each row whose vector is usable."""
    rows = df.filter(usable(vector_col)).select(*kept, F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    names = rows.columns[:-1]

    def step(batch):
        vectors = batch["x"]
        return {**{c: batch[c] for c in names}, "x": pa.array(pack(integers(vectors)), pa.binary())}

    return per_batch(rows, step, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", x binary")
