import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwatch.llm import hard_negatives as hn
from rillwatch.llm.vectors import integers, pack, unpack

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50, k=5, n=3, low=50, high=95):
    """All pairs, by loops over Python's integers."""
    good = [(r.vec_id, r.label, [math.floor(256 * float(c)) for c in r.embedding]) for r in rows
            if r.vec_id is not None and r.label is not None and r.embedding is not None
            and all(c is not None and math.isfinite(c) for c in r.embedding)]
    out = []
    for a, label, x in {(i, g, tuple(v)) for i, g, v in good if i % every == 0}:
        scored = [(-sum(p * q for p, q in zip(x, v)), i, g) for i, g, v in good]
        for p, pid, _ in sorted(s for s in scored if s[2] == label and s[1] != a)[:k]:
            fits = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:n]
            out += [(a, pid, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return Counter(out)


def mined(df, every=50):
    return Counter(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0).collect())


def table(spark, vectors, labels, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], g)
                                  for i, v, g in zip(ids if ids is not None else range(len(vectors)), vectors, labels)], SCHEMA)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = plain(df.collect())
    assert mined(df) == want and len(want) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_ties_and_a_hot_label(spark, seed, monkeypatch):
    """Small integers tie often; a third of the rows are one vector; blocks and chunks of a few rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    vectors = np.round(centres[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, 8)), 1)
    vectors[::3] = vectors[0]
    vectors[5] = 0
    labels = [0 if rng.random() < 0.4 else int(rng.integers(0, 5)) for _ in range(400)]
    df = table(spark, vectors, labels)
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "ROWS", 32)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 8)
    assert mined(df, 10) == plain(df.collect(), 10)


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [list(v) for v in np.round(rng.normal(size=(60, 4)), 1)]
    vectors[3], vectors[4], vectors[6], vectors[8], vectors[9] = None, [1.0, None, 0, 0], [float("nan")] * 4, [float("inf"), 0, 0, 0], []
    vectors[11], vectors[12] = [1.0, 2.0], [1.0, 2.0, 0.0, 0.0, 0.5]
    labels = [None if i == 20 else i % 3 for i in range(60)]
    ids = [0, 0, 50, 50, *range(4, 60)]
    ids[30] = ids[31] = 77
    df = table(spark, vectors, labels, ids).unionByName(table(spark, [vectors[0]], [0], [0]))
    df = df.unionByName(spark.createDataFrame([(None, [1.0, 1.0, 1.0, 1.0], 1)], SCHEMA))
    for name in ("x", "score", "norm", "is_anchor", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    assert mined(df) == plain(df.collect())
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    none = hn.hard_negatives(df, F.col("vec_id") == -1)
    assert none.count() == 0 and none.columns[0] == "anchor_id"


def test_bounds_hold(monkeypatch):
    """Every score lies within the bounds of its pair and of its block, near ones, opposite ones and large norms too."""
    rng = np.random.default_rng(4)
    base = rng.integers(-300, 300, (200, 6))
    x = np.concatenate([base, base * 3, -base, base + rng.integers(-1, 2, base.shape), base * 40000, np.zeros((2, 6), int)])
    norms, found = hn.angles(x, hn.spread_out(x[:500], 16))
    every = hn.Block(np.arange(len(x)), np.zeros(len(x), int), x, norms, found)
    a, b = every.part(slice(0, 1002, 7)), every
    exact = np.array([[sum(int(p) * int(q) for p, q in zip(u, v)) for v in b.x] for u in a.x])
    assert (hn.integer_scores(a, b) == exact).all()
    low, most = hn.pair_bounds(a, b)
    assert (low <= exact).all() and (exact <= most).all()
    low, most = hn.block_bounds(a, b.part(slice(100, 140)))
    assert (low[:, None] <= exact[:, 100:140]).all() and (exact[:, 100:140] <= most[:, None]).all()
    # rows near a reference are told apart: the filter does leave pairs out
    best = hn.Best(np.full((len(a.ids), 1), 1 << 20), np.full((len(a.ids), 1), 1 << 40), 3)
    assert hn.meet(a, b, best, same=True) < 0.9 * exact.size


def test_packing():
    import pyarrow as pa

    x = integers(pa.array([[0.5, -0.001, 0.0], [], [300.0], [1e300, -1e300]], pa.list_(pa.float64())))
    assert x.tolist() == [[128, -1, 0], [0, 0, 0], [76800, 0, 0], [1 << 62, -(1 << 62), 0]]
    keys = pack(x)
    assert (unpack(keys, 3) == x).all() and len(keys[0]) == 5 and pack(x[:, :2]) == keys
