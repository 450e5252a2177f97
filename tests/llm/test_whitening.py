import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwatch.llm import whitening
from rillwatch.llm.whitening import deviations, exact_sums


def plain(rows, weights=whitening.ONE, components=4):
    good = [(r.vec_id, [math.floor(256 * c) for c in r.embedding]) for r in rows
            if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    width = max(len(x) for _, x in good)
    good = [(i, tuple(x) + (0,) * (width - len(x))) for i, x in good]
    copies = Counter(x for _, x in good)
    listed = [x for x, c in copies.items() for _ in range(1 if weights == whitening.ONE else c)]
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    x = np.array(listed, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in good:
        w = (np.array(v, float) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), w, values / np.trace(x.T @ x / n))
    return out


def agree(df, weights=whitening.ONE):
    want = plain(df.collect(), weights)
    got = whitening.whiten(df, weights=weights).orderBy("vec_id", "component").collect()
    assert len(got) == 4 * df.filter(F.expr("embedding is not null and not exists(embedding, c -> c is null or isnan(c) or abs(c) = double('inf'))")).count()
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        c = r.component - 1
        if abs(w[c]) > 1e-6:
            sign.setdefault(c, math.copysign(1, w[c] * r.whitened))
        assert math.isclose(r.whitened, sign.get(c, 1) * w[c], rel_tol=1e-7, abs_tol=1e-9)
        assert math.isclose(r.explained, explained[c], rel_tol=1e-9) and r.identity_error < 1e-9
    return got


@pytest.mark.parametrize("weights", [whitening.ONE, whitening.COPIES])
def test_copies(spark, weights):
    """A third of the rows are copies: fitted once, or as often as they occur."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(90, 6)) * [1, 2, 3, 4, 5, 6])]
    rows += [(100 + i, rows[0][1]) for i in range(45)] + [(200 + i, rows[i][1]) for i in range(10)]
    got = agree(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), weights)
    assert got[0].n == (90 if weights == whitening.ONE else 145)


def test_given_table(spark):
    agree(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))


def test_hard_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v], "clash", "clash") for i, v in enumerate(rng.normal(size=(30, 5)))]
    bad = [None, [1.0, None, 2.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [-float("inf")] * 5]
    rows += [(40 + i, v, None, "clash") for i, v in enumerate(bad)] + [(50, [], None, None), (51, [1.0, 2.0], None, None), (52, [3.0] * 6, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, w string")
    agree(df)
    with_null = df.unionByName(spark.createDataFrame([(None, [0.5] * 5, None, None), (3, rows[3][1], None, None)], df.schema))
    out = whitening.whiten(with_null)
    assert out.filter("vec_id is null").count() == 4 and out.filter("vec_id = 3").count() == 8
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 50")).count() == 0


def test_no_spread(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 1, 0, 0, 0, 1), (2, 1, 0, 0, 0, 1)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    for r in whitening.whiten(line).collect():
        assert math.isfinite(r.whitened) and (r.component == 1 or r.whitened == 0)


def test_integers_of_any_size():
    x = np.array([[1 << 61, -5], [1 << 61, 7]])
    assert exact_sums(x, np.array([3, 2])) == [5 << 61, -1]
    assert deviations(x, 5, [5 << 61, -1]) == [(5 * -5 + 1) ** 2, (5 * 7 + 1) ** 2]
