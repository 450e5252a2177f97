import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from rillwatch.llm import quality_model as Q


def test_flat_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.4)).astype(float)
    trees = Q.fit_trees(x, y)
    inner = trees.feature.shape[1]
    for row, got in zip(x[:60], trees.score(x[:60])):
        total = trees.start
        for t in range(len(trees.feature)):
            at = 0
            while at < inner:
                at = 2 * at + 1 + int(row[trees.feature[t, at]] > trees.limit[t, at])
            total += trees.leaf[t, at - inner]
        assert abs(1 / (1 + math.exp(-total)) - got) < 1e-9
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


def test_one_class_and_no_rows():
    x = np.zeros((3, 2))
    assert (Q.fit_trees(x, np.ones(3)).score(x) > 0.5).all()
    assert (Q.fit_trees(x[:0], np.ones(0)).score(x) == 0.5).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = Q.score_documents(docs, Q.train(docs, labels))
    rows = out.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    good, bad = [r.predicted for r in held if r.quality == 1], [r.predicted for r in held if r.quality == 0]
    print("kept good", np.mean(good), "kept bad", np.mean(bad))
    assert len(held) > 500 and np.mean(good) > 0.99 and np.mean(bad) < 0.15
    assert out.count() == docs.count()


def test_learning_never_sees_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert (a.leaf == b.leaf).all() and (a.limit == b.limit).all()


def test_hard_rows(spark, hard_docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 1), (7, None), (None, 1)], "doc_id long, quality int")
    trees = Q.train(hard_docs, labels)
    out = Q.score_documents(hard_docs, trees)
    assert out.count() == hard_docs.count() and out.filter("score is null or isnan(score)").count() == 0
    assert Q.score_documents(hard_docs.limit(0), trees).count() == 0
    assert Q.train(hard_docs, labels.limit(0)).score(np.zeros((1, Q.N_STATS)))[0] == 0.5
    kept = Q.drop_rejected(hard_docs, trees)
    assert kept.columns == hard_docs.columns
    assert np.isfinite([Q.statistics(t) for t in (b"", b" ", b"\n\n", b"a", b"\xff\xfe")]).all()
