import base64
import hashlib
import struct

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

from rillwatch.llm import pii, quality_model
from rillwatch.llm.tables import read

from .test_decontaminate import plain as plain_overlaps
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def plain(spark, sf_dir):
    """The stages as loops over a list; the fitted trees are shared, their scores are taken document by document."""
    docs = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    trees = quality_model.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    docs = [d for d in docs if trees.score(np.array([quality_model.statistics((d[1] or "").encode())]))[0] >= 0.3]
    yield {d for d, _ in docs}
    named = plain_components([d for d, _ in docs], [plain_fingerprint(t) for _, t in docs])
    docs = [d for d, c in zip(docs, named) if d[0] == c]
    yield {d for d, _ in docs}
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    # a cheap look first: texts that share no three words in a row with any item cannot match 12 of 15
    runs = {tuple(w[i:i + 3]) for _, t in items for w in [t.lower().split()] for i in range(len(w) - 2)}
    maybe = [d for d in docs if len({tuple(w[i:i + 3]) for w in [d[1].lower().split()] for i in range(len(w) - 2)} & runs) >= 2]
    bad = {d for (d, _), x in zip(maybe, plain_overlaps([t for _, t in maybe], items)) if x}
    docs = [d for d in docs if d[0] not in bad]
    yield {d for d, _ in docs}
    yield {d: pii.redact(t) for d, t in docs}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {d: library.encode_ordinary(pii.redact(t)) for d, t in docs}
    yield {d: (len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest()) for d, i in ids.items()}


def test_stages_against_loops(spark, tmp_path):
    docs = read(spark, SF, "documents")
    names = docs.columns
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, plain(spark, SF))):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 3:
            assert sorted(r.doc_id for r in rows) == sorted(want), name
        elif k == 3:
            assert {r.doc_id: r.text for r in rows} == want
        else:
            assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in rows} == want
        if k < 4:
            assert docs.columns == names
        assert len(rows) > 0


def test_hard_rows_pass_all_stages(spark, hard_docs, tmp_path):
    d = str(tmp_path)
    pq.write_table(pa.table({"doc_id": pa.array([3, 4], pa.int64()), "quality": pa.array([1, None], pa.int32()), "toxic": pa.array([0, 0], pa.int32())}), f"{d}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None], pa.int64()), "text": pa.array([None, ""], pa.string())}), f"{d}/benchmark.parquet")
    hard_docs.write.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in hard_docs.collect()} and len(out) > 5


def test_empty_tables(spark, hard_docs, tmp_path):
    d = str(tmp_path)
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), f"{d}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), f"{d}/benchmark.parquet")
    hard_docs.limit(0).write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
