"""A training corpus from raw documents: each stage works on all that the one before it kept.

quality classifier, near-duplicates, benchmark decontamination, personal data, byte-level tokens.
"""

from __future__ import annotations

import public_tokenizers

from rillwatch.llm import byte_bpe, decontaminate, pii, quality_model, simhash
from rillwatch.llm.tables import read, staged


def quality(spark, docs, sf_dir):
    """Documents go that the classifier, fitted on the labels, rejects."""
    return quality_model.drop_rejected(docs, quality_model.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, the one of smallest doc_id."""
    return simhash.keep_one(docs)


def benchmark(spark, docs, sf_dir):
    """Documents go that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data gives way to the name of its kind; all documents stay."""
    return pii.redact_documents(docs)


def byte_bpe_ids(spark, docs, sf_dir):
    """Token ids of each text that is left, and digests of the ids and of what they decode to."""
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data),
          ("byte_bpe", byte_bpe_ids)]

#: fitted trees, 64-bit hashes and byte-level tokens are beyond SQL; tests/llm/test_pipeline.py holds it against loops
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
