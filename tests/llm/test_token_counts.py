import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rillwatch.llm import token_counts

from .conftest import HARD_TEXTS

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def agree(docs, library, **more):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.token_counts(docs, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_documents(spark, library):
    agree(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), library)


def test_hard_rows(hard_docs, library):
    agree(hard_docs, library)
    assert token_counts.token_counts(hard_docs.limit(0), PATH, P.PATTERN).count() == 0


def test_special_strings(make_docs, library):
    agree(make_docs(["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> c", "<|endof text|>", "x <|endoftext|"]), library)


def test_many_blocks(make_docs, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_WORDS", 5)
    agree(make_docs([t for t in HARD_TEXTS if t is None or len(t) < 100] * 3), library)


def test_character_classes(spark, make_docs, library):
    chars = [c for c in (*range(0x3000), *range(0x1F000, 0x1F700)) if not 0xD800 <= c < 0xE000]
    agree(make_docs([f"a{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}" for c in chars]).repartition(4), library)


def test_pack():
    import numpy as np

    for x in (np.zeros(0), np.array([0, 1, 2**32 - 1, 70000])):
        assert (token_counts.unpack(token_counts.pack(x)) == x).all()
