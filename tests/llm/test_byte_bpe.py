import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from rillwatch.llm import byte_bpe

from .conftest import HARD_TEXTS

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(PATH, P.PATTERN)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_hard_texts(library, own):
    for t in HARD_TEXTS:
        assert ids(own.encode(t or "")) == library.encode_ordinary(t or "")
        assert own.decode(own.encode(t or "")) == (t or "").encode()


def test_random_texts(library, own):
    rng = random.Random(3)
    letters = "aeiouthrnsAETH .'0159_-\n\té漢🙂"
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert ids(own.encode(t)) == library.encode_ordinary(t), t


def test_every_character_class_splits_alike(library, own):
    """Each code point between letters, digits and spaces."""
    for c in (*range(0xD800), *range(0xE000, 0x30000, 1)):
        t = f"a{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}"
        if ids(own.encode(t)) != library.encode_ordinary(t):
            raise AssertionError(hex(c))
        if len(own.ids_memo) > 100_000:
            own.ids_memo.clear()


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.encode_texts(docs, PATH, P.PATTERN).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = library.encode_ordinary(r.text)
        assert ids(bytes(got[r.doc_id].ids)) == want and got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_nulls_clashes_and_empty(hard_docs):
    got = byte_bpe.encode_texts(hard_docs, PATH, P.PATTERN)
    assert got.count() == hard_docs.count()
    assert got.filter("doc_id = 0").first().n_tokens == 0
    assert byte_bpe.encode_texts(hard_docs.limit(0), PATH, P.PATTERN).count() == 0
