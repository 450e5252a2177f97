import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rillwatch.llm import simhash
from rillwatch.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[top(i)] = top(j)
    named = {}
    for i, d in enumerate(ids):
        if d is not None:
            named[top(i)] = min(d, named.get(top(i), d))
    return [named.get(top(i)) for i in range(len(ids))]


def agree(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted((r.doc_id is None, r.doc_id or 0, f, c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_documents(spark):
    agree(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_hard_texts(hard_docs):
    agree(hard_docs)


def test_empty_table(hard_docs):
    assert simhash.near_duplicates(hard_docs.limit(0)).count() == 0


def joined(fps, group=simhash.GROUP):
    spark = fps.sparkSession
    roots = {r.node: r.root for r in components(simhash.near_links(fps, group)).collect()}
    return {f: roots.get(f, f) for f in (r.fp for r in fps.collect())}, spark


def test_crowded_variants_give_the_same_components(spark):
    """Fingerprints crowd around few centres; tiny groups force the second and third cut."""
    rng = random.Random(7)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = plain_components(list(range(len(fps))), fps)
    classes = {}
    for f, c in zip(fps, want):
        classes.setdefault(c, set()).add(f)
    for group in (4, simhash.GROUP):
        found, _ = joined(df, group)
        got = {}
        for f, r in found.items():
            got.setdefault(r, set()).add(f % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_third_cut_bounds_a_group(spark):
    """All 2^11 values that agree on the fixed bits of some variants fit one group."""
    rows = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(-2**63, 2**63 - 1, 2000)], "fp long")
    rows = rows.selectExpr("0L as k1", "0L as k2", "fp")
    for level, bits in ((0, 33), (1, 18), (2, 11)):
        rows = simhash._cut(rows, level)
        one = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.bit_or(F.col("fp")).alias("o"), F.bit_and(F.col("fp")).alias("a"))
        assert one.filter(F.bit_count(F.col("o").bitwiseXOR(F.col("a"))) > bits).count() == 0
        rows = rows.limit(500)


def test_keep_one_keeps_clean_rows(make_docs):
    docs = make_docs(["a b c d e f", "A b C d e f", "quite another text with its own words", None])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 2, 3]
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_on_repeated_and_unnamed_rows(spark, make_docs):
    docs = make_docs(["a b c d"] * 2).union(make_docs(["a b c d"])).union(spark.sql("select cast(null as bigint), 'z', 'en', 's', 1L"))
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.keep_one(docs).collect() if r.doc_id is not None) == [(False, 0)]
    assert simhash.keep_one(docs).filter("doc_id is null").count() == 1


def test_keep_one_tells_rows_apart(spark):
    """Different texts under one id both stay; equal rows leave one; columns of any type and name come through."""
    docs = spark.sql("""select 1L as doc_id, 'a b c d e f' as text, map('k', 1) as m, 5 as row, 6 as fp
     union all select 1L, 'quite another text with words of its own', map('k', 2), 5, 6
     union all select 1L, 'a b c d e f', map('k', 1), 5, 6
     union all select 0L, 'A B c d e f', map('k', 4), 5, 6
     union all select cast(null as bigint), 'a b c d e f', map('k', 3), 5, 6""")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text, r.m["k"]) for r in got.collect()) == [
        (False, 0, "A B c d e f", 4), (False, 1, "quite another text with words of its own", 2), (True, None, "a b c d e f", 3)]
    assert simhash.keep_one(docs.limit(0)).count() == 0
