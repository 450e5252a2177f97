import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from rillwatch.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_base(t):
    t = t or ""
    words, lines, seen = WORD.findall(t), 0, set()
    for line in t.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i:i + 5])] > 1:
            again.update(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), lines, len(again), n < 10 or 100 * len(again) > 20 * n


def grams(t):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall((t or "").lower())]
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), a % (1 << 64))  # noqa: E731  hash of b, seeded by that of a
    out = [x % Q.BUCKETS for x in h]
    for a, b in zip(h, h[1:]):
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
        out.append(signed(pair(signed(first), b)) % Q.BUCKETS)
    return out


def plain(rows, trusted):
    raw, good = Counter(), Counter()
    for d, t in rows:
        g = Counter(grams(t))
        raw += g
        if d in trusted:
            good += g
    n, m, out = sum(raw.values()), sum(good.values()), []
    w = {b: round(math.log((good[b] + Q.PRIOR * c / n) / (m + Q.PRIOR) / (c / n)), 6) for b, c in raw.items()}
    for d, t in rows:
        g, base = grams(t), plain_base(t)
        score = sum(w[b] for b in g) / len(g) if g else 0.0
        out.append((d, *base, round(score, 6), not base[-1] and score >= Q.THRESHOLD))
    return out


def agree(docs, trusted):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    names = {r.doc_id for r in trusted.collect()} - {None}
    want = sorted(plain(rows, names), key=str)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 6), r.kept)
                  for r in Q.apply_rules(docs, trusted).collect()), key=str)
    assert got == want
    return got


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    got = agree(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1"))
    assert {g[-1] for g in got} == {True, False}


def test_hard_rows(spark, hard_docs):
    trusted = spark.createDataFrame([(3,), (4,), (4,), (None,)], "doc_id long")
    agree(hard_docs, trusted)
    assert Q.apply_rules(hard_docs.limit(0), trusted).count() == 0
    assert {r.score for r in Q.apply_rules(hard_docs, trusted.limit(0)).collect()} == {0.0}


def test_repeats_at_random(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["\n".join(rng.choice(["x y", " ", "", "z", "x y "]) for _ in range(rng.randint(0, 12))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in Q.base_rules(df).drop("text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_base(t), t


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = Q.apply_rules(docs, docs.limit(5))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_junk_goes_and_good_stays(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = Q.apply_rules(spark.read.parquet(f"{d}/documents.parquet"), labels.filter("quality = 1")).join(labels, "doc_id").filter("not base_failed")
    row = out.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))).first()
    assert row[0] > 0.999 and row[1] < 0.1
