import hashlib
import random
import re
from collections import Counter

import numpy as np

from rillwatch.llm import substring
from rillwatch.llm.words import run_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, n=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def agree(docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows])))
    got = Counter(tuple(r) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    return got


def test_documents(spark):
    got = agree(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(n for _, _, n, _ in got) > 5000


def test_planted_overlaps(spark, make_docs, tmp_path):
    """Passages of 30 to 50 words at any place, alone, chained, overlapping and within one text."""
    rng = random.Random(11)
    word = lambda: rng.choice("the of and to in".split()) if rng.random() < 0.4 else f"w{rng.getrandbits(30)}"
    passages = [[word() for _ in range(rng.randint(30, 50))] for _ in range(12)]
    texts = []
    for _ in range(150):
        t = []
        for _ in range(rng.randint(0, 5)):
            t += [word() for _ in range(rng.choice([0, 0, 1, 10, 40]))]
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            t += p[a:len(p) - rng.randint(0, 8)]
        texts.append(" ".join(t))
    texts += ["a " * 34, "b " * 35, "c " * 36, "d e " * 40, " ".join(passages[0]), "x " * 34 + "y"]
    make_docs(texts).write.parquet(str(tmp_path / "d"))
    agree(spark.read.parquet(str(tmp_path / "d")))


def test_hard_rows(spark, hard_docs, tmp_path):
    hard_docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    agree(docs)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_long_passages_with_changed_words(spark, make_docs, tmp_path):
    """Copies of long passages that leave them for a word or a few and come back, change places, run in circles or skip words."""
    rng = random.Random(5)
    word = lambda: f"w{rng.getrandbits(30)}"
    passages = [[word() for _ in range(rng.randint(200, 900))] for _ in range(4)]
    texts = []
    for i in range(120):
        t = list(rng.choice(passages))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(t))
            t[at:at + rng.choice([1, 1, 1, 30, 60])] = [word() for _ in range(rng.choice([0, 1, 1, 30, 60]))]
        if i % 5 == 0:
            cut = rng.randrange(len(t))
            t = t[cut:] + t[:cut]
        if i % 7 == 0:
            t = t[:70] * rng.randint(2, 4)
        texts.append(" ".join(t[rng.choice([0, 0, 20, 50]):]))
    make_docs(texts).repartition(7).write.parquet(str(tmp_path / "d"))
    got = agree(spark.read.parquet(str(tmp_path / "d")))
    assert sum(0 < gone < n for _, n, gone, _ in got) > 40


def test_paths(spark):
    """Links, paths over several documents and rounds, branches and circles against a walk from edge to edge."""
    rng = random.Random(3)
    steps, at = [], 0
    for length in (1, 2, 3, 40, 700):  # chains of their own, the sources dealt over documents in stretches
        steps += [(at + i, at + i + 1) for i in range(length)]
        at += length + 1
    steps += [(at + i, at + (i + 1) % 9) for i in range(9)] + [(at + 20, at + 20)]  # a circle, and an edge from a node to itself
    steps += [(2, at + 30), (50, at + 31), (at + 32, 50)]  # nodes 2 and 50 branch
    rows, doc, place = [], 0, 0
    for i, (tail, head) in enumerate(steps):
        if rng.random() < 0.2:
            doc, place = rng.randrange(10**6), 0
        rows.append((i * 7, doc, place, tail, head))
        place += rng.choice([1, 1, 1, 2])
    edges = spark.createDataFrame(rows, "id long, rid long, place int, tail long, head long")
    enter, leave = {}, {}
    for i, _, _, tail, head in rows:
        enter.setdefault(head, []).append(i)
        leave.setdefault(tail, []).append(i)
    links = {enter[n][0]: leave[n][0] for n in enter if n in leave and len(enter[n]) == len(leave[n]) == 1 and enter[n] != leave[n]}
    assert {r.before: r.after for r in substring.links_of(edges).collect()} == links
    back = {b: a for a, b in links.items()}
    got = {r.id: (r.path, r["rank"]) for r in substring.compact(edges).collect()}
    assert len(got) == len(rows)
    circle = {i for i, _, _, tail, _ in rows if at <= tail < at + 9}
    for i in got.keys() - circle:
        first, rank = i, 0
        while first in back:
            first, rank = back[first], rank + 1
        assert got[i] == (first, rank)
    assert len({got[i] for i in circle}) == 9
    for i in circle:  # cut somewhere, and along the links elsewhere
        path, rank = got[i]
        assert path in circle and (rank == 0 or got[back[i]] == (path, rank - 1))


def test_helpers():
    h = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    for k in (1, 2, 3, 10, 26, 35):
        r = run_hash(h, k)
        assert len(r) == 200 - k + 1 and run_hash(h[50:], k)[0] == r[50]
        for j in range(k):
            other = h.copy()
            other[50 + j] += np.uint64(1)
            assert run_hash(other, k)[50] != r[50]
        small = h % np.uint64(7)
        assert (substring.leftmost_least(small, k) == np.arange(200 - k + 1) + np.lib.stride_tricks.sliding_window_view(small, k).argmin(1)).all()


def test_scans_cut_differently_give_the_same_rows(spark, tmp_path, monkeypatch):
    """The number of tasks of a scan follows the cores that happen to be there: each scan here is cut in another way."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 300").repartition(40)
    docs.write.parquet(str(tmp_path / "d"))
    own, calls = substring.staged, []

    def staged(df, name):
        calls.append(name)
        spark.conf.set("spark.sql.files.minPartitionNum", str(3 + 7 * len(calls)))
        return own(df, name)

    monkeypatch.setattr(substring, "staged", staged)
    spark.conf.set("spark.sql.files.minPartitionNum", "3")
    try:
        agree(spark.read.parquet(str(tmp_path / "d")))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(calls) > 3
