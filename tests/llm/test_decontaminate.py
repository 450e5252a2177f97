import random
import re

from rillwatch.llm import decontaminate as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(texts, items):
    """Every window of every text against every window of every item."""
    out = []
    for t in texts:
        w, found = words_of(t), set()
        for i, item in items:
            v = words_of(item)
            n = min(15, len(v))
            if n == 0:
                continue
            need = -(-4 * n // 5) if n >= 8 else n  # four in five; items below 8 words whole
            if any(sum(a == b for a, b in zip(w[p:p + n], v[q:q + n])) >= need and p + n <= len(w)
                   for p in range(len(w) - n + 1) for q in range(len(v) - n + 1)):
                found.add(i)
        out.append(sorted(found))
    return out


def agree(docs, benchmark):
    rows, items = docs.select("doc_id", "text").collect(), [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    want = sorted((r.doc_id is None, r.doc_id or 0, bool(x), x) for r, x in zip(rows, plain([r.text for r in rows], items)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.contaminated, r["items"]) for r in D.decontaminate(docs, benchmark).collect())
    assert got == want
    clean = sorted(map(str, (r.doc_id for r, x in zip(rows, plain([r.text for r in rows], items)) if not x)))
    assert sorted(str(r.doc_id) for r in D.drop_contaminated(docs, benchmark).select("doc_id").collect()) == clean
    return sum(g[2] for g in got)


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    agree(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet").limit(12))


def test_planted_changes(spark, make_docs):
    """Passages with up to five changed words, at any place, and items of every length."""
    rng = random.Random(2)
    word = lambda: f"w{rng.getrandbits(12)}" if rng.random() < 0.5 else rng.choice("the of and to in".split())
    items = [[word() for _ in range(n)] for n in (3, 7, 8, 10, 14, 15, 16, 20, 40)]
    texts = []
    for _ in range(160):
        v = list(rng.choice(items))
        a = rng.randint(0, max(0, len(v) - 15))
        v = v[a:a + rng.randint(8, 30)]
        for _ in range(rng.randint(0, 5)):
            v[rng.randrange(len(v))] = "changed"
        texts.append(" ".join([word() for _ in range(rng.randint(0, 20))] + v + [word().upper() for _ in range(rng.randint(0, 20))]))
    benchmark = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(items)], "item_id long, text string")
    assert 20 < agree(make_docs(texts), benchmark) < 160


def test_short_items_with_changed_words(spark, make_docs):
    """Items of every length below 15, with up to four words changed, at any place."""
    rng = random.Random(5)
    word = lambda: rng.choice("the of and to in a is on".split()) if rng.random() < 0.5 else f"w{rng.getrandbits(9)}"
    items = [[word() for _ in range(n)] for n in range(2, 17) for _ in range(2)]
    texts = []
    for v in items * 6:
        v = list(v)
        for p in rng.sample(range(len(v)), min(len(v), rng.randint(0, 4))):
            v[p] = "other"
        texts.append(" ".join([word() for _ in range(rng.randint(0, 9))] + v + [word() for _ in range(rng.randint(0, 9))]))
    benchmark = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(items)], "item_id long, text string")
    assert 20 < agree(make_docs(texts), benchmark) < len(texts)
    one = spark.createDataFrame([(1, "what is the capital city of the old country called"), (2, "say it again now please")], "item_id long, text string")
    docs = make_docs(["x what is the capital town of the old country called y", "so say it again now please ok", "say it again then please"])
    assert [r["items"] for r in D.decontaminate(docs, one).orderBy("doc_id").collect()] == [[1], [2], []]


def test_blocks_leave_two_whole():
    for n in range(1, 16):
        cut = D.blocks(n)
        assert [a for a, _ in cut] == [sum(x for _, x in cut[:i]) for i in range(len(cut))] and sum(x for _, x in cut) == n
        assert len(cut) == (1 if n < 8 else n - D.least_equal(n) + 2) and min(x for _, x in cut) >= 1


def test_repeated_words_are_compared_once(spark, make_docs):
    import time

    benchmark = spark.createDataFrame([(1, "ha " * 300), (2, "tick tock " * 100), (3, "ha ha ha")], "item_id long, text string")
    docs = make_docs(["ha " * 100_000, "tick tock " * 50_000, "ha ho " * 1000, "ho"])
    begin = time.time()
    got = {r.doc_id: r["items"] for r in D.decontaminate(docs, benchmark).collect()}
    assert time.time() - begin < 30 and got == {0: [1, 3], 1: [2], 2: [], 3: []}
    found = D.overlaps(docs, benchmark).filter("item_id = 1").collect()
    assert [(r["first"], r["last"]) for r in found] == [(0, 100_000 - 15)]


def test_bitmaps_follow_the_benchmark(spark, make_docs, monkeypatch):
    monkeypatch.setattr(D, "BITS", (10, 12))
    rng = random.Random(9)
    items = [" ".join(f"w{rng.getrandbits(30)}" for _ in range(60)) for _ in range(40)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(D.bitmaps(D.benchmark_seeds(benchmark))[0]) == 1 << 9
    agree(make_docs([items[3], "nothing of it " * 10, items[7][:200]]), benchmark)


def test_columns_of_any_name_and_type_stay(spark):
    docs = spark.sql("select 1L as doc_id, 'a b c d e f g h i j k l m n o p' as text, map('k', 1) as m, 7 as key1, 8 as _key2 "
                     "union all select 2L, 'clean', map('k', 2), 9, 10")
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    (row,) = D.drop_contaminated(docs, benchmark).collect()
    assert row.asDict() == {"doc_id": 2, "text": "clean", "m": {"k": 2}, "key1": 9, "_key2": 10}


def test_hard_rows(spark, hard_docs):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g h i j k l m n o p"), (4, "a b c d e f g h"), (4, "a b c d e f g h")],
                                      "item_id long, text string").selectExpr("*", "1 as seed", "2 as key1")
    agree(hard_docs, benchmark)
    assert D.decontaminate(hard_docs.limit(0), benchmark).count() == 0
    assert D.decontaminate(hard_docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert D.drop_contaminated(hard_docs, benchmark).columns == hard_docs.columns
