import itertools
import math
import zlib

import numpy as np
import public_tokenizers as P

from rillwatch.llm import language_id as L

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        out, part = [], word[0]
        for c, cut in zip(word[1:], cuts):
            if cut:
                out.append(part)
                part = c
            else:
                part += c
        yield [*out, part]


def plain(word, book, prob):
    number = {n: i for i, n in enumerate(book.names)}
    total = np.zeros(prob.shape[1])
    for s in segmentations(word):
        p = np.ones(prob.shape[1])
        for piece in s:
            if piece in number:
                p = p * prob[number[piece]]
            elif len(piece) == 1:
                p = p * prob[book.size]
            else:
                p = p * 0
        total += p
    return total


def random_model(book, n=3):
    rng = np.random.default_rng(0)
    prob = rng.random((book.size + 1, n))
    return prob / prob.sum(axis=0)


WORDS = ["a", "the", "und", "straße", "nation", "xq漢zth", "ation"]


def test_forward_sums_all_segmentations():
    book = L.pieces(PATH)
    prob = random_model(book)
    for w in WORDS:
        chars = np.array([[ord(c) for c in w]], np.uint64)
        got = L.forward(L.arcs(book, chars), 1, len(w), prob)[len(w)][0]
        assert np.allclose(got, plain(w, book, prob), rtol=1e-12)


def test_expected_counts_are_posteriors():
    book = L.pieces(PATH)
    prob, number = random_model(book), {n: i for i, n in enumerate(book.names)}
    for w in WORDS:
        chars = np.array([[ord(c) for c in w]], np.uint64)
        total = np.zeros((book.size + 1, 3))
        L.expected(L.arcs(book, chars), 1, len(w), prob, np.array([[1.0, 2.0, 0.0]]), total)
        want = np.zeros_like(total)
        for s in segmentations(w):
            ids = [number.get(p, book.size if len(p) == 1 else None) for p in s]
            if None not in ids:
                p = np.prod(prob[ids], axis=0) / plain(w, book, prob) * [1.0, 2.0, 0.0]
                for i in ids:
                    want[i] += p
        assert np.allclose(total, want, rtol=1e-9)


def test_pieces_of_every_length():
    found = set()
    for line in open(PATH, "rb"):
        try:
            piece = L.base64.b64decode(line.split()[0]).decode().strip(" ").lower()
        except UnicodeDecodeError:
            continue
        found |= {piece} if piece.isalpha() else set()
    book = L.pieces(PATH)
    assert book.names == sorted(found) and book.longest == max(map(len, found)) > 6
    prob, number = random_model(book), {n: i for i, n in enumerate(book.names)}
    for w in sorted(found, key=lambda x: (-len(x), x))[:5]:
        steps = L.arcs(book, np.array([[ord(c) for c in w]], np.uint64))
        assert any((i, j) == (0, len(w)) and number[w] in ids for i, j, _, ids in steps)
        assert {(i, j) for i, j, _, _ in steps if j - i > 1} == {(i, j) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] in number}
        if len(w) < 15:
            assert np.allclose(L.forward(steps, 1, len(w), prob)[len(w)][0], plain(w, book, prob), rtol=1e-12)


def test_long_runs_are_summed_whole():
    book = L.pieces(PATH)
    prob, number = random_model(book), {n: i for i, n in enumerate(book.names)}
    for words in (["internationalisierung", "zqjxkverantwortlichke"], ["nationalversammlung" * 3]):
        chars = np.array([[ord(c) for c in w] for w in words], np.uint64)
        n, length = chars.shape
        steps = L.arcs(book, chars)
        a = L.forward(steps, n, length, prob)
        assert np.allclose(L.log_forward(book, chars, prob), np.log(a[length]), rtol=1e-12)
        assert np.allclose(L.log_forward(book, chars, prob, keep=True)[0:length + 1:7], np.log(a[::7]), rtol=1e-9)
        weight = np.arange(1.0, 1 + 3 * n).reshape(n, 3)
        want, got = np.zeros((book.size + 1, 3)), np.zeros((book.size + 1, 3))
        L.expected(steps, n, length, prob, weight, want)
        L.expected_long(book, chars, prob, weight, got)
        assert np.allclose(got, want, rtol=1e-9)
    w = "漢字the" * 500  # smaller than any double: held against sums of logarithms, letter by letter
    logs = [np.zeros(3)]
    for j in range(1, len(w) + 1):
        parts = [logs[i] + np.log(prob[number.get(w[i:j], book.size)]) for i in range(max(0, j - book.longest), j) if w[i:j] in number or j == i + 1]
        logs.append(np.logaddexp.reduce(parts, axis=0))
    got = L.log_forward(book, np.array([[ord(c) for c in w]], np.uint64), prob)[0]
    assert np.allclose(got, logs[-1], rtol=1e-10) and (got < -750).all()
    assert L.words_of(["ab " + "x" * 70], None)[0] == ["ab", "x" * 70]


def test_long_words_are_cut_and_odd_ones_cleaned():
    words, codes, counts = L.words_of(["ab " + "x" * 70 + " ab", None, "", "12 _ ½", "y²z"])
    assert [[words[c] for c in part] for part in np.split(codes, np.cumsum(counts)[:-1])] == [
        ["ab", "x" * 32, "x" * 32, "x" * 6, "ab"], [], [], [], ["yz"]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.learn(docs, PATH)
    out = L.identify(docs, PATH, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r.lang_pred == r.lang for r in out if r.held_out]
    print("held out", len(held), np.mean(held))
    assert np.mean(held) > 0.98


def test_hard_rows(spark, hard_docs):
    docs = hard_docs.unionByName(hard_docs.filter("doc_id in (6, 8)").selectExpr("*").withColumn("lang", hard_docs["source"]), allowMissingColumns=True)
    learned = L.learn(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("der die das und nicht", "de"), ("the and with of", "en"), (None, "en"), ("le la", None)] * 9)],
                                            "doc_id long, text string, lang string"), PATH)
    assert learned[0] == ["de", "en"]
    out = L.identify(docs, PATH, learned).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id in (0, 1, 2):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in out} <= {"de", "en", "und"} and not any(math.isnan(r.score) for r in out)
    assert L.identify(docs.limit(0), PATH, learned).count() == 0
    nothing = L.learn(docs.filter("lang is null"), PATH)
    assert {r.lang_pred for r in L.identify(docs, PATH, nothing).collect()} == {"und"}


def test_tiny_probabilities_stay_numbers(spark):
    """Counts as of a corpus of 1e12 pieces: letters unseen in a language give words a probability below any double."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    book = L.pieces(path)
    prob = np.full((book.size + 1, 3), 0.05 / 1e12)
    prob[:, 0] = 1.0 / book.size
    word = "qxzjvwkyqxzjvwkyqxzjvwkyqxzjvw"
    chars = np.array([[ord(c) for c in w] for w in (word, word[::-1])], np.uint64)
    with np.errstate(all="raise", under="ignore"):
        assert (L.forward(L.arcs(book, chars), 2, 30, prob)[30][:, 1:] < 1e-250).any()
        assert np.isfinite(L.log_word(book, chars, prob)).all()
        for weight in ([[1.0, 0, 0], [2.0, 0, 0]], [[1.0, 3.0, 0], [0, 0, 2.0]]):
            total, want = np.zeros_like(prob), np.zeros_like(prob)
            small = L.expected(L.arcs(book, chars), 2, 30, prob, np.array(weight), total)
            if len(small):
                L.expected_long(book, chars[small], prob, np.array(weight)[small], total)
            L.expected_long(book, chars, prob, np.array(weight), want)
            assert np.isfinite(total).all() and np.allclose(total, want, rtol=1e-6)
            assert (total[:, np.array(weight).sum(axis=0) == 0] == 0).all()
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate([word, word * 40, "x"])], "doc_id long, text string, lang string")
    got = L.identify(docs, path, (["a", "b", "c"], np.log([1 / 3] * 3), prob)).collect()
    assert all(r.lang_pred == "a" and 0 <= r.score <= 1 for r in got)
