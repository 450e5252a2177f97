import random
import re
from collections import Counter

import pytest

from rillwatch.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    w = words(text)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def check_base(docs):
    rows = {r.doc_id: r for r in licenses.digests(licenses.license_spans(docs)).collect()}
    for r in docs.select("doc_id", "text").collect():
        got = rows[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == plain_base(r.text), r
        assert set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(",")) and 0 <= got.score <= 1
    return rows


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lower(text) like '%licen%' or doc_id < 300")
    rows = check_base(docs)
    for r in docs.collect():
        text = r.text or ""
        for line, label in (("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Released under the MIT License.", "mit"),
                            ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
                            ("licensed under the GNU General Public License, version 3.", "gpl-3.0")):
            assert (label in rows[r.doc_id].labels.split(",")) == (line in text)


def test_matching_statistics():
    """Against every run of words of every template, over few words so that runs repeat."""
    rng = random.Random(7)
    for _ in range(60):
        templates = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(rng.randint(1, 4))]
        phrases = {" ".join(rng.choice("abcd") for _ in range(n)): str(n) for n in rng.choice([(1, 2, 3), (2, 3)])}
        book = licenses.Automaton(templates, phrases)
        inside = [t.split() for _, t in templates] + [p.split() for p in phrases]
        runs = {tuple(t[i:j]) for t in inside for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        text = [rng.choice("abcdx") for _ in range(60)]
        got = {end: (length, state) for end, length, state in book.stream([w.encode() for w in text])}
        for end in range(1, 61):
            want = max((n for n in range(1, end + 1) if tuple(text[end - n:end]) in runs), default=0)
            assert got.get(end, (want if want < book.least else -1, 0))[0] == want
            if end in got:
                n, state = got[end]
                places = {(t, j) for t, (_, own) in enumerate(templates) for j in range(n, len(own.split()) + 1) if own.split()[j - n:j] == text[end - n:end]}
                assert set(book.places[state]) == places and len(book.places[state]) == len(places)
        found, _ = book.scan([w.encode() for w in text])
        want = Counter((i, label) for p, label in phrases.items() for i in range(60) if text[i:i + len(p.split())] == p.split())
        assert Counter(found) == want


def spans(text, **more):
    book = licenses.automaton(**more)
    _, matches = book.scan(licenses.words_of(text.encode()))
    return licenses.spans_of(book, matches)


def test_spans_over_changed_words():
    label, mit = licenses.TEMPLATES[4]
    assert label == "mit"
    changed = mit.replace("to any person obtaining", "to each and every person obtaining").replace("the rights to use", "rights to use").replace("CLAIM", "claims")
    (span,) = spans("Copyright 2020 Someone Else. " + changed + " end of it")
    assert span[0] == "mit" and span[1] == 4 and span[2] == 4 + len(words(changed)) and 0.9 < span[7] < 1
    half = " ".join(mit.split()[:60])
    (span,) = spans(half)
    assert span[7] < 0.5 and "mit" in span[0]
    both = mit + " filler words between " + licenses.TEMPLATES[1][1] + " and " + mit
    assert [s[0] for s in spans(both)] == ["mit", "apache-2.0", "mit"] and all(s[7] == 1 for s in spans(both))
    bsd2, bsd3 = (next(t for n, t in licenses.TEMPLATES if n == f"bsd-{k}-clause") for k in (2, 3))
    assert [s[0] for s in spans(bsd3)] == ["bsd-3-clause"] and [s[0] for s in spans(bsd2)] == ["bsd-2-clause"]
    assert spans("the software is free for any purpose and so on") == []


def test_long_texts_take_linear_time():
    import time

    text = " ".join([licenses.TEMPLATES[4][1]] * 600 + ["of the software"] * 30000)
    begin = time.time()
    assert len(spans(text)) >= 600
    assert time.time() - begin < 20


def test_hard_rows(spark, hard_docs, make_docs):
    got = licenses.digests(licenses.license_spans(hard_docs))
    assert got.count() == hard_docs.count() and got.filter("score is null or labels is null or n_words is null").count() == 0
    check_base(make_docs([None, "", " ", "CC BY", "cc-by cc by,cc:by", "MIT License mit  license", "ＭＩＴ license é mit license", "K apache license" * 40,
                          "gnu general public gnu general public license", "apache\nlicense"]))
    assert licenses.license_spans(hard_docs.limit(0)).count() == 0


@pytest.mark.parametrize("templates", [(), (("own", "one two three four five six seven eight"),)])
def test_own_templates(templates):
    found = spans("x one two three four five six seven nine y", templates=templates, phrases={"two three": "p"})
    assert [(s[0], s[1], s[2], s[6]) for s in found] == ([("own", 1, 8, 7)] if templates else [])
