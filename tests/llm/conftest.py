import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: nulls, empty and blank texts, ties, repeated rows, one very long text
HARD_TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "one two", "One TWO three", "one two three", "a b c d e f g h i j k l m n o p",
    "Ünïcode wörds 漢字 🙂 and more spaces", "x" * 5000, "ab " * 3000, "same line\nsame line\n\nother line\nsame line",
    "one two three", "﻿mark \x1c file \x85 next", "don't we'll I'M  they've   'tis", "1234 567 89a 10.5", "\n\n\n  \n tail ",
]


@pytest.fixture
def make_docs(spark):
    def build(texts, **more):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return build


@pytest.fixture
def hard_docs(spark):
    """Hard texts with a NULL id, a repeated row and columns whose names the operators use themselves."""
    rows = [(i, t, None, None, None) for i, t in enumerate(HARD_TEXTS)] + [(None, "no id here", "en", "s", 1), (5, HARD_TEXTS[5], None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "component_id", "spans", "words", "score", "k1", "h", "pos", "n_words", "word"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df
