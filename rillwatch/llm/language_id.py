"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over
all ways to cut it into pieces, which a forward algorithm gives; a text's is the product over its words. The piece
probabilities are learned by expectation maximisation: distinct words of the learning texts are counted per language
once, and each round adds up how often each piece is expected in them under the current ones, backward and forward;
only those sums leave a task.

All distinct words of a batch that have the same length are worked on at once. Words of more than ``MAX_WORD`` letters,
as in scripts without spaces, and words whose probability comes near the smallest double, are worked through letter by
letter with logarithms.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import held_out, once, per_batch, staged

#: letters of a word, and probability of a word, up to and down to which products are taken without logarithms
MAX_WORD, LEAST = 32, 1e-250
ROUNDS, SMOOTHING, UNKNOWN = 2, 0.05, 1e-7
_FILTER_BITS = 22
_WORD = re.compile(r"[^\W\d_]+")


class Pieces:
    """The letter pieces of a file of ranks (one base64 token and its rank a line), lower case, without spaces."""

    def __init__(self, path: str):
        found = set()
        with open(path, "rb") as lines:
            for line in lines:
                try:
                    piece = base64.b64decode(line.split()[0]).decode().strip(" ").lower()
                except UnicodeDecodeError:
                    continue
                if piece.isalpha():
                    found.add(piece)
        self.names = sorted(found)
        self.size, self.longest = len(self.names), max(map(len, self.names), default=0)
        codes, begun = np.zeros(self.size, np.uint64), []
        for i, name in enumerate(self.names):
            h = self.begin(1)
            for c in name:
                begun.append(h[0])
                h = self.add(h, np.array([ord(c)], np.uint64))
            codes[i] = h[0]
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], order
        self.filter = np.zeros(1 << _FILTER_BITS, np.uint8)  # 1: a piece, 2: the beginning of a longer one
        self.filter[self._slot(codes)] = 1
        self.filter[self._slot(np.array(begun, np.uint64))] |= 2

    @staticmethod
    def begin(n: int) -> np.ndarray:
        return np.full(n, 0xCBF29CE484222325, np.uint64)

    @staticmethod
    def add(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _slot(h):
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose hash is a piece, the piece, and the rows that may begin a longer one."""
        marks = self.filter[self._slot(h)]
        rows = np.flatnonzero(marks & 1)
        at = np.minimum(np.searchsorted(self.codes, h[rows]), self.size - 1)
        hit = self.codes[at] == h[rows]
        return rows[hit], self.ids[at[hit]], np.flatnonzero(marks & 2)


def pieces(path: str) -> Pieces:
    return once(("pieces", path), lambda: Pieces(path))


def letters(words: list[str]) -> list[np.ndarray]:
    """Code points of words by length: entry n holds all words of n letters, in order."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    return {n: np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64) for n, ws in by_length.items()}


def arcs_at(vocabulary: Pieces, chars: np.ndarray, i: int):
    """(from, to, rows, piece) for every piece that begins at letter ``i``."""
    n, length = chars.shape
    every, h = np.arange(n), vocabulary.begin(n)
    for k in range(1, min(max(1, vocabulary.longest), length - i) + 1):
        h = vocabulary.add(h, chars[every, i + k - 1])
        hit, ids, on = vocabulary.lookup(h)
        if k == 1 and len(hit) < n:
            known = np.full(n, vocabulary.size)
            known[hit] = ids
            yield i, i + 1, every, known
        elif len(hit):
            yield i, i + k, every[hit], ids
        if not len(on):
            return
        every, h = every[on], h[on]


def arcs(vocabulary: Pieces, chars: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, piece) for every piece in words of one length; a letter that is no piece gets the piece ``size``."""
    return [a for i in range(chars.shape[1]) for a in arcs_at(vocabulary, chars, i)]


def forward(steps, n: int, length: int, prob: np.ndarray) -> np.ndarray:
    """Probability of the first j letters for each j, word and language."""
    a = np.zeros((length + 1, n, prob.shape[1]))
    a[0] = 1
    for i, j, rows, ids in steps:
        a[j, rows] += a[i, rows] * prob[ids]
    return a


def _add(total: np.ndarray, ids: np.ndarray, share: np.ndarray, weight: np.ndarray) -> None:
    if len(ids) < 200:  # few rows are not worth a column of all pieces
        np.add.at(total, ids, share * weight)
        return
    for g in range(weight.shape[1]):
        total[:, g] += np.bincount(ids, share[:, g if share.shape[1] > 1 else 0] * weight[:, g], len(total))


def expected(steps, n: int, length: int, prob: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Adds to ``total`` (piece, language) how often each piece is expected in words that occur ``weight`` (word, language) times.

    Words whose probability is below LEAST in a language where they occur are left out; their rows are returned.
    """
    a, b = forward(steps, n, length, prob), np.zeros((length + 1, n, prob.shape[1]))
    small = ((a[length] < LEAST) & (weight > 0)).any(axis=1)
    if small.any():
        weight = np.where(small[:, None], 0.0, weight)
    whole = np.where(a[length] < LEAST, 1.0, a[length])  # weight is 0 there
    b[length] = 1
    for i, j, rows, ids in reversed(steps):
        b[i, rows] += b[j, rows] * prob[ids]
    for i, j, rows, ids in steps:
        share = a[i, rows] * prob[ids] * b[j, rows] / whole[rows]
        _add(total, ids, share, weight[rows])
    return np.flatnonzero(small)


def log_word(vocabulary: Pieces, chars: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each word in each language."""
    n, length = chars.shape
    if length > MAX_WORD:
        return log_forward(vocabulary, chars, prob)
    last = forward(arcs(vocabulary, chars), n, length, prob)[length]
    small = np.flatnonzero((last < LEAST).any(axis=1))
    if len(small):
        last[small] = 1.0
    out = np.log(last)
    if len(small):
        out[small] = log_forward(vocabulary, chars[small], prob)
    return out


def log_forward(vocabulary: Pieces, chars: np.ndarray, prob: np.ndarray, keep: bool = False) -> np.ndarray:
    """Logarithm of ``forward``'s last column, or with ``keep`` of all; held are as many columns as a piece has letters."""
    n, length = chars.shape
    width = vocabulary.longest + 1
    window, log = np.zeros((width, n, prob.shape[1])), np.zeros((n, prob.shape[1]))
    window[0] = 1
    kept = [log] if keep else None
    for i in range(length):
        here = window[i % width]
        for _, j, rows, ids in arcs_at(vocabulary, chars, i):
            window[j % width, rows] += here[rows] * prob[ids]
        here[:] = 0
        scale = window[(i + 1) % width].copy()
        log = log + np.log(scale)
        window /= scale
        if keep:
            kept.append(log)
    return np.stack(kept) if keep else log


def expected_long(vocabulary: Pieces, chars: np.ndarray, prob: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """``expected`` for words of any length: the same sums, with the backward columns held as ``log_forward`` holds its own."""
    n, length = chars.shape
    width = vocabulary.longest + 1
    a = log_forward(vocabulary, chars, prob, keep=True)
    window, log = np.zeros((width, n, prob.shape[1])), np.zeros((n, prob.shape[1]))
    window[length % width] = 1
    for i in reversed(range(length)):
        window[i % width] = 0
        near = np.exp(a[i] + log - a[length])
        for _, j, rows, ids in arcs_at(vocabulary, chars, i):
            part = prob[ids] * window[j % width, rows]
            window[i % width, rows] += part
            share = part * near[rows]
            _add(total, ids, share, weight[rows])
        scale = window[i % width].copy()
        log = log + np.log(scale)
        window /= scale


def words_of(texts: list[str | None], longest: int | None = MAX_WORD) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (lower case letters, cut after ``longest`` if given), the word of each occurrence, and the words of each text."""
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    column = np.empty(int(counts.sum()), object)
    column[:] = list(chain.from_iterable(found))
    codes, uniques = pd.factorize(column)
    cut, first = [], np.zeros(len(uniques) + 1, np.int64)
    for i, w in enumerate(uniques):
        w = w if w.isalpha() else "".join(filter(str.isalpha, w))
        size = longest or max(1, len(w))
        parts = [w] if 0 < len(w) <= size else [w[k:k + size] for k in range(0, len(w), size)]
        cut += parts
        first[i + 1] = len(cut)
    if len(cut) != len(uniques) or any(map(str.__ne__, cut, uniques)):  # a word of several parts, or of none
        sizes = np.diff(first)
        parts_of = sizes[codes]
        text_of = np.repeat(np.arange(len(counts)), counts)
        start = np.repeat(first[codes], parts_of)
        inside = np.arange(len(start)) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)
        counts = np.bincount(np.repeat(text_of, parts_of), minlength=len(counts))
        codes = start + inside
    return cut, codes, counts


def _by_length(words: list[str]):
    """(places of the words, code points) for each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = letters(words)
    for n in sorted(chars):
        yield np.flatnonzero(sizes == n), chars[n]


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """word, n: how often each distinct word of ``docs`` (text, lang) occurs in each of ``langs``."""

    def run(batches):
        number = {g: i for i, g in enumerate(langs)}
        for batch in batches:
            lang = np.array([number[g] for g in batch["lang"].to_pylist()], np.int64)
            words, codes, counts = words_of(batch["text"].to_pylist(), None)
            n = np.bincount(codes * len(langs) + np.repeat(lang, counts), minlength=len(words) * len(langs))
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.FixedSizeListArray.from_arrays(
                pa.array(n.astype(np.int64)), len(langs)).cast(pa.list_(pa.int64()))})

    found = docs.select("text", "lang").mapInArrow(run, "word string, n array<long>")
    return found.groupBy("word").agg(F.array(*[F.sum(F.col("n")[g]) for g in range(len(langs))]).alias("n"))


def expected_counts(words: DataFrame, path: str, langs: list[str], prob: np.ndarray | None) -> DataFrame:
    """lang (its number), piece, n: expected pieces in ``words`` (word, n); without ``prob`` all pieces are alike."""

    def run(batches):
        book = pieces(path)
        now = np.full((book.size + 1, 1), 1.0 / book.size) if prob is None else prob
        total = np.zeros((book.size + 1, len(langs)))
        for batch in batches:
            weight = batch["n"].flatten().to_numpy().reshape(-1, len(langs)).astype(float)
            for at, chars in _by_length(batch["word"].to_pylist()):
                own = weight[at]
                small = slice(None) if chars.shape[1] > MAX_WORD else expected(arcs(book, chars), *chars.shape, now, own, total)
                if chars.shape[1] > MAX_WORD or len(small):
                    expected_long(book, chars[small], now, own[small], total)
        piece, g = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(g.astype(np.int32)), "piece": pa.array(piece.astype(np.int32)), "n": pa.array(total[piece, g])})

    return words.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and piece probabilities (piece, language) from the rows of ``docs`` that are not held out.

    Rows with a NULL text or lang teach nothing. What reaches the driver is bounded by vocabulary and languages.
    """
    own = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = sorted((r.lang, r.n) for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [g for g, _ in share]
    prior = np.log(np.array([n for _, n in share], float) / max(1, sum(n for _, n in share)))
    prob, size = None, pieces(path).size
    words = staged(word_counts(own, langs), "words") if langs and rounds else None
    for _ in range(rounds if langs else 0):
        table = expected_counts(words, path, langs, prob).toArrow()
        total = np.zeros((size + 1, len(langs)))
        total[table["piece"].to_numpy(), table["lang"].to_numpy()] = np.round(table["n"].to_numpy(), 6)
        prob = (total + SMOOTHING) / (total.sum(axis=0) + SMOOTHING * (size + 1))
        prob[size] = UNKNOWN
    return langs, prior, prob


def identify(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its posterior probability) for each row of ``docs``.

    A text that is NULL or has no letters, or a model without languages, gives ``und`` and score 0; of equal
    probabilities the language first in order wins. Repeated rows and NULL ids are kept; an empty table gives no rows.
    """
    langs, prior, prob = model
    rows = docs.select("doc_id", "text")

    def step(batch):
        words, codes, counts = words_of(batch["text"].to_pylist(), None)
        logs = np.zeros((len(words), max(1, len(langs))))
        if langs:
            book = pieces(path)
            for at, chars in _by_length(words):
                logs[at] = log_word(book, chars, prob)
        ends = np.cumsum(counts)
        sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs[codes], axis=0)])
        total = sums[ends] - sums[ends - counts] + (prior if langs else 0)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = (counts > 0) & bool(langs)
        return {"doc_id": batch["doc_id"], "lang_pred": pa.array([langs[b] if k else "und" for b, k in zip(best, known)]),
                "score": pa.array(np.where(known, score, 0.0))}

    scored = per_batch(rows, step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", rows=4000)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
