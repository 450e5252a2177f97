"""Benchmark passages in documents, found by spaced seeds.

A window of 15 words is cut into five blocks of three. If at most three words were changed, two blocks at least are
whole, so one of ten fixed masks, each of which looks at two blocks and ignores the rest, gives the same hash for the
document and the benchmark item: no overlap of that similarity (0.8) is missed. Items of 8 to 14 words are one window,
cut into two blocks more than words that may be changed, and items of fewer words are one block. Hashes are joined by
equality and the windows compared word by word.

A window that a text repeats is compared once, whatever its places, and so is one that an item repeats.

Before the join, documents drop hashes that no item has by two bitmaps. Their size follows the benchmark up to a bound;
beyond it more hashes get through to the join, which decides alone.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import free_names, per_batch, staged, utf8
from rillwatch.llm.words import hash_words, mix, run_hash, split_words

#: words of a window, and of the shortest item in which a word may be changed
SPAN, LEAST_CHANGED = 15, 8
SIMILAR = 0.8
#: bits of the first bitmap, as powers of two (the second has twice as many): 1 MB to 32 MB, about 16 bits a seed
BITS = (23, 28)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def least_equal(n: int) -> int:
    """Words of a window of ``n`` that are equal at least."""
    return ceil(round(SIMILAR * n, 6)) if n >= LEAST_CHANGED else n


def blocks(n: int) -> list[tuple[int, int]]:
    """(begin, length) of the blocks of a window of ``n`` words: two more than words that may be changed."""
    k = n - least_equal(n) + 2 if n >= LEAST_CHANGED else 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def seeds(h: np.ndarray, ends: np.ndarray, n: int = SPAN):
    """(places, hashes) of each mask over the windows of ``n`` words; ``ends`` is the end of the text that each word hash in ``h`` is in."""
    at = np.flatnonzero(np.arange(len(h)) + n <= ends)
    cut = blocks(n)
    part = {size: run_hash(h, size) for _, size in cut}
    if len(cut) == 1:
        yield at, part[n][at] * _A + np.uint64(n << 8)
    for i, ((a, x), (b, y)) in enumerate(combinations(cut, 2)):
        yield at, part[x][at + a] * _A + part[y][at + b] * _B + np.uint64((n << 8) + i)


def windows(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, keep):
    """doc, seed, first and last place of each distinct window of ``n`` words under each seed of it that ``keep`` lets through."""
    doc, seed, at = [], [], []
    for places, hashes in seeds(h, ends, n):
        chosen = keep(hashes)
        seed.append(hashes[chosen])
        at.append(places[chosen])
    seed, at = np.concatenate(seed), np.concatenate(at)
    doc = np.searchsorted(starts, at, side="right") - 1
    if not len(at):
        return doc, seed, at, at
    one, two = run_hash(h, n, salt=1)[at], run_hash(h, n, salt=2)[at]
    order = np.lexsort((at, two, one, seed, doc))
    doc, seed, at, one, two = doc[order], seed[order], at[order], one[order], two[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (seed[1:] != seed[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    return doc[new], seed[new], at[new], at[np.append(new[1:], len(at)) - 1]


def _lower(texts: list[bytes]):
    words, starts = split_words([t.lower() for t in texts])
    return words, starts, hash_words(words), np.repeat(starts[1:], np.diff(starts))


def _texts(words: list[bytes], at: np.ndarray, n: int) -> list[str]:
    return [b" ".join(words[p:p + n]).decode() for p in at]


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows of seed, item_id, n and the words compared, for every distinct window of every item."""
    rows = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def step(batch):
        words, starts, h, ends = _lower(utf8(batch["text"]))
        sizes = np.diff(starts)
        found = {"seed": [], "doc": [], "n": [], "words": []}
        for n in sorted(set(np.minimum(sizes, SPAN).tolist()) - {0}):
            whole = np.repeat(sizes >= SPAN if n == SPAN else sizes == n, sizes)
            doc, seed, at, _ = windows(h, starts, np.where(whole, ends, -1), n, lambda x: slice(None))
            found["seed"].append(seed)
            found["doc"].append(doc)
            found["n"].append(np.full(len(at), n, np.int32))
            found["words"] += _texts(words, at, n)
        seed, doc, n = (np.concatenate(found[c]) if found[c] else np.zeros(0, np.int64) for c in ("seed", "doc", "n"))
        return {"seed": pa.array(seed.astype(np.uint64).view(np.int64)), "item_id": batch["item_id"].take(pa.array(doc.astype(np.int64))),
                "n": pa.array(n.astype(np.int32)), "item_words": pa.array(found["words"], pa.string())}

    kind = rows.schema["item_id"].dataType.simpleString()
    return per_batch(rows, step, f"seed long, item_id {kind}, n int, item_words string").distinct()


def _bit(seed: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(seed) if level else seed) >> np.uint64(64 - bits)


def bitmaps(seed_rows: DataFrame) -> list[np.ndarray]:
    """Two bitmaps of the seeds; what reaches the driver is bounded by BITS."""
    bits = min(max(BITS[0], ceil(log2(max(1, seed_rows.count()))) + 4), BITS[1])

    def step(batch):
        seed = batch["seed"].to_numpy().view(np.uint64)
        out = [(level, bit) for level in (0, 1) for bit in np.unique(_bit(seed, level, bits + level))]
        return {"level": pa.array([x for x, _ in out], pa.int32()), "byte": pa.array([int(b) >> 3 for _, b in out], pa.int64()),
                "bits": pa.array([1 << (int(b) & 7) for _, b in out], pa.int32())}

    found = per_batch(seed_rows.select("seed"), step, "level int, byte long, bits int")
    table = found.groupBy("level", "byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    maps = [np.zeros(1 << (bits + level - 3), np.uint8) for level in (0, 1)]
    for level in (0, 1):
        own = table["level"].to_numpy() == level
        maps[level][table["byte"].to_numpy()[own]] = table["bits"].to_numpy()[own]
    return maps


def _passes(maps, seed):
    keep = np.arange(len(seed))
    for level, m in enumerate(maps):
        bit = _bit(seed[keep], level, len(m).bit_length() + 2)
        keep = keep[(m[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return keep


#: names a row by content, so that rows without or with the same id are told apart
def _row_key(id_col="doc_id", text_col="text"):
    return [F.xxhash64(id_col, text_col).alias("key1"), F.xxhash64(F.lit(1), text_col, id_col).alias("key2")]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of key1, key2 (a document's row), item_id, first and last start of matching windows, most equal words.

    Words are lower-cased in A-Z. A window matches if 12 of its 15 words at least are equal in place; an item of 8 to
    14 words is one window of which four in five words are equal; an item of fewer words must occur whole. NULL and
    empty texts and items never match.
    """
    items = staged(benchmark_seeds(benchmark, "item_id", "text"), "benchmark-seeds")
    maps = bitmaps(items)
    sizes = sorted(r.n for r in items.select("n").distinct().collect())  # at most SPAN
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select(*_row_key(), "text")

    def step(batch):
        words, starts, h, ends = _lower(utf8(batch["text"]))
        found, texts = [], []
        for n in sizes:
            found.append(windows(h, starts, ends, n, lambda seed: _passes(maps, seed)))
            texts += _texts(words, found[-1][2], n)
        doc, seed, first, last = map(np.concatenate, zip(*found))
        take = pa.array(doc)
        return {"key1": batch["key1"].take(take), "key2": batch["key2"].take(take), "seed": pa.array(seed.view(np.int64)),
                "first": pa.array((first - starts[doc]).astype(np.int32)), "last": pa.array((last - starts[doc]).astype(np.int32)),
                "doc_words": pa.array(texts, pa.string())}

    schema = "key1 long, key2 long, seed long, first int, last int, doc_words string"
    hits = per_batch(rows if sizes else rows.limit(0), step, schema, rows=500)
    # rows with the same id and text are one here; copies of a text that very many rows hold meet before the join
    hits = hits.groupBy("key1", "key2", "seed", "doc_words").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    equal = F.size(F.filter(F.zip_with(F.split("doc_words", " "), F.split("item_words", " "), lambda a, b: a == b), lambda x: x))
    least = F.when(F.col("n") < LEAST_CHANGED, F.col("n")).otherwise(F.ceil(F.round(F.col("n") * SIMILAR, 6)))
    pairs = hits.join(items, "seed").filter(F.size(F.split("doc_words", " ")) == F.col("n")).withColumn("n_equal", equal)
    return pairs.filter(F.col("n_equal") >= least).groupBy("key1", "key2", "item_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("n_equal").cast("int").alias("most_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, items (sorted ids of the items it overlaps) and most_equal.

    Repeated rows get the same answer, NULL ids are kept, an empty table of documents gives no rows and an empty
    benchmark contaminates nothing. Items with a NULL id contaminate but are not listed.
    """
    found = overlaps(docs, benchmark).groupBy("key1", "key2").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("most_equal").alias("most_equal"))
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *_row_key())
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return rows.join(found, ["key1", "key2"], "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"),
        F.coalesce("most_equal", F.lit(0)).alias("most_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap an item.

    Rows with a NULL or empty text, and all rows if the benchmark is empty, stay; rows that repeat stay or go together,
    with or without a doc_id; columns may have any name and type. An empty table gives no rows.
    """
    names = free_names(docs, "key1", "key2")
    bad = overlaps(docs, benchmark).select(F.col("key1").alias(names[0]), F.col("key2").alias(names[1])).distinct()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({names[0]: F.xxhash64("doc_id", text), names[1]: F.xxhash64(F.lit(1), text, "doc_id")})
    return keyed.join(bad, names, "left_anti").select(*[f"`{c}`" for c in docs.columns])
