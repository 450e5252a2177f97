"""Quality rules: counts that any text must satisfy, and how much a text reads like trusted text.

Everything is a DataFrame expression. Words become 64-bit hashes once; unigrams and bigrams of them fall into a fixed
number of buckets. Two multinomials over the buckets, one of the trusted documents and one of all documents, give each
bucket a log-likelihood ratio; the mean over a text's n-grams is compared with a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import staged

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: buckets of n-gram hashes: bounds the model, which is part of the plan
BUCKETS = 16384
#: n-grams that the raw distribution counts for in the trusted one
PRIOR = 2000.0
#: smallest mean log-likelihood ratio of a kept text
THRESHOLD = -0.12
MIN_WORDS, REPEAT_PERCENT, RUN = 10, 20, 5


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """Hashes of the words; A-Z and any other capital are lower-cased first."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def buckets(hashes: Column) -> Column:
    """Buckets of all unigrams and bigrams."""
    def grams(h):
        pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int")))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), F.filter(pairs, lambda p: p.isNotNull()))

    return let(hashes, grams)


def repeated_words(text: Column) -> Column:
    """Words in runs of RUN words that occur twice or more in the text, the first included."""
    def in_runs(h):
        n = F.size(h) - (RUN - 1)
        runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(
            *[F.element_at(h, i + j) for j in range(RUN)]))).otherwise(F.array().cast("array<bigint>"))
        return let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(covered(r)))

    def covered(r):
        ranked = F.array_sort(F.transform(r, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1).h == x.h) | (F.get(s, i + 1).h == x.h))
            return F.array_sort(F.transform(twice, lambda x: x.i))

        def total(p):
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(RUN), F.coalesce(b - a, F.lit(RUN))))
            return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

        return let(let(ranked, places), total)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), in_runs)


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` with the counts and ``base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("long")
    counted = docs.select(
        "doc_id", F.col(text).alias("text"), long(F.regexp_count(t, F.lit(WORD))).alias("n_words"),
        long(F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))).alias("word_chars"), long(F.regexp_count(t, F.lit(SYMBOLS))).alias("n_symbols"),
        long(repeated_lines(F.col(text))).alias("n_dup_lines"), long(repeated_words(F.col(text))).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, n_raw over all documents, n_trusted over those whose doc_id is in ``trusted``; one pass over the texts."""
    # trusted ids grow with the table: never a broadcast, which would also hide the shuffle of the texts on small tables
    good = trusted.select("doc_id").distinct().withColumn("good", F.lit(1)).hint("merge")
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left")
    grams = marked.select("good", F.explode(buckets(word_hashes(F.col("text")))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("n_raw"), F.count("good").alias("n_trusted"))


def ratios(counts: DataFrame) -> list[float]:
    """Log-likelihood ratio of each bucket, the trusted counts smoothed by the raw distribution; at most BUCKETS rows."""
    rows = {r.bucket: (r.n_raw, r.n_trusted) for r in counts.collect()}
    raw, good = sum(n for n, _ in rows.values()), sum(g for _, g in rows.values())
    out = [0.0] * BUCKETS
    for b, (n, g) in rows.items():
        share = n / raw
        out[b] = round(math.log((g + PRIOR * share) / (good + PRIOR) / share), 6)
    return out


def mean_ratio(text: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio of the n-grams, 0 for a text without words."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")

    def mean(b):
        total = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(table, x))
        return F.when(F.size(b) > 0, F.round(total / F.size(b), 9)).otherwise(F.lit(0.0))

    return let(buckets(word_hashes(text)), mean)


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``trusted`` has the doc_ids of trusted documents. A text is kept if the base rules pass and its score, the mean
    log-likelihood ratio of its n-grams, is at least ``threshold``; a score equal to it is kept. A NULL or blank text
    has no words and fails. Repeated rows and NULL ids are kept as rows. Without documents there are no rows; without
    trusted documents all ratios are 0 and the base rules decide.
    """
    docs = docs.select("doc_id", "text")
    weights = ratios(staged(bucket_counts(docs, trusted), "bucket-counts"))
    return base_rules(docs).withColumn("score", mean_ratio(F.col("text"), weights)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("text")
