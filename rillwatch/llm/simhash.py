"""SimHash near-duplicates by deletion variants.

Two fingerprints of 64 bits that differ in at most three are cut into two halves: one half differs by at most one
bit, so the two share a variant of that half with one bit left out. Variants are joined by equality, and pairs are
verified on all 64 bits.

A variant shared by many fingerprints is cut the same way again: its 32 open bits are two quarters of which one
differs by at most one bit, and then two eighths. After that at most 2,048 fingerprints can agree, whatever the
data, so no group is unbounded, no link is lost, and the work stays in proportion to the rows. Within a group a
spanning forest is linked instead of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.components import components
from rillwatch.llm.tables import free_names, per_batch, staged, texts_of

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: most fingerprints that can share a variant after three cuts: 11 open bits
GROUP = 2048


def fingerprint_of(text: bytes) -> int:
    """A bit is set if it is set in over half of the hashes of the text's shingles; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint ``fp`` (long)."""

    def step(batch):
        found = np.array([fingerprint_of(t) for t in batch["text"].cast(pa.binary()).to_pylist()], np.uint64)
        return {"doc_id": batch["doc_id"], "fp": pa.array(found.view(np.int64))}

    rows = texts_of(docs, id_col, text_col)
    return per_batch(rows, step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _cut(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` (k1, k2, fp) under each variant of the next part; k1 and k2 name all bits fixed so far.

    Level 0 makes 64 variants of 31 bits. Level 1 cuts the half that level 0 left open, level 2 the quarter that
    level 1 left open. The key keeps which bit was left out before, so only rows of one variant meet again.
    """
    if level == 0:
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
        half = F.expr("shiftrightunsigned(fp, cast(32 * (i div 32) as int)) & 4294967295L")
        return rows.select((F.col("i").cast("long") * (1 << 32) + half.bitwiseAND(F.expr("~shiftleft(1L, i % 32)"))).alias("k1"),
                           F.lit(0).cast("long").alias("k2"), "fp")
    if level == 1:  # k1 = i * 2^32 + ..., i // 32 is the half that is fixed
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31))))
        quarter = F.expr("shiftrightunsigned(fp, cast(32 * (1 - shiftright(k1, 37)) + 16 * (j div 16) as int)) & 65535L")
        return rows.select("k1", (F.col("j").cast("long") * 65536 + quarter.bitwiseAND(F.expr("~shiftleft(1L, j % 16)")) + 1).alias("k2"), "fp")
    # k2 = j * 2^16 + ... + 1, j // 16 is the quarter that is fixed
    rows = rows.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(15))))
    eighth = F.expr("shiftrightunsigned(fp, cast(32 * (1 - shiftright(k1, 37)) + 16 * (1 - shiftright(k2 - 1, 20)) + 8 * (m div 8) as int)) & 255L")
    return rows.select("k1", (F.col("k2") + (F.col("m").cast("long") * 256 + eighth.bitwiseAND(F.expr("~shiftleft(1L, m % 8)")) + 1) * (1 << 22)).alias("k2"), "fp")


def forest(group: np.ndarray) -> list[tuple[int, int]]:
    """Links that join every two members which are joined by steps of at most MAX_BITS bits."""
    left, links = group, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= MAX_BITS
            if near.any():
                found = left[near]
                links += [(at, x) for x in found]
                todo += list(found)
                left = left[~near]
    return links


def _forests(groups: DataFrame) -> DataFrame:
    def step(batch):
        links = [x for g in batch["fps"] for x in forest(g.values.to_numpy(zero_copy_only=False).view(np.uint64))]
        ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return {"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])}

    return per_batch(groups.select("fps"), step, "a long, b long")


def near_links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all at most MAX_BITS bits apart, directly or by steps."""
    rows, links = fps.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "fp"), []
    for level in range(3):
        # the rows are few and wide open: deal them out before each becomes many
        variants = _cut(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), level)
        shared = staged(
            variants.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"),
            f"variants{level}")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
        links.append(shared.filter("n = 2").filter(near).select("a", "b"))
        # the keys grow with the table: never a broadcast, which would also hide the shuffle on small tables
        members = variants.join(shared.filter("n > 2").select("k1", "k2", "n").hint("merge"), ["k1", "k2"])
        fits = members if level == 2 else members.filter(F.col("n") <= group)
        links.append(_forests(fits.groupBy("k1", "k2").agg(F.collect_list("fp").alias("fps"))))
        if level == 2 or shared.filter(F.col("n") > group).isEmpty():
            break
        rows = staged(members.filter(F.col("n") > group).select("k1", "k2", "fp"), f"crowded{level}")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rooted(fps: DataFrame) -> DataFrame:
    """``fps`` with ``root``, one fingerprint of the component that ``fp`` is in."""
    roots = components(near_links(fps.select("fp"))).withColumnRenamed("node", "fp")
    return staged(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Words are lower-cased in A-Z; three-word shingles are taken with repeats, fewer words count as one shingle. A text
    that is NULL or has no word gets fingerprint zero and is linked like any other. Rows that repeat, or share a
    doc_id, keep their rows. A NULL doc_id is never a component_id; a component of such rows alone has NULL.
    An empty table gives no rows.
    """
    marks = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    grouped = rooted(staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct"))
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marks.join(grouped.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of smallest doc_id, of rows that share it the first read.

    Rows are told apart as rows: different texts under one doc_id are different documents, and both stay if they are no
    near-duplicates; equal rows leave one. Rows without a doc_id cannot be named by a group and stay. Columns may have
    any name and type. An empty table gives no rows.
    """
    (row,) = free_names(docs, "row")
    held = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marks = staged(fingerprints(held.select(row, "text"), row).withColumnRenamed("doc_id", row), "fingerprints")
    # the rows' ids meet their fingerprints by number: both are narrow
    named = held.select("doc_id", row).filter("doc_id is not null").join(marks, row).select(
        "fp", F.struct("doc_id", F.col(row).alias("at")).alias("who"))
    firsts = named.groupBy("fp").agg(F.min("who").alias("who"))
    fps = staged(marks.groupBy("fp").agg(F.count("*").alias("n")).join(firsts, "fp", "left").select("fp", "who"), "distinct")
    stay = rooted(fps).groupBy("root").agg(F.min("who").alias("who")).select(F.col("who.at").alias(row))
    return held.join(stay, row, "left_semi").unionByName(held.filter("doc_id is null")).select(*[f"`{c}`" for c in docs.columns])
