"""Repeated passages by De Bruijn compaction.

Edges are token k-mers. Of the 10-word runs in a 35-word window the one with the smallest hash, the first of equal ones,
is the window's anchor; the words of all windows in a row that have the same anchor are one edge of 35 to 60 words. Nodes
are the 34 words that an edge shares with the next one of its text: its tail and its head. Edges whose anchor occurs
once hold no window that repeats and leave before any join.

Edges that occur twice or more form the graph, one row for each with the source coordinates (row, place among the edges of the
text) of its first occurrence. A node with one such edge in and one out does not branch and links the two. Edges
linked in a row are one path. They are compacted by joins: first along the documents their sources lie in, then by doubling
of pointers between the pieces, which takes as many rounds as the logarithm of the pieces of the longest path.

Occurrences join the edge at their source by all its hashes (tail and head cover every word of it, as the edge does, so
each word is compared by two hashes of 64 bits). Those in a row along one path are one long repeated span. What is left
are edges that occur once at an anchor that occurs elsewhere too, at the ends of passages and documents: their windows,
and those of one occurrence of each repeated edge at that anchor, are verified one by one, by a 128-bit hash of their words.

Counting combines before the shuffle, and joins with the counts are joins the engine can split, so a passage that a
third of all documents share is no bottleneck.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.llm.tables import per_batch, staged, texts_of, utf8
from rillwatch.llm.words import hash_words, mix, run_hash, split_words

WINDOW = 35
K = 10
SPAN = WINDOW - K + 1
#: documents worked on at once in a task
SLICE = 500

_C = np.uint64(0xD6E8FEB86659FD93)
_C_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: what is known of the windows of edges in a row: they repeat; they repeat and speak for others like them; they are open
KNOWN, SPEAKS, OPEN = 0, 1, 2
#: all that tells one edge from another
EDGE = ["anchor", "edge", "tail", "head"]


def stretch_hash(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from each ``begin`` up to ``end``."""
    n = len(h)
    power = np.full(n + 1, _C)
    back = np.full(n + 1, _C_BACK)
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h) * power[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def leftmost_least(a: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of ``w`` neighbours from each place on, the first of equal ones."""
    if len(a) < w:
        return np.zeros(0, np.int64)
    value, place, have = a, np.arange(len(a)), 1
    while have < w:
        step = min(have, w - have)
        first = value[:-step] <= value[step:]
        value = np.where(first, value[:-step], value[step:])
        place = np.where(first, place[:-step], place[step:])
        have += step
    return place


class Places:
    """Windows of several documents by their anchor: ``h`` their word hashes in a row, ``starts`` where each begins, and the end."""

    def __init__(self, h: np.ndarray, starts: np.ndarray):
        n = len(h)
        self.h, self.starts = h, starts
        self.runs = run_hash(h, K)
        windows = np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(starts[1:], np.diff(starts)))
        anchor = leftmost_least(self.runs, SPAN)[windows]
        # windows with the same anchor follow one another: an edge holds them all
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.at = anchor[first]
        self.begin = windows[first]
        self.until = windows[np.append(first[1:], len(windows)) - 1] + 1 if len(first) else first
        self.doc = np.searchsorted(starts, self.at, side="right") - 1

    def edges(self) -> dict[str, np.ndarray]:
        """Hashes of each edge: its anchor, all its words, the node it comes from and the node it leads to."""
        words = stretch_hash(self.h, self.begin, self.until - 1 + WINDOW)
        nodes = run_hash(self.h, WINDOW - 1, salt=2)
        return {"anchor": self.runs[self.at], "edge": mix(words + (self.at - self.begin).astype(np.uint64)),
                "tail": nodes[self.begin], "head": nodes[self.until]}

    def first(self) -> np.ndarray:
        """The number of the first edge of each document."""
        return np.searchsorted(self.doc, np.arange(len(self.starts) - 1))


def _places(texts: list[bytes]) -> tuple[Places, list[bytes]]:
    words, starts = split_words(texts)
    return Places(hash_words(words), starts), words


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


def edges_of(packed: DataFrame) -> DataFrame:
    """One row for each edge of each packed text: row, place among the text's edges, hashes."""

    def step(batch):
        p, _ = _places([zstandard.decompress(z) for z in batch["z"].to_pylist()])
        place = np.arange(len(p.doc)) - p.first()[p.doc]
        return {"rid": pa.array(batch["rid"].to_numpy()[p.doc]), "place": pa.array(place.astype(np.int32)),
                **{c: _signed(v) for c, v in p.edges().items()}}

    return per_batch(packed.select("rid", "z"), step, "rid long, place int, anchor long, edge long, tail long, head long", rows=SLICE)


def links_of(edges: DataFrame) -> DataFrame:
    """``before`` and ``after``: the two edges (``id``) of each node with one edge in and one out."""
    enter = edges.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n"), F.min("id").alias("before")).filter("n = 1")
    leave = edges.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("n"), F.min("id").alias("after")).filter("n = 1")
    return enter.drop("n").join(leave.drop("n"), "node").filter("before <> after").drop("node")


def compact(edges: DataFrame) -> DataFrame:
    """The path of each edge (``id, rid, place, tail, head``): ``id, path, rank``, a path named by its first edge.

    Each edge has at most one before it and one after it. Edges whose sources follow one another in a document are one
    piece, numbered there. A piece then points at the piece before it, and every round joins pieces with those they point at and
    lets them point where these do; no two open pieces point at the same one. A piece done points at a path's first one. When a
    round ends none, those left lie on circles, which are cut between pieces.
    """
    linked = edges.select("id", "rid", "place").join(links_of(edges), F.col("id") == F.col("after"), "left").drop("after")
    source = Window.partitionBy("rid").orderBy("place")
    begins = F.col("before").isNull() | ~F.lag("id").over(source).eqNullSafe(F.col("before"))
    numbered = linked.withColumn("begins", begins).withColumn("i", F.row_number().over(source))
    pieces = staged(numbered.select(
        "id", "begins", F.when(F.col("begins"), F.col("before")).alias("before"),
        F.last(F.when(F.col("begins"), F.col("id")), ignorenulls=True).over(source).alias("piece"),
        (F.col("i") - F.max(F.when(F.col("begins"), F.col("i"))).over(source)).alias("steps")), "pieces")
    ends = pieces.select(F.col("id").alias("before"), F.col("piece").alias("up"), (F.col("steps") + 1).cast("long").alias("far"))
    up = staged(pieces.filter("before is not null").select("piece", "before").join(ends, "before").select(
        "piece", "up", "far", F.lit(False).alias("done")), "up")
    left, had = up.count(), None
    while left and left != had:
        over = up.select(F.col("piece").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("done").alias("ended"))
        moved = up.filter("not done").join(over, "up", "left").select(
            "piece", F.coalesce("next", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"),
            F.coalesce("ended", F.lit(True)).alias("done"))
        up = staged(up.filter("done").unionByName(moved), "up")
        left, had = up.filter("not done").count(), left
    return pieces.join(up.filter("done").drop("done"), "piece", "left").select(
        "id", F.coalesce("up", "piece").alias("path"), (F.col("steps") + F.coalesce("far", F.lit(0))).alias("rank"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Values of ``keys`` that occur twice or more."""
    return rows.groupBy(*keys).count().filter("count > 1").drop("count")


_RESULT = "n_words long, n_removed long, kept_sha256 string"


def _kept(words: list[bytes], gone: np.ndarray) -> dict:
    kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
    return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


def _covered(n: int, begins, ends) -> np.ndarray:
    """Marks the places from each begin up to its end."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _judge(batch):
    """Documents with their spans of edges: the result where it is settled, else spans and windows to verify."""
    texts = [zstandard.decompress(z) for z in batch["z"].to_pylist()]
    p, words = _places(texts)
    found = batch["found"].combine_chunks() if isinstance(batch["found"], pa.ChunkedArray) else batch["found"]
    spans = found.flatten()
    first, last, state = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last", "state"))
    of = np.repeat(p.first(), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    begin, until, n = p.begin[first + of], p.until[last + of], len(p.h)
    known = _covered(n, begin[state != OPEN], until[state != OPEN])
    open_at = np.flatnonzero(_covered(n, begin[state != KNOWN], until[state != KNOWN]))
    open_doc = np.searchsorted(p.starts, open_at, side="right") - 1
    n_open = np.bincount(open_doc, minlength=len(texts))
    h1, h2 = run_hash(p.h, WINDOW), run_hash(p.h, WINDOW, salt=1)
    out = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "z", "paths")}
    for d, z in enumerate(batch["z"].to_pylist()):
        b, e = p.starts[d], p.starts[d + 1]
        windows = np.flatnonzero(known[b:e])
        # spans that meet are one
        cut = np.flatnonzero(np.diff(windows) > 1)
        begins = windows[np.concatenate([[0], cut + 1])] if len(windows) else windows
        ends = windows[np.concatenate([cut, [len(windows) - 1]])] + WINDOW if len(windows) else windows
        if n_open[d]:
            row = {"n_words": None, "n_removed": None, "kept_sha256": None, "z": z,
                   "paths": np.stack([begins, ends]).astype("<i4").tobytes()}
        else:
            row = {**_kept(words[b:e], _covered(e - b, begins, ends)), "z": None, "paths": None}
        for c, v in row.items():
            out[c].append(v)
    return {
        "rid": batch["rid"], "doc_id": batch["doc_id"], "n_words": pa.array(out["n_words"], pa.int64()),
        "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
        "z": pa.array(out["z"], pa.binary()), "paths": pa.array(out["paths"], pa.binary()),
        "starts": _lists(open_at - p.starts[open_doc], n_open, "int32"),
        "h1": _lists(h1[open_at].view(np.int64), n_open, "int64"), "h2": _lists(h2[open_at].view(np.int64), n_open, "int64"),
    }


def _settle(batch):
    """Documents with the windows that turned out to repeat."""
    out = []
    for z, paths, starts in zip(batch["z"].to_pylist(), batch["paths"].to_pylist(), batch["again"].to_pylist()):
        words = zstandard.decompress(z).split()
        begins, ends = np.frombuffer(paths, "<i4").reshape(2, -1)
        again = np.array(starts or [], np.int64)
        gone = _covered(len(words), np.concatenate([begins, again]), np.concatenate([ends, again + WINDOW]))
        out.append(_kept(words, gone))
    return {"doc_id": batch["doc_id"], **{c: pa.array([r[c] for r in out], pa.string() if c == "kept_sha256" else pa.int64())
                                          for c in ("n_words", "n_removed", "kept_sha256")}}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space.

    A word goes if it lies in a window of 35 words of its document that also starts anywhere else, in the same
    document too. A NULL, empty or blank text has no words. Rows that repeat are places of their own, so they remove
    each other if they have 35 words. A NULL doc_id is kept. An empty table gives no rows. Rows are numbered once, in a
    written table that all later scans read, so it does not matter how a scan is cut into tasks.
    """
    rows = texts_of(docs).withColumn("rid", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batch):
        return {"rid": batch["rid"], "doc_id": batch["doc_id"],
                "z": pa.array([zstandard.compress(t, 1) for t in utf8(batch["text"])], pa.binary())}

    packed = staged(per_batch(rows, pack, f"rid long, doc_id {kind}, z binary"), "texts")
    edges = staged(edges_of(packed), "edges")
    # counts are written before they are joined: a join of two plain shuffles is one that the engine splits at hot keys
    anchors = edges.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("edge") != F.max("edge")).alias("branches")).filter("n > 1")
    edges = staged(edges.join(staged(anchors.drop("n"), "anchors"), "anchor"), "edges-again")
    source = F.min(F.struct("rid", "place")).alias("source")
    graph = edges.groupBy(*EDGE).agg(F.count("*").alias("n"), F.max("branches").alias("branches"), source).filter("n > 1").select(
        F.monotonically_increasing_id().alias("id"), *EDGE, "branches", "source.rid", "source.place")
    graph = staged(graph, "graph")
    speakers = graph.filter("branches").select("rid", F.col("place").alias("first"), F.col("place").alias("last"), F.lit(SPEAKS).alias("state"))
    paths = staged(graph.select("id", *EDGE).join(compact(graph.drop("anchor", "edge", "branches")), "id").drop("id"), "paths")
    # edges in a row along a path keep the distance between place and rank; an edge without a path is a span of its own
    along = edges.join(paths, EDGE, "left").select(
        "rid", "place", F.coalesce("path", F.lit(-1)).alias("path"), F.coalesce(F.col("place") - F.col("rank"), "place").alias("shift"))
    # the same distance on both sides of a stretch that left the path makes two spans
    row = Window.partitionBy("rid", "path", "shift").orderBy("place")
    along = along.repartition("rid").withColumn("run", F.col("place") - F.row_number().over(row))
    spans = along.groupBy("rid", "path", "shift", "run").agg(F.min("place").alias("first"), F.max("place").alias("last")).select(
        "rid", "first", "last", F.when(F.col("path") < 0, OPEN).otherwise(KNOWN).alias("state"))
    found = spans.unionByName(speakers).groupBy("rid").agg(F.collect_list(F.struct("first", "last", "state")).alias("found"))
    judged = packed.join(found, "rid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<first:int,last:int,state:int>>")))
    judged = staged(per_batch(judged, _judge, f"rid long, doc_id {kind}, {_RESULT}, z binary, paths binary, starts array<int>, "
                              "h1 array<long>, h2 array<long>", rows=SLICE), "judged")
    windows = judged.select("rid", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select(
        "rid", "w.starts", "w.h1", "w.h2")
    again = windows.join(staged(repeated(windows, "h1", "h2"), "repeated-windows"), ["h1", "h2"]).groupBy("rid").agg(F.collect_list("starts").alias("again"))
    rest = per_batch(judged.filter("z is not null").select("rid", "doc_id", "z", "paths").join(again, "rid", "left"), _settle,
                     f"doc_id {kind}, {_RESULT}", rows=SLICE)
    return judged.filter("z is null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(rest)
