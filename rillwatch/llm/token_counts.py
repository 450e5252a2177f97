"""Token counts without token ids.

Documents are gathered into blocks. A block is one row: its distinct pre-tokens, and for each document how often it has
which of them. Only the distinct pre-tokens of a block travel: those that are equal meet in one task, where their
pieces are counted once, and the counts go back to the blocks, to be multiplied with the frequencies and summed.

A pre-token has at most one row for each block, however frequent it is, so there are no hot keys; a block is bounded
by pre-tokens and by documents.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import once, staged, texts_of

#: a block ends at so many distinct pre-tokens, entries or documents
BLOCK_WORDS, BLOCK_ENTRIES, BLOCK_DOCS = 300_000, 4_000_000, 20_000


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers, byte planes apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, pattern: str, special: tuple[str, ...]) -> DataFrame:
    """Rows of block, doc_ids, n_bytes, special (arrays by document), words, entries, codes and times (packed).

    ``special`` strings cut a text and count as one token each.
    """
    rows = texts_of(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        find = regex.compile(pattern).findall
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        number = TaskContext.get().partitionId() << 33

        def fresh():
            return _Codes(), [], [], [], [], [], []

        def row(state):
            words, ids, sizes, marks, entries, codes, times = state
            join = lambda parts: pack(np.concatenate(parts) if parts else np.zeros(0))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "doc_ids": pa.array([ids], pa.list_(ids_type)),
                "n_bytes": pa.array([sizes], pa.list_(pa.int64())), "special": pa.array([marks], pa.list_(pa.int64())),
                "words": pa.array([list(words)], pa.list_(pa.string())), "entries": pa.array([pack(np.array(entries))], pa.binary()),
                "codes": pa.array([join(codes)], pa.binary()), "times": pa.array([join(times)], pa.binary())})

        state, total = fresh(), 0
        for batch in batches:
            ids_type = batch["doc_id"].type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                marks, size = 0, len(text.encode())
                if cut and any(s in text for s in special):
                    parts = cut.split(text)
                    marks = len(parts) - 1
                    found = Counter()
                    for part in parts:
                        found.update(find(part))
                else:
                    found = Counter(find(text))
                words, ids, sizes, all_marks, entries, codes, times = state
                own = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                order = np.argsort(own)
                codes.append(np.diff(own[order], prepend=0))
                times.append(np.fromiter(found.values(), np.int64, len(found))[order])
                ids.append(doc_id)
                sizes.append(size)
                all_marks.append(marks)
                entries.append(len(found))
                total += len(found)
                if len(words) >= BLOCK_WORDS or total >= BLOCK_ENTRIES or len(ids) >= BLOCK_DOCS:
                    yield row(state)
                    state, total, number = fresh(), 0, number + 1
        if state[1]:
            yield row(state)

    return rows.mapInArrow(run, f"block long, doc_ids array<{kind}>, n_bytes array<long>, special array<long>, words array<string>, "
                                "entries binary, codes binary, times binary")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """For rows of (word, block, code): block with packed codes and the number of pieces of each; equal words are counted once."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = once(("tokenizer", path), lambda: _tokenizer(path))
        last, n = None, 0
        for batch in batches:
            column = batch["word"].to_pylist()
            fresh = [w for before, w in zip([last, *column], column) if w != before]
            sizes = [len(e.ids) for e in count.encode_batch(fresh, add_special_tokens=False)] if fresh else []
            turn = np.cumsum([w != before for before, w in zip([last, *column], column)])
            pieces = np.array([n, *sizes], np.int64)[turn]
            last, n = column[-1], int(pieces[-1])
            block, code = batch["block"].to_numpy(), batch["code"].to_numpy()
            order = np.lexsort((code, block))
            block, code, pieces = block[order], code[order], pieces[order]
            edges = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            ends = [*edges[1:], len(block)]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(block[edges], pa.int64()),
                "codes": pa.array([pack(np.diff(code[a:b], prepend=0)) for a, b in zip(edges, ends)], pa.binary()),
                "pieces": pa.array([pack(pieces[a:b]) for a, b in zip(edges, ends)], pa.binary())})

    def some(batches):
        yield from run(b for b in batches if b.num_rows)

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(some, "block long, codes binary, pieces binary")


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, special: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for each row of ``docs``.

    A NULL or empty text has 0 bytes and 0 tokens. Rows that repeat and NULL ids are kept. An empty table gives no rows.
    """
    kind = texts_of(docs).schema["doc_id"].dataType.simpleString()
    packed = staged(blocks(docs, pattern, special), "token-blocks")
    words = packed.select("block", F.posexplode("words").alias("code", "word"))
    counts = piece_counts(words, path)

    def total(block: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: block[c][0].as_py() for c in block.column_names}
        entries, codes, times = unpack(row["entries"]), unpack(row["codes"]), unpack(row["times"])
        first = np.cumsum(entries) - entries
        sums = np.concatenate([[0], np.cumsum(codes)])
        codes = sums[1:] - np.repeat(sums[first], entries) if len(codes) else codes
        pieces = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
        for c, p in zip(found["codes"].to_pylist(), found["pieces"].to_pylist()):
            pieces[np.cumsum(unpack(c))] = unpack(p)
        sums = np.concatenate([[0], np.cumsum(pieces[codes] * times)])
        n = sums[first + entries] - sums[first] + np.array(row["special"], np.int64)
        ids = block["doc_ids"].combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    by_block = packed.select("block", "doc_ids", "n_bytes", "special", "entries", "codes", "times").groupBy("block")
    return by_block.cogroup(counts.groupBy("block")).applyInArrow(
        total, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
