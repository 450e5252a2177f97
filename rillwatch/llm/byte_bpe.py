"""Byte-level BPE by longest match and backtracking.

The bytes of a pre-token become a Latin-1 string, in which an Aho-Corasick automaton over the vocabulary finds every
token at every place once. From the left the longest token is taken that may stand after the one before it; if none
may, the last one is given up for a shorter one, and a place that failed is never tried again. A sequence in which
all neighbours may stand side by side is the one that merging by rank gives, so the work is linear in the text.
Two tokens may stand side by side if merging their bytes gives just the two; that is computed once per pair.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rillwatch.llm.tables import once, per_batch, texts_of

#: entries that a task keeps of each memo; it is emptied when full
MEMO = 400_000


class Codec:
    """Encoder and decoder over a file of ranks (one base64 token and its rank a line)."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.packed = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            # a token that its own merges do not reach can never be emitted, but as a whole pre-token
            if self.merge(token) == [token]:
                self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.memo, self.fits_memo, self.ids_memo = memo, {}, {}

    def merge(self, data: bytes) -> list[bytes]:
        """Joins the neighbours of lowest rank, leftmost first, until none can be joined; for two tokens' bytes only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            best = min(ranked)
            if best == 1 << 40:
                break
            at = ranked.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        known = self.fits_memo.get((left, right))
        if known is None:
            if len(self.fits_memo) >= self.memo:
                self.fits_memo.clear()
            known = self.fits_memo[left, right] = self.merge(left + right) == [left, right]
        return known

    def tokens(self, piece: bytes) -> list[bytes]:
        """The tokens of one pre-token."""
        if piece in self.ranks:
            return [piece]
        ends: list[list[int]] = [[] for _ in piece]  # lengths of the tokens that start at each place, shortest first
        for last, n in self.automaton.iter(piece.decode("latin-1")):
            ends[last - n + 1].append(n)
        out: list[bytes] = []
        at, size = 0, len(piece)
        failed = bytearray(size + 1)
        choices = [ends[0]]
        used = [len(ends[0])]
        while at < size:
            options, i = choices[-1], used[-1] - 1
            while i >= 0:
                n = options[i]
                if not failed[at + n]:
                    token = piece[at:at + n]
                    if not out or self.fits(out[-1], token):
                        break
                i -= 1
            used[-1] = i
            if i >= 0:
                out.append(token)
                at += n
                if at < size:
                    choices.append(ends[at])
                    used.append(len(ends[at]))
            else:
                failed[at] = 1
                choices.pop()
                used.pop()
                at -= len(out.pop())
        return out

    def packed_ids(self, piece: str) -> bytes:
        data = piece.encode()
        return self.packed.get(data) or b"".join([self.packed[t] for t in self.tokens(data)])

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        memo, out = self.ids_memo, []
        if len(memo) >= self.memo:
            memo.clear()
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.packed_ids(piece)
                if len(piece) <= 64:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def codec(path: str, pattern: str) -> Codec:
    return once(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32 bit), ids_sha256, decoded_sha256 for each row of ``docs``.

    ``decoded_sha256`` is taken from the bytes that the ids decode to. ``keep_ids=False`` leaves the ids out. A NULL
    text is an empty one and has no token; repeated rows and NULL ids are kept; an empty table gives no rows.
    """
    rows = texts_of(docs)

    def step(batch):
        book, texts = codec(path, pattern), batch["text"].to_pylist()
        ids = [book.encode(t) for t in texts]
        out = {
            "doc_id": batch["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(book.decode(x)).hexdigest() for x in ids]),
        }
        return out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {})

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return per_batch(rows, step, schema, rows=500)
