"""Words of texts as numpy arrays, for the operators that work on word positions.

A word is ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` gives on UTF-8. A batch of texts becomes one flat
array of word hashes with the place where each document starts, so every later step is one numpy call per batch.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

#: odd multipliers of the position-dependent sums below
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts in a row, and the place of each text's first word (one more entry: the end)."""
    per_text = [t.split() for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in per_text], out=starts[1:])
    return list(chain.from_iterable(per_text)), starts


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hash(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of ``k`` values from each place on; the last ``k - 1`` places of the array get none."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    factor = _M1 if not salt else _M2 + np.uint64(2 * salt)
    done, out, part, width = 0, None, h, 1
    left = k
    while left:
        if left & 1:
            out = part.copy() if out is None else mix(out[: len(part) - done] * factor + part[done:])
            done += width
        left >>= 1
        if left:
            part = mix(part[: len(part) - width] * factor + part[width:])
            width *= 2
    return mix(out[: len(h) - k + 1] + factor)
