"""Hashes of byte strings: of all short ones of a text at once, and digests of longer ones."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, the first byte highest, so that numbers sort as bytes do."""
    x = raw.astype("u8")
    for width in (1, 2, 4):
        x = x[:-width] << np.uint64(8 * width) | x[width:]
    return x


def grams(eight: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes (a multiple of 8) at each place, from ``eights``."""
    n = max(0, len(eight) - k + 8)
    out = np.full(n, 0x9E3779B97F4A7C15, "u8")
    for at in range(0, k, 8):
        out = (out ^ eight[at : at + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray, tags: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` bytes for each span of ``data`` and its tag: equal for equal bytes and tags only."""
    found = b"".join([blake2b(data[a:b], digest_size=size, salt=t.to_bytes(8, "little")).digest() for a, b, t in zip(starts.tolist(), ends.tolist(), tags.tolist(), strict=True)])
    return np.frombuffer(found, "u1").reshape(-1, size)


def number(columns: np.ndarray, kind: str) -> np.ndarray:
    """Some columns of ``digests`` as one number a row."""
    return np.ascontiguousarray(columns).view(kind).reshape(-1)


class WordHashes(dict):
    """Eight-byte digests of words, cached within bounds by a Python worker."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 150_000:
            self.clear()
        self[word] = out = blake2b(word, digest_size=8).digest()
        return out
