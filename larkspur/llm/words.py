"""Word hashes of whole texts, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

GOLD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(GOLD), -1, 2**64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes that are hashed at once; powers of GOLD and of its inverse are kept for so many.
PART = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = powers(GOLD, PART), powers(BACK, PART)


def split_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() without arguments splits at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _hash_part(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a run of bytes that begins and ends outside words."""
    inside = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, end = edge[::2], edge[1::2]
    up, down = (_UP, _DOWN) if len(raw) <= PART else (powers(GOLD, len(raw)), powers(BACK, len(raw)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
    # Shifted to where the word begins, so that it counts the same everywhere.
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)), first


def hash_texts(texts: Iterable[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, in order; where each text's words begin, and the end). lower: A-Z count as a-z.

    A hash is a polynomial in mixed bytes, so all words of many texts are hashed by a few sums.
    """
    texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        raw = LOWER[raw]
    hashes, at, a = [], [], 0
    while a < len(raw):
        z = min(a + PART, len(raw))
        # To the end of the word that the cut falls into.
        while z < len(raw) and not SPACE[raw[z - 1]]:
            near = np.flatnonzero(SPACE[raw[z : z + PART]])
            z = z + int(near[0]) + 1 if len(near) else min(z + PART, len(raw))
        h, first = _hash_part(raw[a:z])
        hashes.append(h)
        at.append(first + a)
        a = z
    if not hashes:
        return np.empty(0, np.uint64), begin
    return np.concatenate(hashes), np.searchsorted(np.concatenate(at), begin)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words, in order."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * GOLD + h[j : len(h) - n + 1 + j]
    return mix(out)
