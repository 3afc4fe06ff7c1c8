"""Words of many texts at once, as 64-bit hashes, by numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one step; a longer text is a step of its own.
STEP_BYTES = 512 << 10
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown as longer inputs come."""

    up = powers(_BASE, 1 << 12)
    down = powers(_INVERSE, 1 << 12)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(cls.up):
            if n > 4 * STEP_BYTES:  # not kept
                return powers(_BASE, n), powers(_INVERSE, n)
            cls.up, cls.down = powers(_BASE, 2 * n), powers(_INVERSE, 2 * n)
        return cls.up, cls.down


def steps(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > STEP_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def spans(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    inside = np.concatenate([[False], ~_SPACE[joined], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashed(texts: list[bytes], lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each step: first text, words' hashes, starts and ends (bytes within the step), and each text's first word (with an end)."""
    for a, b in steps(texts):
        joined = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        if lower:
            joined = _LOWER[joined]
        begins, ends = spans(joined)
        up, down = _Powers.upto(len(joined))
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
        value = mix((sums[ends] - sums[begins]) * down[begins])
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
        yield a, value, begins, ends, np.searchsorted(begins, text_at)


_PLACE = _RANDOM.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def grams(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (n is at most 64); runs across texts are the caller's to leave out."""
    if len(value) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(value) - n + 1, np.uint64)
    for j in range(n):
        total += value[j : len(value) - n + 1 + j] * _PLACE[j]
    return mix(total)


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, sorted; a shorter text's words are one shingle, no words none."""
    found: list[np.ndarray] = []
    for _, value, _, _, first in hashed([(t or "").encode("utf-8", "surrogatepass") for t in texts], lower=True):
        every = grams(value, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                found.append(np.unique(every[a : b - n + 1]))
            elif b > a:
                found.append(mix(np.array([(value[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                found.append(np.zeros(0, np.uint64))
    return found
