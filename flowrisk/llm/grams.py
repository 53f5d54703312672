"""Hashed character n-grams, words and word shingles of whole texts, as numpy arrays."""

from __future__ import annotations

import sys

import numpy as np
import xxhash

from flowrisk.llm.common import worker_cache

_ODD = np.random.default_rng(20240607).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])
    return cache["letters"]


def char_grams(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams; none if the text is shorter."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    total = wide[:size] * _ODD[0]
    for k in range(1, n):
        total += wide[k:k + size] * _ODD[k]
    return mixed(total)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space."""
    inside = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(points))
    at[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(points))))
    spots = (points.astype(np.uint64) + np.uint64(1)) * _ODD[40] + at.astype(np.uint64) * _ODD[41]
    values = np.where(inside, mixed(spots), np.uint64(0))
    return mixed(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of the text with A-Z lower-cased, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1:].tolist())], np.uint64)
