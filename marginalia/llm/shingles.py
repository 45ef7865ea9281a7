"""Word shingles as sets of 64-bit fingerprints, MinHash samples and odd sketches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .suffix import Hashed, chunks, mix


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and documents of the words in a buffer of texts; none crosses documents."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = ~space[edges]
    last[edges - 1] = ~space[edges - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(bounds[1:], starts, "right")


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' distinct shingles, ascending within each, and the n + 1 bounds of the sets. A
    document with fewer than n_words words has them all as one shingle, one without words none."""
    out, counts = [], []
    for first, last in chunks(bounds):
        base = bounds[first]
        part, edges = lower_ascii(raw[base : bounds[last]]), bounds[first : last + 1] - base
        starts, stops, doc = words(part, edges)
        n = np.bincount(doc, minlength=last - first)
        code = Hashed(part).of(starts, stops) if len(starts) else np.zeros(0, np.uint64)
        begin = np.cumsum(n) - n
        place = np.arange(len(code)) - begin[doc]
        sums = np.zeros(len(code), np.uint64)
        take = np.minimum(n, n_words)[doc]
        for k in range(n_words):
            at = np.minimum(np.arange(len(code)) + k, len(code) - 1)
            sums = np.where(k < take, mix(sums * np.uint64(3) + code[at] + np.uint64(k + 1)), sums)
        sums = sums[place <= np.maximum(n - n_words, 0)[doc]]
        owner = np.repeat(np.arange(last - first), np.where(n, np.maximum(n - n_words + 1, 1), 0))
        order = np.lexsort((sums, owner))
        sums, owner = sums[order], owner[order]
        new = np.r_[True, (sums[1:] != sums[:-1]) | (owner[1:] != owner[:-1])][: len(sums)]
        out.append(sums[new])
        counts.append(np.bincount(owner[new], minlength=last - first))
    codes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return codes, np.r_[0, np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))]


@lru_cache(maxsize=2)
def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n hash functions."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return seeds[:n] | np.uint64(1), seeds[n:]


def minhash(codes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n samples of each set, one row a set; rows of empty sets are all ones."""
    sizes = np.diff(bounds)
    out = np.full((len(sizes), n), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(sizes)
    # a step of sets at a time, so that each pass stays in the cache
    for start in range(0, len(full), 128):
        some = full[start : start + 128]
        own = codes[bounds[some[0]] : bounds[some[-1] + 1]]
        starts = bounds[some] - bounds[some[0]]
        for k, (a, b) in enumerate(zip(*family(n))):
            out[some, k] = np.minimum.reduceat(own * a + b, starts)
    return out


def bands(samples: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of samples; keys of different bands differ."""
    n = samples.shape[1] // rows
    keys = np.zeros((len(samples), n), np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(5) + samples[:, k : n * rows : rows])
    return mix(keys + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Each sample of a row flips one bit of the row's bitmap."""
    n = samples.shape[1]
    at = mix(samples + np.arange(n, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)
    flat = np.arange(len(samples))[:, None] * bits + at.astype(np.int64)
    odd = (np.bincount(flat.ravel(), minlength=len(samples) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(samples), bits), axis=1)


def similarity(differing: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """The estimate from the number of bits in which two odd sketches differ."""
    rest = np.maximum(1 - 2 * np.asarray(differing) / bits, 1e-9)
    return 1 + bits / (4 * samples) * np.log(rest)
