"""Circulant MinHash signatures of word-shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quadweave.llm.words import SPACED_LOWER, Words, chunks, grams, mix, mixed, whole

K_WORDS, ROWS, BANDS = 5, 3, 24


def shingle_sets(found: Words, k: int = K_WORDS) -> list[np.ndarray]:
    """Per text its distinct shingles, sorted: runs of k words; with fewer words the whole sequence; without any, none."""
    runs, at = grams(found, k)
    out = []
    for d, n in enumerate(found.counts):
        if n >= k:
            out.append(np.unique(runs[at[d] : at[d + 1]]))
        elif n:
            out.append(np.array([whole(found.hashes[found.at[d] : found.at[d + 1]])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the 2**32 places (works in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row per non-empty set. The first permutation places each shingle on a circle of 2**32 places; coordinate c is
    the least value that the second permutation, shifted circularly by c places, gives to any of the set's places."""
    sizes = [len(s) for s in sets]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    place = (mix(np.concatenate(sets) ^ np.uint64(0x5D17)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), coordinates), np.uint32)
    for c in range(coordinates):
        out[:, c] = np.minimum.reduceat(permuted(place - np.uint32(c)), starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """Per set one 64-bit key for each band of `rows` neighbouring coordinates; keys of different bands differ."""
    n, c = signature.shape
    keys = np.empty((n, c // rows), np.uint64)
    for b in range(c // rows):
        key = np.full(n, mixed(b + 1), np.uint64)
        for x in range(rows):
            key = mix(key ^ signature[:, b * rows + x].astype(np.uint64))
        keys[:, b] = key
    return keys


def sign_batches(batches: Iterator[pa.RecordBatch], bands: int = BANDS, rows: int = ROWS, k: int = K_WORDS) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, n_shingles, set_key, bands); set_key is a 128-bit digest of the whole sorted set, null if empty."""
    for batch in batches:
        for part, found in chunks(batch.column(1), SPACED_LOWER):
            sets = shingle_sets(found, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys(signatures([sets[i] for i in full], bands * rows), rows).view(np.int64), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.start, part.stop - part.start),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ], names=["id", "n_shingles", "set_key", "bands"])
