"""Hashed n-gram counts of whole texts, by numpy over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Buckets of byte n-grams; two more tell first from repeated word pairs.
BUCKETS = 1 << 16
SIZES = (2, 4)
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of every n-gram: hashed byte 2- and 4-grams; each pair of neighbouring words as first or repeated in its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    docs, buckets = [], []
    wide = data.astype(np.uint64)
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ wide[k : len(data) - n + 1 + k]) * _MIX[k]
            h ^= h >> np.uint64(29)
        same = owner[: len(h)] == owner[n - 1 :]
        docs.append(owner[: len(h)][same])
        buckets.append((h[same] % np.uint64(BUCKETS)).astype(np.int32))
    space = _SPACE[data]
    edge = np.ones(len(data), bool)
    edge[1:] = owner[1:] != owner[:-1]
    start = np.flatnonzero(~space & (edge | np.concatenate([[True], space[:-1]]))) if len(data) else np.zeros(0, np.int64)
    if len(start) > 1:
        # each word with the white space behind it, coded as a number
        bounds = np.append(start, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whose = owner[start]
        pair = whose[:-1] == whose[1:]
        who, key = whose[:-1][pair], (code[:-1] * (code.max() + 1) + code[1:])[pair]
        order = np.lexsort((key, who))
        who, key = who[order], key[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (who[1:] == who[:-1])
        docs.append(who)
        buckets.append(BUCKETS + again.astype(np.int32))
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(docs), np.concatenate(buckets)
