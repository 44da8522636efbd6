"""Token ids of whole texts by the ``tokenizers`` library, each distinct unit encoded once.

A text is cut where every supported pre-tokenizer ends a match whatever stands
to the left: before a run of ASCII white space that follows a character which is
no white space, and between an ASCII letter and ASCII punctuation.  No pattern
crosses such a place, so a text's ids are its units' ids in order, and a unit
needs the library only the first time it is seen.  A text that holds the opening
of a special token goes through the library whole.

The cache starts anew for the next block once it holds more than ``CACHE_UNITS``
units, so it never holds more than that and one block's.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

CACHE_UNITS = 600_000
#: Bytes of text that are cut and looked up at once.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(rb" ?[A-Za-z]+").fullmatch
_WS, _LETTER, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_WS[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT[[*b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = True


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` is white space outside ASCII."""
    b1 = data[at]
    b2, b3 = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    return (
        ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)))
        | ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80))
        | ((b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF)))
        | ((b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F))
        | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
    )


def cut_points(data: np.ndarray) -> np.ndarray:
    """Whether a unit may start at each byte of UTF-8 text; never at the first."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    ws = _WS[data]
    cut[1:] = ~ws[:-1] & ws[1:]
    wide = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80))
    cut[wide[_wide_space(data, wide)] + 1] = False
    cut[1:] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    return cut


class UnitEncoder:
    """``encode(texts)`` gives all ids, one after another, and where each text's start."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.marks = sorted({t[:2].encode() for t in special})
        self.model = self.tok.model
        self.lower = len(self.tok.encode(" A", add_special_tokens=False)) == 1 and self.tok.encode("A", add_special_tokens=False).ids == self.tok.encode(" a", add_special_tokens=False).ids
        self.cache: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache.clear()
        self.flat, self.where, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def _one_word(self, unit: bytes) -> list[int] | None:
        """Ids of ASCII letters after at most one space: one pre-token, so the model alone decides."""
        if not (_WORD(unit)):
            return None
        word = unit.decode()
        if self.lower:
            return [t.id for t in self.model.tokenize(word.lstrip(" ").lower())]
        return [t.id for t in self.model.tokenize(word.replace(" ", "\u0120"))]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, ends, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_BYTES):
                size += len(texts[to])
                to += 1
            got, n = self._block(texts[at:to])
            ids.append(got)
            ends.append(n)
            at = to
        n = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(n)])

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = {i for i, t in enumerate(texts) if any(m in t for m in self.marks)}
        sizes = np.array([0 if i in whole else len(t) for i, t in enumerate(texts)], np.int64)
        data = np.frombuffer(b"".join(t for i, t in enumerate(texts) if i not in whole), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        cut = cut_points(data)
        cut[begin[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32)
        n_units = len(starts)
        units = pa.Array.from_buffers(pa.binary(), n_units, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        place, flat, lengths = self._ids_of(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[which]
        total = int(n.sum())
        first = np.cumsum(n) - n
        ids = flat[np.repeat(place[which] - first, n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        # ids of each text
        unit_of = np.searchsorted(starts, begin)
        sums = np.concatenate([[0], np.cumsum(n)])
        per = sums[unit_of[1:]] - sums[unit_of[:-1]]
        if whole:
            parts = np.split(ids, np.cumsum(per)[:-1]) if len(per) else []
            for i in whole:
                parts[i] = np.array(self._library([texts[i].decode("utf-8", "replace")])[0], np.uint32)
                per[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, per

    def _ids_of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of ids of each distinct unit, in the array given second."""
        units = distinct.to_pylist()
        if len(self.cache) > CACHE_UNITS:
            self._reset()
        slot = np.fromiter((self.cache.get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(slot < 0)
        lists = [self._one_word(units[i]) for i in new]
        rest = [k for k, ids in enumerate(lists) if ids is None]
        for k, ids in zip(rest, self._library([units[new[k]].decode("utf-8", "replace") for k in rest])):
            lists[k] = ids
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lens.sum())
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.uint32, total)])
        where = np.concatenate([self.where, len(self.flat) + np.cumsum(lens) - lens])
        lens = np.concatenate([self.lens, lens])
        old = len(self.lens)
        slot[new] = np.arange(old, len(lens))
        self.flat, self.where, self.lens = flat, where, lens  # before the cache, which points into them
        self.cache.update((units[i], k) for k, i in enumerate(new, old))
        return where[slot], flat, lens[slot]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> UnitEncoder:
    """An encoder that a Python worker keeps from task to task, with the units it has met."""
    return UnitEncoder(path)
