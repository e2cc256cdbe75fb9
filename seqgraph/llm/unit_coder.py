"""Encodes whole texts by their units (words, or words with the spaces before them), each distinct unit once a worker.

A tokenizer whose tokens never cross unit bounds gives the same ids unit by unit. The units of a slice of texts are
hashed in numpy; only units that the worker hasn't met go through the tokenizer.

A unit is known by its 64-bit hash; its length, first and last eight bytes are compared too, so that a kept unit never
answers for another one. Two units of one slice with the same hash would be taken for one (a slice holds about 10^5
units: a chance of 3 in 10^10).
"""

from __future__ import annotations

import numpy as np

from .common import Hash, mix64

_HASH = Hash(47, spaces=True)


def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What tells units apart beside their hash: length, first and last eight bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    step = np.arange(8)
    out = (ends - starts).astype(np.uint64)
    for at in (starts[:, None] + step, ends[:, None] - 1 - step):
        inside = (at >= starts[:, None]) & (at < ends[:, None])
        eight = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
        out = mix64(out ^ np.ascontiguousarray(eight).view("<u8").ravel())
    return out


class UnitCoder:
    """`encode` maps a list of unit byte strings (with their marks) to a list of id lists; `most` bounds the units kept."""

    def __init__(self, encode, most: int = 2_000_000, most_ids: int = 16_000_000):
        self.encode, self.most, self.most_ids = encode, most, most_ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.marks = np.empty(0, np.uint64)
        self.pool, self.used = np.empty(1 << 12, np.int32), 0

    def _learn(self, keys: np.ndarray, marks: np.ndarray, units: list) -> None:
        if len(self.keys) + len(keys) > self.most or self.used > self.most_ids:
            self.clear()
        found = self.encode(units)
        size = np.fromiter(map(len, found), np.int32, len(found))
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(total, len(self.pool)), np.int32)])
        flat = np.fromiter((i for ids in found for i in ids), np.int32, total)
        self.pool[self.used : self.used + total] = flat
        at = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += total
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.marks = np.insert(self.marks, where, marks)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return where, known

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray | None, doc_first: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents one after another, and the documents' bounds in them.

        Units doc_first[d]:doc_first[d + 1] belong to document d. A unit's mark (0 or 1) is part of its identity.
        """
        hashes = _HASH.words(data, starts, ends)
        if marks is not None:
            hashes = hashes ^ (marks.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        where, known = self._places(keys)
        seen = _marks(data, starts[first], ends[first])
        other = bool((self.marks[where[known]] != seen[known]).any())  # a kept unit has another one's hash
        if other or not known.all():
            new = np.flatnonzero(~known)
            if other or len(self.keys) + len(new) > self.most or self.used > self.most_ids:  # start afresh with this slice's units
                self.clear()
                new = np.arange(len(keys))
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), (marks[first[new]] if marks is not None else np.zeros(len(new), np.int8)).tolist())
            self._learn(keys[new], seen[new], [(data[a:b].tobytes(), m) for a, b, m in spans])
            where, _ = self._places(keys)
        size, at = self.size[where][inverse].astype(np.int64), self.at[where][inverse]
        begin = np.cumsum(size) - size
        total, docs = int(size.sum()), len(doc_first) - 1
        steps = np.arange(total, dtype=np.int64)
        ids = self.pool[np.repeat(at - begin, size) + steps]
        bounds = np.append(begin, total)[doc_first]
        if end_id is None:
            return ids, bounds
        out = np.empty(total + docs, np.int32)
        ends_at = bounds[1:] + np.arange(docs)
        kept = np.ones(len(out), bool)
        kept[ends_at] = False
        out[kept] = ids
        out[ends_at] = end_id
        return out, bounds + np.arange(docs + 1)
