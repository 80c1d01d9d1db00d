"""Lower-cased search terms of whole Arrow text columns, a bounded window of bytes at a time.

A term is a longest run of ASCII letters, ASCII digits and characters beyond ASCII; only A-Z
are lower-cased. Windows are cut between terms, so memory does not grow with a text's length. A
term longer than a window is a window of its own, hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from siltgate.llm.text import LOWER, Hasher, mix, runs

#: Bytes of text hashed at once.
WINDOW = 1 << 18

_BASE = 0x9E3779B97F4A7C15  # the base of Hasher
INSIDE = np.zeros(256, dtype=bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row's begin; null texts are empty."""
    array = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), places


def windows(data: np.ndarray, offsets: np.ndarray, limit: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of the bytes; none ends within a term."""
    begin, total = int(offsets[0]), int(offsets[-1])
    while begin < total:
        end = min(begin + limit, total)
        if end < total:
            end = _cut(data, offsets, begin, end, limit)
        yield begin, end
        begin = end


def _cut(data: np.ndarray, offsets: np.ndarray, begin: int, end: int, limit: int) -> int:
    """The last place up to ``end`` between two terms, else the end of the term that fills the window."""
    outside = np.flatnonzero(~INSIDE[data[begin:end]])
    place = begin + int(outside[-1]) + 1 if len(outside) else begin
    place = max(place, int(offsets[np.searchsorted(offsets, end, "right") - 1]))
    if place > begin:
        return place
    row_end = int(offsets[np.searchsorted(offsets, begin, "right")])
    for at in range(end, row_end, limit):
        outside = np.flatnonzero(~INSIDE[data[at : min(at + limit, row_end)]])
        if len(outside):
            return at + int(outside[0])
    return row_end


def _long_hash(data: np.ndarray, begin: int, end: int, hasher: Hasher, limit: int) -> np.ndarray:
    """What ``Hasher.between`` gives for one term, from its pieces."""
    total, shift, step = end - begin, 1, pow(_BASE, limit, 1 << 64)
    for at in range(begin, end, limit):
        total += int(hasher.prefix(LOWER[data[at : min(at + limit, end)]])[-1]) * shift
        shift = shift * step % (1 << 64)
    return mix(np.array([total % (1 << 64)], dtype=np.uint64))


def terms(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, limit: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, start, end) of every term, window by window; rows ascend."""
    for begin, end in windows(data, offsets, limit):
        if end - begin > limit:
            starts, ends = np.array([begin]), np.array([end])
            hashes = _long_hash(data, begin, end, hasher, limit)
        else:
            local = LOWER[data[begin:end]]
            edges = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end, "right")] - begin
            starts, ends, _ = runs(INSIDE[local], edges)
            hashes = hasher.between(hasher.prefix(local), starts, ends)
            starts, ends = starts + begin, ends + begin
        yield np.searchsorted(offsets, starts, "right") - 1, hashes, starts, ends


class Vocabulary:
    """Terms in a fixed order, found in windows by hash and confirmed byte by byte."""

    def __init__(self, found: Iterable[bytes]):
        self.words = sorted(set(found))
        self.place = {word: k for k, word in enumerate(self.words)}
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        self.data = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        hasher = Hasher()
        hashes = [h for _, h, _, _ in terms(self.data, self.first, hasher)]
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.order = np.argsort(self.hashes, kind="stable")
        self.keys = self.hashes[self.order]

    def __len__(self) -> int:
        return len(self.words)

    def find(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of a window's terms are in the vocabulary, and their places in it."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        which = np.flatnonzero(self.keys[at] == hashes)
        term = self.order[at[which]]
        lengths = ends[which] - starts[which]
        equal = lengths == self.lengths[term]
        if equal.any():
            inner = np.arange(lengths[equal].sum()) - np.repeat(np.cumsum(lengths[equal]) - lengths[equal], lengths[equal])
            own = LOWER[data[np.repeat(starts[which][equal], lengths[equal]) + inner]]
            same = own == self.data[np.repeat(self.first[term[equal]], lengths[equal]) + inner]
            equal[equal] = np.logical_and.reduceat(same, np.cumsum(lengths[equal]) - lengths[equal])
        for k in np.flatnonzero(~equal):  # another term with the same hash
            term[k] = self.place.get(LOWER[data[starts[which[k]] : ends[which[k]]]].tobytes(), -1)
        return which[term >= 0], term[term >= 0]
