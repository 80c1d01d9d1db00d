"""Words and substring hashes of whole Arrow text columns, in numpy, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handled at once. A longer text makes a slice of its own.
SLICE_BYTES = 1 << 18

#: Bytes of rows that Spark hands to a task's Python at once.
BATCH_BYTES = 2 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def bounded_batches(spark: SparkSession) -> None:
    """Cut the batches for Python by bytes, so that they are small whatever the rows' sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def space_table(spaces: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(spaces)] = True
    return table


#: The blanks of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = space_table(b" \t\n\x0b\x0c\r")


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets) of consecutive rows; null texts are empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_string()).fill_null("")
    n = len(array)
    _, offset_buffer, data_buffer = array.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        cut = offsets[first : last + 1]
        yield first, last - first, data[cut[0] : cut[-1]], cut - cut[0]
        first = last


class Hasher:
    """Hashes of substrings: a polynomial over byte values, from prefix sums modulo 2**64."""

    def __init__(self):
        self._powers = self._inverses = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n:
            size = max(n, 2 * len(self._powers))
            base = np.full(size, _BASE, dtype=np.uint64)
            inverse = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            base[0] = inverse[0] = 1
            self._powers, self._inverses = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        return self._powers, self._inverses

    def prefix(self, data: np.ndarray) -> np.ndarray:
        powers, _ = self.powers(len(data) + 1)
        return self.prefix_of(_BYTE_VALUES[data], powers)

    @staticmethod
    def prefix_of(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers[: len(values)], out=sums[1:])
        return sums

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per substring [start, end); equal substrings have equal hashes."""
        _, inverses = self.powers(len(prefix))
        lengths = (ends - starts).astype(np.uint64)
        return mix((prefix[ends] - prefix[starts]) * inverses[starts] + lengths)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes, none across a row's end; and the first run of each row."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(inside) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(inside) + 1, dtype=bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` neighbouring words."""
    total = np.full(max(0, len(words) - length + 1), length, dtype=np.uint64)
    for k in range(length):
        total = (total ^ words[k : k + len(total)]) * np.uint64(0xFF51AFD7ED558CCD)
        total ^= total >> np.uint64(31)
    return total


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``names``, in tables that hold whole groups of equal names."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        last = np.ones(len(table), dtype=bool)
        for name in names:
            value = table[name].to_numpy()
            last &= value == value[-1]
        cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def group_bounds(table: pa.Table, names: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Where each group of a table from ``whole_groups`` begins and ends."""
    fresh = np.ones(len(table), dtype=bool)
    fresh[1:] = False
    for name in names:
        value = table[name].to_numpy()
        fresh[1:] |= value[1:] != value[:-1]
    starts = np.flatnonzero(fresh).tolist()
    return zip(starts, [*starts[1:], len(table)])


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given edges connect, without circles."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = root(x), root(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out
