"""Lines of files in 2- or 4-byte characters, found in byte ranges by many tasks.

Spark splits a file at line feed bytes, which in UTF-16 and UTF-32 may also be halves of other
characters. Pieces between such bytes and the bytes themselves make up the file without a gap:
little-endian files get each byte with the piece after it, big-endian ones with the piece before,
so that a line end is never cut. Lengths summed up over ranges of splits give the place of every
split's first byte, hence where its characters begin; each task then finds its line ends. The
parts of lines at split edges are joined in a shuffle, as those of records are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltgate.session import pin_file_splits, scratch_table
from siltgate.sources.encodings import Encoding
from siltgate.sources.position import FILE, POSITION, SEQ, START, position_columns, ranged, running_before
from siltgate.sources.records import joined_edges, segments

#: The last place of a split, where the line that goes on beyond it is numbered.
END = "__end"
PIECES = f"{FILE} string, {START} bigint, {SEQ} bigint, {END} bigint, record binary, piece string"


def wide_lines(spark: SparkSession, files: list[str], encoding: Encoding) -> DataFrame:
    """(value, file, start, seq): lines as UTF-8, ended by LF alone. Bytes that are no characters become invalid UTF-8."""
    pin_file_splits(spark)
    unit = 4 if encoding.codec.startswith("utf-32") else 2
    scan = spark.read.option("lineSep", "\n").text(files)
    last = (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") - 1).alias(END)
    raw = scan.select(F.col("value").cast("binary"), last, F.col("_metadata.file_size").alias("size"), *position_columns())

    per_split = raw.groupBy(FILE, START).agg(
        F.sum(F.octet_length("value") + 1).alias("octets"), F.min_by(F.substring("value", 1, 4), SEQ).alias("mark")
    )
    placed = running_before(ranged(per_split, FILE, START), [FILE], [START], F.col("octets"), "offset")
    if encoding.codec.endswith(("-le", "-be")):
        splits = placed.withColumns({"big": F.lit(encoding.codec.endswith("-be")), "marked": F.lit(False)})
    else:
        # The byte order mark of either order; without one the order is little-endian.
        low, high = (F.unhex(F.lit(mark)) for mark in (("FFFE0000", "0000FEFF") if unit == 4 else ("FFFE", "FEFF")))
        mark = F.substring("mark", 1, unit)
        orders = placed.where(F.col(START) == 0).select(FILE, (mark == high).alias("big"), mark.isin(low, high).alias("marked"))
        splits = placed.join(orders, FILE)
    splits = scratch_table(splits.select(FILE, START, "offset", "big", "marked"), "wide_splits")

    started = raw.join(splits, [FILE, START]).sortWithinPartitions(FILE, START, SEQ)
    pieces = started.select(FILE, START, END, "size", "offset", "big", "marked", "value").mapInArrow(_wide_pieces(unit), PIECES)
    whole = pieces.where("piece = 'whole'").select(F.col("record").cast("string").alias("value"), *POSITION)
    return whole.union(_edge_lines(pieces, splits, unit))


def _edge_lines(pieces: DataFrame, splits: DataFrame, unit: int) -> DataFrame:
    """Lines that go on beyond a split, each at the last place of the split it starts in."""
    edges = scratch_table(pieces.where("piece <> 'whole'"), "wide_edges")
    ends = edges.where("piece = 'tail'").select(FILE, START, END)
    joined = joined_edges(edges, "").join(ends, [FILE, START]).join(splits.select(FILE, START, "big"), [FILE, START])
    # what follows a file's last line end is a line only if it is not empty
    joined = joined.where("parts > 1 OR octet_length(record) > 0").select(FILE, END, "big", "record")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_as_utf8(raw, unit, big) for raw, big in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            places = [batch.column(0), batch.column(1), pa.array(np.zeros(len(lines), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), *places], ["value", FILE, START, SEQ])

    decoded = joined.mapInArrow(read, f"value binary, {FILE} string, {START} bigint, {SEQ} bigint")
    return decoded.select(F.col("value").cast("string"), *POSITION)


def _text(raw: bytes, unit: int, big: bool) -> str:
    codec = f"utf-{8 * unit}-{'be' if big else 'le'}"
    try:
        return raw.decode(codec, "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode(codec, "replace") + "\udcff"  # a lone surrogate, which no valid UTF-8 holds


def _as_utf8(raw: bytes, unit: int, big: bool) -> bytes:
    return _text(raw, unit, big).encode("utf-8", "surrogatepass")


def _wide_pieces(unit: int):
    """Lines of a task's splits in order; the parts at a split's edges come out as they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, begun, seq, place, end, big = None, [], False, 0, 0, 0, False

        def rows(lines: list[bytes], first: int, kind: str) -> pa.RecordBatch:
            n = len(lines)
            columns = [pa.repeat(pa.scalar(split[0]), n), pa.repeat(pa.scalar(split[1], pa.int64()), n)]
            columns += [pa.array(np.arange(first, first + n)), pa.repeat(pa.scalar(end, pa.int64()), n)]
            columns += [pa.array(lines, pa.binary()), pa.repeat(pa.scalar(kind), n)]
            return pa.RecordBatch.from_arrays(columns, [FILE, START, SEQ, END, "record", "piece"])

        def finish() -> Iterator[pa.RecordBatch]:
            if split is not None:
                yield rows([b"".join(held)], seq, "tail" if begun else "middle")

        for batch in batches:
            for at, segment in segments(batch):
                if at != split:
                    yield from finish()
                    end, size, place, big, marked = (segment.column(k)[0].as_py() for k in range(2, 7))
                    split, held, begun, seq = at, [], at[1] == 0, 0
                block = b"\n".join(segment.column(7).to_pylist())
                if big:
                    begin, place = place, place + len(block) + 1
                    block += b"\n" * (place <= size)
                else:
                    begin = place - (place > 0)
                    place += len(block) + 1
                    block = b"\n" * (begin + 1 < place - len(block)) + block
                if begin == 0 and marked:
                    block, begin = block[unit:], unit
                lead = -begin % unit
                units = np.frombuffer(block, dtype=f"{'>' if big else '<'}u{unit}", offset=lead, count=max(0, len(block) - lead) // unit)
                found = np.flatnonzero(units == 10) * unit + lead
                if not len(found):
                    held.append(block)
                    continue
                first, last = int(found[0]), int(found[-1])
                if not begun:
                    yield rows([b"".join([*held, block[:first]])], -1, "head")
                    begun, held, block, last = True, [], block[first + unit :], last - first - unit
                if last >= 0:
                    text = _text(b"".join([*held, block[:last]]), unit, big)
                    lines = [line.encode("utf-8", "surrogatepass") for line in text.split("\n")]
                    yield rows(lines, seq, "whole")
                    seq, block = seq + len(lines), block[last + unit :]
                held = [block]
        yield from finish()

    return read
