"""Records that span lines, put together in parallel.

Whether a line break ends a record depends on the quotes before it in the file: an even number
means it does. Counting quotes per split and summing them up over ranges of splits gives every
split the parity it starts with, so each task can tell records apart on its own. Only the pieces at split edges, at most two per split,
are joined in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siltgate.errors import fail
from siltgate.session import pin_file_splits, scratch_table
from siltgate.sources.position import FILE, SEQ, START, position_columns, ranged, running_before

# A quoted cell; possessive, so that long cells need neither stack nor backtracking.
QUOTED_CELL = '"[^"]*+(?:""[^"]*+)*+"'

RECORDS = f"{FILE} string, {START} bigint, {SEQ} bigint, record binary, piece string"
_SCHEMA = pa.schema(
    [(FILE, pa.string()), (START, pa.int64()), (SEQ, pa.int64()), ("record", pa.binary()), ("piece", pa.string())]
)


def raw_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines, ended by LF alone, as bytes with their positions."""
    pin_file_splits(spark)
    return spark.read.option("lineSep", "\n").text(files).select(F.col("value"), *position_columns())


def quote_count(value: Column) -> Column:
    return F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))


def literal_quote(line: Column, separators: str) -> Column:
    """Whether a line has an odd number of quotes, and none that opens a cell without closing it."""
    bare = F.regexp_replace(line, f"(?<=^|{separators}){QUOTED_CELL}", "")
    return (quote_count(line) % 2 == 1) & ~bare.rlike(f'(?:^|{separators})"')


def last_literal(value: Column, separators: str) -> Column:
    """Aggregate: whether a split's last filled line ends outside quotes although their number is odd."""
    filled = ~value.isin("", "\r")
    return F.max(F.when(filled, F.struct(F.col(SEQ), literal_quote(value, separators).alias("literal"))))["literal"]


def ends_in_quotes(quotes: Column, literal: Column) -> Column:
    """Aggregate over a file's splits: whether it ends within a quoted cell.

    An odd number of quotes leaves a cell open, unless the last line holds the odd one amid a
    cell's text.
    """
    at_end = F.max(F.when(literal.isNotNull(), F.struct(F.col(START), literal.alias("literal"))))["literal"]
    return (F.sum(quotes) % 2 == 1) & ~F.coalesce(at_end, F.lit(False))


def split_quotes(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, start, odd, spans, literal) per split, sorted into ranges, from one pass over the lines.

    ``odd``: the split holds an odd number of quotes. ``spans``: some line of it is no record,
    because it holds an odd number of quotes or only white space.
    """
    value = F.col("value")
    only_space = ~value.isin("", "\r") & value.rlike(r"\A[\x00-\x20]+\z")
    per_split = lines.groupBy(FILE, START).agg(
        (F.sum(quote_count(value)) % 2).alias("odd"), F.bool_or((quote_count(value) % 2 == 1) | only_space).alias("spans"),
        last_literal(value, re.escape(delimiter)).alias("literal"),
    )
    return ranged(per_split, FILE, START)


def records_span_lines(quotes: DataFrame, path: str) -> bool:
    """Whether some line is no record of its own. A file that ends within quotes is refused."""
    files = quotes.groupBy(FILE).agg(ends_in_quotes(F.col("odd"), F.col("literal")).alias("open"), F.bool_or("spans").alias("spans"))
    found = files.agg(F.bool_or("spans").alias("spans"), F.min(F.when(F.col("open"), F.col(FILE))).alias("open")).first()
    if found.open is not None:
        raise fail("source.read_failed", "A file ends within a quoted cell.", path=path, file=found.open)
    return bool(found.spans)


def spanning_records(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """(file, start, seq, record): raw records; seq counts the records that start in a split.

    ``lines`` are raw lines with their positions. ``quotes``, a :func:`ranged` table, has whether
    a split's quotes are ``odd`` in number, for every split of the files to read; lines of others
    are left out. Every file must end outside quotes, see :func:`records_span_lines`.
    """
    before = running_before(quotes, [FILE], [START], F.col("odd"), "before")
    parities = scratch_table(before.select(FILE, START, (F.col("before") % 2).alias("inside")), "parities")
    # Spark knows the written table's size and joins accordingly; tasks then get lines in order.
    started = lines.join(parities, [FILE, START]).sortWithinPartitions(FILE, START, SEQ)
    started = started.select(FILE, START, "inside", F.col("value").cast("binary"))
    pieces = started.mapInArrow(_pieces, RECORDS)
    whole = pieces.where("piece = 'whole'").select(FILE, START, SEQ, "record")

    edges = scratch_table(pieces.where("piece <> 'whole'"), "edges")
    return whole.union(joined_edges(edges, "\n").drop("parts"))


def joined_edges(edges: DataFrame, separator: str) -> DataFrame:
    """(file, start, seq, record, parts): what begins in one split and goes on in others.

    A tail opens a record; heads and middles of the splits that follow belong to it. Which
    record a piece belongs to is found from keys alone; bytes are shuffled by record.
    """
    so_far = Window.partitionBy(FILE).orderBy(START, F.col("piece") == "tail").rowsBetween(Window.unboundedPreceding, 0)
    opened = edges.select(FILE, START, "piece", F.count_if(F.col("piece") == "tail").over(so_far).alias("opened"))
    order = F.struct(START, (F.col("piece") == "tail").alias("last"), SEQ, "record")
    joined = edges.join(opened, [FILE, START, "piece"]).groupBy(FILE, "opened").agg(F.array_sort(F.collect_list(order)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda part: part["record"].cast("string")), separator)
    return joined.select(
        FILE, F.col("parts")[0][START].alias(START), F.col("parts")[0][SEQ].alias(SEQ), text.cast("binary").alias("record"), F.size("parts").alias("parts")
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task's splits, line by line in order; edges come out as pieces."""
    split, held, inside, seq, begun = None, [], 0, 0, False

    def finish() -> Iterator[pa.RecordBatch]:
        if held:
            kind = ("tail" if inside else "whole") if begun else "middle" if inside else "head"
            record = b"\n".join(line for part in held for line in part.to_pylist())
            yield _batch(split, pa.array([seq if begun else -1]), pa.array([record], pa.binary()), kind)

    for batch in batches:
        for at, segment in segments(batch):
            if at != split:
                yield from finish()
                split, held, seq, begun, inside = at, [], 0, False, int(segment.column(2)[0].as_py())
            lines = segment.column(3)
            quotes = _quotes(lines)
            before = (inside + np.concatenate(([0], np.cumsum(quotes)[:-1]))) % 2
            inside = int((inside + quotes.sum()) % 2)
            blank = np.asarray(pc.is_in(lines, value_set=pa.array([b"", b"\r"], pa.binary())))
            kept = ~((before == 0) & blank)
            lines, before = lines.filter(pa.array(kept)), before[kept]
            starts = np.flatnonzero(before == 0)
            lead = int(starts[0]) if len(starts) else len(lines)
            if lead:
                held.append(lines.slice(0, lead))
            if not len(starts):
                continue
            # The record held so far ends where the next one starts.
            open_before = inside
            inside = 0
            yield from finish()
            seq, inside = seq + int(begun and bool(held)), open_before
            held, begun = [], True
            last = len(starts) - 1
            if last:
                ends = pa.array(starts, pa.int32())
                lists = pa.ListArray.from_arrays(ends, lines.slice(0, int(starts[last])))
                yield _batch(split, pa.array(np.arange(seq, seq + last)), pc.binary_join(lists, b"\n"), "whole")
                seq += last
            held = [lines.slice(int(starts[last]))]
    yield from finish()


def segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Runs of rows of one split."""
    if not batch.num_rows:
        return
    starts = np.asarray(batch.column(1))
    files = pc.run_end_encode(batch.column(0))
    edges = {0, batch.num_rows, *np.asarray(files.run_ends).tolist(), *(np.flatnonzero(np.diff(starts)) + 1).tolist()}
    cuts = sorted(edges)
    for begin, end in zip(cuts, cuts[1:]):
        segment = batch.slice(begin, end - begin)
        yield (segment.column(0)[0].as_py(), segment.column(1)[0].as_py()), segment


def _quotes(lines: pa.Array) -> np.ndarray:
    return np.asarray(pc.count_substring(lines, '"'), dtype=np.int64)


def _batch(split: tuple[str, int], seq: pa.Array, records: pa.Array, piece: str) -> pa.RecordBatch:
    size = len(records)
    columns = [pa.repeat(pa.scalar(split[0]), size), pa.repeat(pa.scalar(split[1], pa.int64()), size), seq.cast(pa.int64()),
               records.cast(pa.binary()), pa.repeat(pa.scalar(piece), size)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
