"""Records that span lines, against Python's own reader, with splits of a few bytes."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from siltgate import inspect_source
from siltgate.errors import EngineError
from siltgate.operators.tracked import ROW_INDEX
from siltgate.sources.delimited import read_delimited
from siltgate.sources.position import FILE, SEQ, START, ranged, running_before
from siltgate.sources.records import raw_lines, spanning_records, split_quotes

CELLS = ["", "a", "b c", "two\nlines", "\n", "\n\n\n", 'say "hi"', '"', '""\n"', ",", " x ", "long " * 20, "é\n€", "\n\n\n" + "y\n" * 40]


def written(path, seed: int, rows: int, ending: str) -> list[list[str]]:
    rng = random.Random(seed)
    table = [["id", "text", "more"]] + [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(rows)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ending)
    for row in table:
        writer.writerow(row)
        if rng.random() < 0.1:
            out.write(ending)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = out.getvalue()
    path.write_bytes((text if seed % 2 else text.rstrip("\r\n")).encode())
    return table


@pytest.fixture
def tiny(spark):
    """Splits of a few bytes and batches of a few lines."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")

    def set_split(size: int):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield set_split
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("split, ending", [(60, "\n"), (400, "\r\n"), (5000, "\n")])
def test_rows_agree_with_a_sequential_reader(spark, tmp_path, tiny, split, ending):
    expected = []
    for part in range(3):
        expected += written(tmp_path / "d" / f"{part}.csv", part, 60, ending)[1:]
    tiny(split)
    source = read_delimited(spark, str(tmp_path / "d"), encoding="utf-8", delimiter=",", multi_line=True)
    frame = source.tracked()
    got = frame.numbering.number(frame.df).select(ROW_INDEX, *[frame.value(name) for name in source.columns]).orderBy(ROW_INDEX)
    assert [tuple(row) for row in got.collect()] == [(i, *row) for i, row in enumerate(expected, start=1)]


def test_joins_by_shuffle_and_by_broadcast_give_the_same_records(spark, tmp_path, tiny):
    for part in range(4):
        written(tmp_path / "d" / f"{part}.csv", part, 30, "\n")
    files = sorted(f"file:{path}" for path in (tmp_path / "d").iterdir())
    tiny(200)

    def read(threshold):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            records = spanning_records(raw_lines(spark, files), split_quotes(raw_lines(spark, files), ","))
            assert ("BroadcastHashJoin" in plan_of(records)) == (threshold != "-1")
            return records.orderBy(FILE, START, SEQ).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert read("-1") == read("10m")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_running_sums_do_not_depend_on_ranges(spark, partitions):
    rng = random.Random(1)
    rows = [(group, place, rng.randrange(-2, 3)) for group, size in (("a", 1), ("b", 300), ("c", 2), ("d", 40)) for place in range(size)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = ranged(spark.createDataFrame(rows, "g string, p int, v int"), "g", "p")
        assert partitions == 1 or table.select("__range").distinct().count() > 1
        found = running_before(running_before(table, ["g"], ["p"], F.col("v"), "own"), [], ["g", "p"], F.col("v"), "all")
        got = [tuple(r) for r in found.orderBy("g", "p").select("g", "p", "own", "all").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, total, own = [], 0, {}
    for group, place, value in sorted(rows):
        expected.append((group, place, own.get(group, 0), total))
        own[group], total = own.get(group, 0) + value, total + value
    assert got == expected


WIDE_CELLS = [*CELLS, "\u0a05\u0a0a\u050a", "\u0a0a\n\u0a00x", "\U0001f60a", "\u0d0a \r", "\ufffd", "\u0a0a" * 70]


@pytest.mark.parametrize("split, encoding", [(119, "utf-16"), (122, "utf-16-be"), (255, "utf-32"), (190, "utf-32-be"), (600, "marked-be"), (5000, "utf-16-le")])
def test_wide_characters_agree_with_a_sequential_reader(spark, tmp_path, tiny, split, encoding):
    """Line feed bytes that are halves of other characters, at any place of a split, in several files."""
    codec, mark = ("utf-16-be", "\ufeff") if encoding == "marked-be" else (encoding, "")
    rng, expected = random.Random(split), []
    for part in range(3):
        rows = [[str(i), rng.choice(WIDE_CELLS), rng.choice(WIDE_CELLS)] for i in range(6 * part + 1)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["id", "\u0a0a", "more"], *rows])
        path = tmp_path / "d" / f"{part}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes((mark + (out.getvalue() if part else out.getvalue().rstrip("\n"))).encode(codec))
        expected += rows
    tiny(split)
    source = read_delimited(spark, str(tmp_path / "d"), encoding="utf-16" if mark else codec, delimiter=",")
    frame = source.tracked()
    got = frame.numbering.number(frame.df).select(ROW_INDEX, *[frame.value(name) for name in source.columns]).orderBy(ROW_INDEX)
    assert [tuple(row) for row in got.collect()] == [(i, *row) for i, row in enumerate(expected, start=1)]
    assert source.columns == ["id", "\u0a0a", "more"]


def test_a_wide_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,v\n" + "".join(f"{i},x\n" for i in range(20_000)), encoding="utf-16")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        source = read_delimited(spark, str(path), encoding="utf-16", delimiter=",")
        assert "binaryFile" not in plan_of(source.df) and "Scan text" in plan_of(source.df)
        pieces = source.df.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(pieces) > 5 and sum(r["count"] for r in pieces) == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("encoding, bad", [("utf-16-le", b"\x00\xd8"), ("utf-16-be", b"\xdc\x00"), ("utf-32-le", b"\xff\xff\xff\x7f"), ("utf-16-le", b"x")])
def test_bytes_that_are_no_wide_characters_are_refused(spark, tmp_path, encoding, bad):
    path = tmp_path / "a.csv"
    path.write_bytes(("id,text\n" + "1,a\n" * 50 + "2,b").encode(encoding) + bad)
    with pytest.raises(EngineError) as caught:
        inspect_source(spark, str(path), encoding=encoding, delimiter=",")
    assert caught.value.code == "source.read_failed"


def test_a_record_may_fill_many_splits(spark, tmp_path, tiny):
    value = "line\n" * 500
    path = tmp_path / "a.csv"
    path.write_text(f'id,text\n1,"{value}"\n2,x\n')
    tiny(64)
    source = read_delimited(spark, str(path), encoding="utf-8", delimiter=",")
    assert sorted(map(tuple, source.rows().collect())) == [("1", value), ("2", "x")]


def test_a_file_that_ends_within_quotes_is_refused(spark, tmp_path, tiny):
    path = tmp_path / "a.csv"
    path.write_text("id,text\n" + "1,x\n" * 50 + '2,"stray\n' + "3,y\n" * 500)
    tiny(64)
    with pytest.raises(EngineError) as caught:
        read_delimited(spark, str(path), encoding="utf-8", delimiter=",")
    assert caught.value.code == "source.read_failed"
    wide = tmp_path / "wide.csv"
    wide.write_text(path.read_text(), encoding="utf-16")
    with pytest.raises(EngineError) as caught:
        read_delimited(spark, str(wide), encoding="utf-16", delimiter=",")
    assert caught.value.code == "source.read_failed"


def test_record_bytes_are_not_gathered_by_file(spark, tmp_path, tiny):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n' + '1,"a\nb"\n' * 50)
    tiny(64)
    plan = spanning_records(raw_lines(spark, [str(path)]), split_quotes(raw_lines(spark, [str(path)]), ","))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("record" in line for line in windows)


def test_headers_of_several_files_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a\nb"\n')
    (tmp_path / "b.csv").write_text('id,other\n1,"a\nb"\n')
    with pytest.raises(Exception, match="share one header"):
        read_delimited(spark, str(tmp_path), encoding="utf-8", delimiter=",").rows().collect()
