"""Delimited text, Parquet and workbooks, read from files written here."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltgate import open_source
from siltgate.catalog.workbooks import workbook_bytes
from siltgate.operators.tracked import ROW_INDEX
from siltgate.sources import delimited
from siltgate.sources.delimited import list_files, read_delimited, record_faults
from siltgate.sources.position import FileOrderNumbering
from siltgate.sources.workbook import list_sheets, read_workbook, workbook_files, workbook_sheets


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def csv(spark, path, **options):
    return read_delimited(spark, path, **{"encoding": "utf-8", "delimiter": ",", **options})


def numbered(source):
    frame = source.tracked()
    named = [frame.value(name).alias(name) for name in source.columns]
    return [tuple(row) for row in frame.numbering.number(frame.df).select(ROW_INDEX, *named).orderBy(ROW_INDEX).collect()]


def test_values_stay_text(spark, tmp_path):
    cells = ["-0", "1e3", "+5", "0x1F", "NaN", "null", "TRUE", "1999-12-31T23:59", "", "a; b, c"]
    line = ",".join(f'"{cell}"' if "," in cell else cell for cell in cells)
    source = csv(spark, write(tmp_path / "a.csv", ",".join(f"c{k}" for k in range(len(cells))) + f"\n{line}\n"))
    assert list(source.rows().first()) == cells
    assert {f.dataType.simpleString() for f in source.rows().schema} == {"string"}


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_breaks_and_quotes(spark, tmp_path, ending):
    body = ["id,text", '1,"two\nlines, ""quoted"""', '2," padded "', '3,""', "4,5\" pipe"]
    source = csv(spark, write(tmp_path / "a.csv", ending.join(body) + ending))
    assert numbered(source) == [(1, "1", 'two\nlines, "quoted"'), (2, "2", " padded "), (3, "3", ""), (4, "4", '5" pipe')]


def test_white_space_rows_are_kept(spark, tmp_path):
    source = read_delimited(spark, write(tmp_path / "a.csv", "a\tb\n\t\n1\t2\n"), encoding="utf-8", delimiter="\t")
    assert numbered(source) == [(1, "", ""), (2, "1", "2")]


def test_source_settings_are_required(spark, tmp_path, code):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n")
    assert code(csv, spark, path, encoding=None) == "source.csv_settings_required"
    assert code(csv, spark, path, delimiter=";;") == "source.invalid_delimiter"
    assert code(csv, spark, path, header_row=0) == "source.invalid_header_row"
    assert code(csv, spark, path, skip_rows=-1) == "source.invalid_skip_rows"
    assert code(csv, spark, path, encoding="utf-9") == "source.encoding_failed"
    assert code(csv, spark, str(tmp_path / "none.csv")) == "source.not_found"
    assert code(open_source, spark, {"path": "a.txt"}) == "source.unsupported_type"
    assert code(open_source, spark, {"path": str(tmp_path / "none.xlsx")}) == "source.not_found"
    assert code(open_source, spark, {"path": str(tmp_path / "none.parquet")}) == "source.not_found"
    assert code(list_sheets, spark, path) == "source.unsupported_type"


@pytest.mark.parametrize(
    "content, expected, columns",
    [
        ("", "source.empty", None),
        ("id,, \n", "source.empty_header", [2, 3]),
        ("id,x,id,x,id\n", "source.duplicate_header", ["id", "x"]),
    ],
)
def test_headers_are_checked(spark, tmp_path, content, expected, columns):
    with pytest.raises(Exception) as caught:
        csv(spark, write(tmp_path / "a.csv", content))
    assert caught.value.code == expected
    assert caught.value.diagnostic.details.get("columns") == columns


def test_headers_may_differ_by_case(spark, tmp_path):
    source = csv(spark, write(tmp_path / "a.csv", "id,ID\n1,2\n"))
    assert source.columns == ["id", "ID"]
    assert tuple(source.rows().first()) == ("1", "2")


def test_lines_above_the_header(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Report, with comma\n\n"note\nof two lines"\nid,name\n1,a\n2,b\n')
    source = csv(spark, path, skip_rows=2, header_row=2)
    assert source.columns == ["id", "name"]
    assert numbered(source) == [(1, "1", "a"), (2, "2", "b")]


def test_lines_above_the_header_in_several_splits(spark, tmp_path):
    for part in range(3):
        rows = "".join(f"{part}{i:05d},v\n" for i in range(900))
        write(tmp_path / "d" / f"{part}.csv", f"title {part}\n\nid,v\n{rows}")
    expected = [(i + 1, f"{i // 900}{i % 900:05d}", "v") for i in range(2700)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert numbered(csv(spark, str(tmp_path / "d"), skip_rows=2)) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_row_numbers_over_files_and_splits(spark, tmp_path, threshold):
    for part, size in enumerate((700, 1, 2500, 40)):
        write(tmp_path / "d" / f"{part}.csv", "v\n" + "".join(f"{part}-{i}\n" for i in range(size)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        source = csv(spark, str(tmp_path / "d"))
        numbering = FileOrderNumbering(source.numbering.scan)
        got = [tuple(r) for r in numbering.number(source.df).select(ROW_INDEX, "c0").orderBy(ROW_INDEX).collect()]
        assert source.df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    values = [f"{part}-{i}" for part, size in enumerate((700, 1, 2500, 40)) for i in range(size)]
    assert got == list(enumerate(values, start=1))


def test_row_numbers_refuse_moved_splits(spark, tmp_path):
    write(tmp_path / "d" / "a.csv", "v\n" + "".join(f"{i}\n" for i in range(2000)))
    source = csv(spark, str(tmp_path / "d"))
    source.numbering.offsets()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        with pytest.raises(Exception, match="File splits changed"):
            source.numbering.number(source.df).select(F.max(ROW_INDEX)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_of_parquet_files(spark, tmp_path):
    for part in range(3):
        spark.range(part * 100, part * 100 + 100).coalesce(1).write.parquet(str(tmp_path / "d" / f"p={part}"))
    source = open_source(spark, {"path": str(tmp_path / "d"), "format": "parquet"})
    assert [(r[0], r[1]) for r in numbered(source)] == [(i + 1, i) for i in range(300)]


def test_files_of_one_source_share_a_header(spark, tmp_path):
    write(tmp_path / "d" / "a.csv", "x,y\n1,2\n")
    write(tmp_path / "d" / "b.csv", "y,x\n1,2\n")
    with pytest.raises(Exception):
        csv(spark, str(tmp_path / "d")).rows().collect()


@pytest.mark.parametrize("encoding, first, second", [("utf-8", "id,ID\n1,2\n", "ID,id\n3,4\n"), ("cp1252", "a,b\n1,2\n", "b,a\n3,4\n")])
def test_headers_spark_cannot_compare(spark, tmp_path, encoding, first, second):
    write(tmp_path / "d" / "a.csv", first)
    write(tmp_path / "d" / "b.csv", first)
    assert csv(spark, str(tmp_path / "d"), encoding=encoding).rows().count() == 2
    write(tmp_path / "d" / "b.csv", second)
    with pytest.raises(Exception, match="share one header"):
        csv(spark, str(tmp_path / "d"), encoding=encoding).rows().collect()


def test_long_and_short_records(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,2\n3\n4,5,6\n"7,7","8"\n9,"x,y",z\n')
    source = csv(spark, path)
    assert tuple(record_faults(source).first()) == (5, 2, 1)
    short = csv(spark, write(tmp_path / "b.csv", "a,b\n3\n4,5\n"))
    assert numbered(short) == [(1, "3", ""), (2, "4", "5")]


@pytest.mark.parametrize(
    "encoding, text", [("latin-1", "é"), ("cp1252", "€uro – é"), ("utf-8-sig", "é"), ("utf-16", "é€"), ("cp437", "é"), ("koi8-r", "Ж")]
)
def test_encodings(spark, tmp_path, encoding, text):
    source = csv(spark, write(tmp_path / "a.csv", f"naïve,b\n{text},1\n".replace("ï", "i").encode(encoding)), encoding=encoding)
    assert source.columns == ["naive", "b"]
    assert numbered(source) == [(1, text, "1")]


def test_undecodable_headers_are_refused(spark, tmp_path, code):
    assert code(csv, spark, write(tmp_path / "a.csv", b"caf\xe9\n1\n")) == "source.encoding_failed"
    assert code(csv, spark, write(tmp_path / "b.csv", b"a\n1\n"), encoding="shift_jis") == "source.encoding_failed"


def test_file_listing_is_sorted(spark, tmp_path):
    for name in ("b.csv", "a b.csv"):
        write(tmp_path / "d" / name, "x\n1\n")
    assert [f.rpartition("/")[2] for f in list_files(spark, str(tmp_path / "d"))] == ["a b.csv", "b.csv"]
    assert len(numbered(csv(spark, str(tmp_path / "d")))) == 2


TWO_SHEETS = {"Sellers": [["SellerID", "Name"], ["S1", "Ann"]], "Orders": [["OrderID", "Amount"], ["A1", 12.5]]}


def book(tmp_path, sheets, name="book.xlsx"):
    return write(tmp_path / name, workbook_bytes(sheets))


def test_workbook_sheet_choice(spark, tmp_path, code):
    path = book(tmp_path, TWO_SHEETS)
    assert code(read_workbook, spark, path) == "source.sheet_required"
    assert code(read_workbook, spark, path, sheet="Nope") == "source.sheet_not_found"
    source = read_workbook(spark, path, sheet="Orders")
    assert source.sheets == ["Sellers", "Orders"]
    assert source.rows().first().asDict() == {"OrderID": "A1", "Amount": 12.5}
    assert list_sheets(spark, path) == source.sheets
    listed = workbook_sheets(workbook_files(spark, path)).orderBy("position").collect()
    assert [(r.position, r.sheet) for r in listed] == [(1, "Sellers"), (2, "Orders")]


def test_workbook_types(spark, tmp_path):
    rows = [
        ["n", "b", "d", "t", "mixed", "gap"],
        [1.0, True, (45292, 1), (45292, 1), 1.0, None],
        [2.5, False, (45293, 1), (45293.5, 2), "x", 3.0],
    ]
    source = read_workbook(spark, book(tmp_path, {"S": rows}))
    assert [f.dataType.simpleString() for f in source.rows().schema] == ["double", "boolean", "date", "timestamp_ntz", "string", "string"]
    assert numbered(source) == [
        (1, 1.0, True, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), "1.0", ""),
        (2, 2.5, False, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 12), "x", "3.0"),
    ]


def test_workbook_extent_and_header_row(spark, tmp_path):
    rows = [[None, None], [None, "Title", None], [], [None, "id", "v"], [None, "1", "a"], [], [None, "2", "b"]]
    source = read_workbook(spark, book(tmp_path, {"S": rows}), header_row=3)
    assert source.columns == ["id", "v"]
    assert numbered(source) == [(1, "1", "a"), (2, "", ""), (3, "2", "b")]


def test_workbook_faults(spark, tmp_path, code):
    assert code(read_workbook, spark, write(tmp_path / "bad.xlsx", b"no zip")) == "source.read_failed"
    assert code(read_workbook, spark, book(tmp_path, {"S": []}, "empty.xlsx")) == "source.empty"
    assert code(read_workbook, spark, book(tmp_path, {}, "none.xlsx")) == "source.empty"
    assert code(read_workbook, spark, book(tmp_path, {"S": [["a", "a"], ["1", "2"]]}, "dup.xlsx")) == "source.duplicate_header"
    assert code(read_workbook, spark, book(tmp_path, {"S": [["a"], ["1", "2"]]}, "wide.xlsx")) == "source.empty_header"
    only_header = read_workbook(spark, book(tmp_path, {"S": [["a", "b"]]}, "head.xlsx"))
    assert [f.dataType.simpleString() for f in only_header.rows().schema] == ["string", "string"]
    assert only_header.rows().count() == 0


def test_workbooks_of_a_folder_are_one_table(spark, tmp_path):
    for i in range(3):
        book(tmp_path / "d", {"S": [["id", "v"], [f"{i}a", float(i)], [f"{i}b", 0.5]]}, f"{i}.xlsx")
    source = read_workbook(spark, str(tmp_path / "d"))
    assert [r[:2] for r in numbered(source)] == [(1, "0a"), (2, "0b"), (3, "1a"), (4, "1b"), (5, "2a"), (6, "2b")]


def test_shared_strings(spark, tmp_path):
    import io
    import zipfile

    plain = workbook_bytes({"S": [["a"], ["x"]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            text = old.read(name).decode()
            if "sheet1" in name:
                text = text.replace('<c t="inlineStr"><is><t xml:space="preserve">x</t></is></c>', '<c t="s"><v>1</v></c>')
            new.writestr(name, text)
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>no</t></si><si><r><t>ye</t></r><r><t>s</t></r><rPh><t>!</t></rPh></si></sst>')
    source = read_workbook(spark, write(tmp_path / "s.xlsx", out.getvalue()))
    assert numbered(source) == [(1, "yes")]


def test_record_width_of_long_cells(spark):
    text = '"' + 'a""b,' * 20000 + '",x,y'
    df = spark.createDataFrame([(text,)], "r string")
    assert df.select(delimited.record_width(F.col("r"), ",")).first()[0] == 3


def test_a_header_of_white_space_is_blank_at_its_place(spark, tmp_path):
    from siltgate.operators.profile import header_findings

    (tmp_path / "h.csv").write_text("a,\t,b\n1,2,3\n")
    found = header_findings(spark, str(tmp_path / "h.csv"), delimiter=",").first()
    assert (found["code"], found["columns"]) == ("source.empty_header", ["2"])
