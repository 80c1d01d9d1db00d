"""Detection, inspection, starter recipes and folder profiles on files written here."""

from __future__ import annotations

import random

import pytest

from siltgate import validate
from siltgate.catalog.workbooks import workbook_bytes
from siltgate.operators.profile import (
    check_scope,
    dealt_names,
    delimiter_histogram,
    detect_delimiters,
    detect_encodings,
    discover_files,
    file_facts,
    folder_recipes,
    folder_totals,
    header_findings,
    infer_schema,
    inspect_source,
    line_histogram,
    profile_folder,
    spanning_values,
    split_record,
    starter_recipe,
    text_lines,
)
from siltgate.functions.naming import distinct_names, distinct_names_column, safe_name, safe_name_column, safe_names
from siltgate.sources.delimited import read_delimited
from pyspark.sql import functions as F


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def by_name(rows, *fields):
    return {row.path.rpartition("/")[2]: tuple(row[f] for f in fields) if len(fields) > 1 else row[fields[0]] for row in rows}


def test_encodings_are_told_apart(spark, tmp_path):
    for name, content in {
        "mark.csv": b"\xef\xbb\xbfa,b\r\n1,2", "mark_only.csv": b"\xef\xbb\xbf\n", "plain.csv": b"a\n1\n", "utf8.csv": "é\n".encode(),
        "latin.csv": b"a\n" * 500 + b"\xe9", "crlf.csv": b"a\r\n\r\n1\r\n", "noend.csv": b"a",
    }.items():
        write(tmp_path / name, content)
    assert by_name(detect_encodings(spark, str(tmp_path)).collect(), "encoding") == {
        "mark.csv": "utf-8-sig", "mark_only.csv": "utf-8-sig", "plain.csv": "utf-8", "utf8.csv": "utf-8", "latin.csv": "latin-1",
        "crlf.csv": "utf-8", "noend.csv": "utf-8",
    }


def test_delimiters_are_sure_or_guessed(spark, tmp_path):
    long = "".join(f"{i}|{'x' * 300}|{i}\n" for i in range(200)) + "a;b;c;d\n" * 100
    for name, content in {
        "comma.csv": "a,b\n1,2\n", "tab.csv": 'a\tb\n"1,5"\t"2;3,4"\n', "pipe.csv": long, "one.csv": "seller_id\n00123\n04567\n",
        "late.csv": "a note, of words\n" * 900 + "1;2;3\n" * 5000, "late_sure.csv": "a, note " * 2000 + "\n" + "1;2\n" * 20,
        "lines.csv": 'a;b\n1;"x,\ny,\n,,z"\n2;c\n',
        "ragged.csv": "a;b\n1\n2;3;4;5\nx,y\n", "crlf.csv": "a;b\r\n1;2\r\n", "head.csv": "a,b;c\n", "cut.csv": "a;" + "b" * 9000,
    }.items():
        write(tmp_path / name, content)
    lines = text_lines(spark, str(tmp_path))
    histogram = line_histogram(lines)
    facts = file_facts(histogram)
    found = detect_delimiters(delimiter_histogram(histogram, facts, spanning_values(lines, histogram, facts))).collect()
    assert by_name(found, "delimiter", "confident") == {
        "comma.csv": (",", True), "tab.csv": ("\t", True), "pipe.csv": ("|", False),
        "late.csv": (";", False), "late_sure.csv": (";", True), "lines.csv": (";", True), "one.csv": (",", False),
        "ragged.csv": (";", False), "crlf.csv": (";", True), "head.csv": (",", True), "cut.csv": (";", True),
    }


@pytest.mark.parametrize("content", ["a,b\n1,2,3\n", 'a,b\n1,"2\n3,4\n'])
def test_malformed_records_fail_every_read(spark, tmp_path, code, content):
    path = write(tmp_path / "bad.csv", content)
    assert code(inspect_source, spark, path, encoding="utf-8", delimiter=",") == "source.read_failed"
    assert code(starter_recipe, spark, path, encoding="utf-8", delimiter=",") == "source.read_failed"
    assert [(r.status, r.code) for r in profile_folder(spark, str(tmp_path), delimiter=",").collect()] == [("failed", "source.read_failed")]
    with pytest.raises(Exception, match="source.read_failed"):
        read_delimited(spark, path, encoding="utf-8", delimiter=",").rows().collect()


def test_records_split_natively(spark):
    cases = {
        "a,b": ["a", "b"], ",": ["", ""], "": [""], 'x,"y, ""z""",': ["x", 'y, "z"', ""], '"",a': ["", "a"],
        '"' + 'q""' * 30000 + '",b': ["q\"" * 30000, "b"],
    }
    df = spark.createDataFrame([(line,) for line in cases], "line string")
    got = {r.line: r.cells for r in df.select("line", split_record(F.col("line"), F.lit(",")).alias("cells")).collect()}
    assert got == cases
    piped = spark.createDataFrame([("a|b",)], "line string").select(split_record(F.col("line"), F.lit("|"))).first()[0]
    assert piped == ["a", "b"]


def test_inspection_of_delimited_text(spark, tmp_path):
    path = write(tmp_path / "sellers.csv", "seller_id;sku\n001;A\n002;B\n" + "".join(f"{i};C\n" for i in range(10)))
    seen = inspect_source(spark, path)
    assert (seen.file_type, seen.encoding, seen.delimiter, seen.columns) == ("csv", "utf-8", ";", ["seller_id", "sku"])
    assert (seen.row_count, seen.column_count, seen.dtypes) == (12, 2, {"seller_id": "string", "sku": "string"})
    assert seen.preview[0] == {"seller_id": "001", "sku": "A"} and len(seen.preview) == 5


def test_inspection_of_a_workbook(spark, tmp_path, code):
    path = write(tmp_path / "b.xlsx", workbook_bytes({"Sellers": [["SellerID"], ["S1"]], "Orders": [["OrderID", "Amount"], ["A1", 12.5]]}))
    seen = inspect_source(spark, path, sheet="Orders")
    assert (seen.sheets, seen.selected_sheet, seen.columns) == (["Sellers", "Orders"], "Orders", ["OrderID", "Amount"])
    assert seen.preview == [{"OrderID": "A1", "Amount": 12.5}]
    assert code(inspect_source, spark, path) == "source.sheet_required"


def test_starter_recipes_validate_as_they_are(spark, tmp_path, code):
    path = write(tmp_path / "companies.csv", "Company ID,Company Name,1st Value\nC001,Galaxy Tech,42\nC002,\"A, B\",\n")
    recipe = starter_recipe(spark, path, table="dim_companies")
    assert recipe.edits == (
        {"rename": {"Company ID": "company_id", "Company Name": "company_name", "1st Value": "col_1st_value"}},
    )
    assert [(c.name, c.type.text, c.nullable) for c in recipe.schema] == [
        ("company_id", "VARCHAR(4)", True), ("company_name", "VARCHAR(11)", True), ("col_1st_value", "VARCHAR(2)", True),
    ]
    assert recipe.target["table"] == "dim_companies" and recipe.source["delimiter"] == ","
    assert validate(spark, recipe).rows["validated"] == 2
    assert code(starter_recipe, spark, path, table="dim_companies", existing={"dim_companies"}) == "recipe.exists"
    one = write(tmp_path / "one.csv", "seller_id\n00123\n")
    assert code(starter_recipe, spark, one) == "source.csv_detection_failed"
    assert starter_recipe(spark, one, delimiter=",").name == "one"


def test_types_are_proposed_from_data(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (true, 1, 1.5D, DATE'2024-01-01', TIMESTAMP_NTZ'2024-01-01 00:00:00', 'abc', '', cast(null as string), "
        "repeat('x', 256), 1.25BD, array(1)) t(b, i, f, d, t, s, e, n, l, m, a)"
    )
    assert [r.type for r in infer_schema(df).orderBy("position").collect()] == [
        "BOOLEAN", "BIGINT", "DOUBLE", "DATE", "DATETIME", "VARCHAR(3)", "VARCHAR(1)", "VARCHAR(255)", "TEXT", "DECIMAL(3,2)", "TEXT",
    ]


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "data"
    write(data / "companies.csv", "Company ID,Name\nC001,Galaxy Tech\n")
    write(data / "companies.xlsx", workbook_bytes({"Companies": [["Company ID", "Name"], ["C002", "Cedar"]]}))
    write(data / "workbook.xlsx", workbook_bytes({
        "Companies": [["Company ID", "Size"], ["C003", 7.0]], "Employees": [["Employee ID", "Company ID"], ["E1001", "C003"]],
    }))
    write(data / "notes.txt", "ignored\n")
    write(data / "deep" / "multi.CSV", 'id;text\n1;"two\nlines"\n2;x\n')
    return data


def test_folder_profile_names_every_table(spark, folder):
    profile = profile_folder(spark, str(folder)).cache()
    assert folder_totals(profile).first().asDict() == {"files_found": 3, "created": 4, "failed": 0, "exit_code": 0}
    recipes = folder_recipes(profile)
    assert [(r.name, r.source.get("sheet")) for r in recipes] == [
        ("companies_csv", None), ("companies_xlsx", "Companies"), ("workbook_companies", "Companies"), ("workbook_employees", "Employees"),
    ]
    assert [(c.name, c.type.text) for c in recipes[2].schema] == [("company_id", "VARCHAR(4)"), ("Size", "DOUBLE")]
    assert (recipes[0].source["encoding"], recipes[0].source["delimiter"]) == ("utf-8", ",")
    again = profile_folder(spark, str(folder), existing=["companies_csv"])
    assert [r.code for r in again.where("status = 'failed'").collect()] == ["recipe.exists"]
    assert folder_totals(again).first().asDict() == {"files_found": 3, "created": 3, "failed": 1, "exit_code": 2}
    for recipe in recipes:
        assert validate(spark, recipe).result_code == 0


def test_folder_profile_goes_on_past_failures(spark, folder):
    write(folder / "blank.csv", "a,,c\n1,2,3\n")
    write(folder / "twice.csv", "a,b,a\n1,2,3\n")
    write(folder / "one.csv", "only\n1\n")
    write(folder / "wide.csv", "a,b\n" + "1,2\n" * 20 + "1,2,3\n")
    write(folder / "empty.csv", "")
    write(folder / "broken.xlsx", b"no zip")
    write(folder / "head.csv", "x,y\n")
    write(folder / "own" / "kept.csv", "x,y\n1,2\n")
    profile = profile_folder(spark, str(folder), recursive=True, own_folder="own").cache()
    failed = {r.source_path.rpartition("/")[2]: r.code for r in profile.where("status = 'failed'").collect()}
    assert failed == {
        "blank.csv": "source.empty_header", "twice.csv": "source.duplicate_header", "one.csv": "source.csv_detection_failed",
        "wide.csv": "source.read_failed", "empty.csv": "source.empty", "broken.xlsx": "source.read_failed",
    }
    assert folder_totals(profile).first().asDict() == {"files_found": 11, "created": 6, "failed": 6, "exit_code": 10}
    types = {(r.table, r.column): r.type for r in profile.where("status = 'created'").collect()}
    assert types[("multi", "text")] == "VARCHAR(9)" and types[("head", "x")] == "VARCHAR(255)"
    assert not any("own" in r.source_path for r in profile.collect())


def test_listing_reads_no_content(spark, folder):
    found = discover_files(spark, str(folder), recursive=True)
    assert sorted(r.kind for r in found.collect()) == ["csv", "csv", "xlsx", "xlsx"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<length:bigint>" in plan


ODD_NAMES = ["rep[1].csv", "a b.csv", "p%20q+r.csv", "é?*.csv", "{x,y}.csv", "back\\slash.csv", "[0-9] x.xlsx"]


@pytest.mark.parametrize("recursive", [True, False])
def test_names_with_pattern_characters_and_blanks(spark, tmp_path, recursive):
    folder = tmp_path / "in[a] {b}"
    book = workbook_bytes({"S": [["Id"], ["x"]]})
    for n, name in enumerate(ODD_NAMES):
        write(folder / name, book if name.endswith("xlsx") else f"id,v\n{n},\"two\nlines\"\n")
    write(folder / "empty [0].csv", "")
    write(folder / "empty.xlsx", "")
    write(folder / "col:on.csv", "id,v\n1,2\n")  # no file system of this kind opens such a name
    write(folder / "part=1" / "deep.csv", "id,v\n1,2\n")
    profile = profile_folder(spark, str(folder), recursive=recursive).cache()
    deep = {"deep.csv"} if recursive else set()
    made = {r.source_path.rpartition("/")[2] for r in profile.where("status = 'created'").collect()}
    assert made == set(ODD_NAMES) | deep
    failed = {r.source_path.rpartition("/")[2]: r.code for r in profile.where("status = 'failed'").collect()}
    assert failed == {"empty [0].csv": "source.empty", "empty.xlsx": "source.empty", "col:on.csv": "source.read_failed"}
    for name in ("{x,y}.csv", "[0-9] x.xlsx") if recursive else ("back\\slash.csv",):
        path = str(folder / name)
        assert inspect_source(spark, path).row_count == 1 and starter_recipe(spark, path, table="t").name == "t"
    assert sorted(r.id for r in read_delimited(spark, str(folder / "rep[1].csv"), encoding="utf-8", delimiter=",").rows().collect()) == ["0"]


def test_a_file_that_is_cut_short_while_read_is_one_failed_entry(spark, tmp_path):
    """A checksum beside a file that does not fit its later bytes makes reading fail midway."""
    spark.createDataFrame([("id,v",)] + [(f"{i},x",) for i in range(40_000)], "value string").coalesce(1).write.text(str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    data = tmp_path / "data"
    data.mkdir()
    (data / ".broken.csv.crc").write_bytes((tmp_path / "out" / f".{part.name}.crc").read_bytes())
    raw = bytearray(part.read_bytes())
    raw[300_000] ^= 1
    (data / "broken.csv").write_bytes(raw)
    write(data / "fine.csv", "id,v\n1,2\n")
    profile = profile_folder(spark, str(data))
    found = {(r.source_path.rpartition("/")[2], r.status, r.code) for r in profile.collect()}
    assert found == {("broken.csv", "failed", "source.read_failed"), ("fine.csv", "created", None)}


def test_folder_profiles_run_no_python_on_text(spark, folder, monkeypatch):
    profile = profile_folder(spark, str(folder))
    assert "Python" not in profile._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_headers_and_tables_are_dealt_in_order(spark):
    """The fold over a header and the rounds over a folder give what dealing one by one gives."""
    rng = random.Random(2)
    pool = ["a", "A", "a_2", "a_2_2", "a_3", "b", "b_2", "x" * 64, "x" * 62, "x" * 62 + "_2", "c c", "1", "__"]
    headers = [[rng.choice(pool) for _ in range(rng.randrange(1, 25))] for _ in range(60)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, h array<string>")
    dealt = df.select("i", distinct_names_column(F.transform("h", safe_name_column)).alias("n")).orderBy("i").collect()
    assert [r.n for r in dealt] == [safe_names(h) for h in headers]
    names = [safe_name(rng.choice(pool)) for _ in range(45)]
    rows = list(enumerate(names))
    rng.shuffle(rows)
    found = dealt_names(spark.createDataFrame(rows, "i int, n string"), "n", ["i"]).orderBy("i").collect()
    assert [r.name for r in found] == distinct_names(names)


def test_scans_stay_in_the_project(spark, tmp_path, code):
    assert code(profile_folder, spark, str(tmp_path / "none")) == "scan.directory_not_found"
    check_scope("/p/data", "/p")
    assert code(check_scope, "/q", "/p") == "scan.directory_out_of_scope"
    assert code(check_scope, "/p/../q", "/p") == "scan.directory_out_of_scope"


def test_header_findings_per_file(spark, tmp_path):
    write(tmp_path / "a.csv", "id,, \n1,2,3\n")
    write(tmp_path / "b.csv", "x,y,x\n")
    write(tmp_path / "c.csv", "x,X\n")
    found = by_name(header_findings(spark, str(tmp_path), delimiter=",").collect(), "code", "columns")
    assert found == {
        "a.csv": ("source.empty_header", ["2", "3"]), "b.csv": ("source.duplicate_header", ["x"]), "c.csv": (None, []),
    }
