"""The run log: a folder of JSON lines, one record per load, read as a table.

Each load adds a small file. Compaction folds what the folder holds into one sorted generation,
``sorted-<number>``, and publishes it by a single rename, together with the list of files that it
covers. A reader takes the newest generation and the files it does not cover, so each record is
seen once at any moment, whatever runs beside it. Covered files go with the compaction after.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from siltgate.errors import ResultCode, fail
from siltgate.session import remove_folder
from siltgate.sources.files import decoded_path, listed_files, literal, root_path

CORRUPT = "_corrupt_record"
# Names of a compacted log: its generations, and in each the list of the files it covers.
GENERATION, COVERED = "sorted-", "_covered"
# Fixed value: what stands for a hidden secret.
MASK = "***"


def run_schema() -> T.StructType:
    text, whole = T.StringType(), T.LongType()
    counts = ("read", "edited", "validated", "loaded", "rejected_edit", "rejected_validate")
    finding = T.StructType([T.StructField(name, text) for name in ("code", "message", "path", "details")])
    return T.StructType(
        [
            *[T.StructField(n, text) for n in ("run_id", "recipe", "profile", "table", "mode", "started_at", "finished_at")],
            T.StructField("duration_ms", whole),
            T.StructField("rows", T.StructType([T.StructField(name, whole) for name in counts])),
            T.StructField("rejects", text),
            T.StructField("diagnostics", T.ArrayType(finding)),
            T.StructField("exit_code", T.IntegerType()),
            T.StructField("git_sha", text),
            T.StructField("recorded_at", text),
        ]
    )


def new_run_id(started: dt.datetime) -> str:
    return f"r_{started.astimezone(dt.UTC):%Y_%m_%dT%H_%M_%SZ}_{uuid.uuid4().hex[:4]}"


#: Words that mark a setting as secret wherever they stand in its key.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key")
_ASSIGNED = re.compile(rf"""(?i)(?P<key>{"|".join(SECRET_WORDS)})(?P<between>[\w.-]*["']?\s*[:=]\s*["']?)[^\s"',;&]+""")
_ADDRESS = re.compile(r"""[A-Za-z][\w+.-]*://[^\s"']+""")


def mask_secrets(text: str) -> str:
    """Hide the values of secret settings, and the passwords of addresses."""
    shown = _ADDRESS.sub(lambda match: _masked_address(match[0]), text)
    return _ASSIGNED.sub(lambda match: match["key"] + match["between"] + MASK, shown)


def _masked_address(address: str) -> str:
    scheme, _, rest = address.partition("://")
    authority, slash, path = rest.partition("/")
    user, at, host = authority.rpartition("@")
    name, colon, _ = user.partition(":")
    return f"{scheme}://{name}{colon}{MASK}@{host}{slash}{path}" if at and colon else address


def append_run(spark: SparkSession, folder: str, record: Mapping[str, Any]) -> None:
    """Add one record. Its append time orders the log."""
    stamped = {"recorded_at": dt.datetime.now(dt.UTC).isoformat(timespec="microseconds"), **record}
    stamped["diagnostics"] = [
        {**finding, "details": mask_secrets(json.dumps(finding.get("details") or {}, default=str, sort_keys=True))}
        for finding in record.get("diagnostics") or []
    ]
    df = spark.createDataFrame([_row(stamped, run_schema())], run_schema())
    df.coalesce(1).write.mode("append").option("ignoreNullFields", False).json(folder)


def append_runs(records: DataFrame, folder: str) -> None:
    """Add many records at once, such as a log kept elsewhere."""
    records.select(*run_schema().names).write.mode("append").option("ignoreNullFields", False).json(folder)


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records, with the text of lines that are not records in ``_corrupt_record``."""
    scan, newest = _scan(spark, folder)
    return _uncovered(scan, newest)


def _scan(spark: SparkSession, folder: str) -> tuple[DataFrame, str | None]:
    """The lines of the newest generation and of all loose files, covered or not; and that generation."""
    schema, newest = run_schema().add(CORRUPT, T.StringType()), _newest(spark, folder)
    paths = [literal(path) for path in (folder, newest) if path]
    try:
        return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(paths), newest
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema), None
        raise


def _uncovered(scan: DataFrame, newest: str | None) -> DataFrame:
    if newest is None:
        return scan
    covered = scan.sparkSession.read.parquet(literal(f"{newest}/{COVERED}")).select("name")
    named = scan.withColumn("__name", _last_part(F.col("_metadata.file_path")))
    return named.join(covered, named["__name"] == covered["name"], "left_anti").drop("__name")


def _last_part(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def _newest(spark: SparkSession, folder: str) -> str | None:
    """The newest generation; numbers have one width, so names sort as numbers do."""
    return max(_generations(spark, folder), default=None)


def _generations(spark: SparkSession, folder: str) -> list[str]:
    """Generations of the log: the newest, and those a reader may still use."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = spark._jvm.org.apache.hadoop.fs.Path(literal(root_path(spark, folder)), f"{GENERATION}*")
    return [found.getPath().toString() for found in files.globStatus(pattern) or [] if found.isDirectory()]


def compact_runs(spark: SparkSession, folder: str) -> int:
    """Fold the log into one sorted generation; returns its number of records.

    Records added meanwhile stay loose files. Of several compactions at once one is published;
    the others change nothing and return 0. One that dies before its rename changes nothing.
    Readers that began before one compaction still find their files; two later they may not.
    """
    scan, newest = _scan(spark, folder)
    listed = listed_files(scan)
    if listed.isEmpty():
        return 0
    rows = _uncovered(scan, newest)
    _refuse_corrupt(rows, folder)
    rows = rows.drop(CORRUPT)
    root = root_path(spark, folder)
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    rows.orderBy("recorded_at", "run_id").write.option("ignoreNullFields", False).json(draft)
    listed.select(decoded_path(F.col("file")).alias("file"), _last_part(F.col("file")).alias("name")).write.parquet(f"{draft}/{COVERED}")
    records = spark.read.schema(run_schema()).json(literal(draft)).count()
    number = int(newest.rpartition(GENERATION)[2]) + 1 if newest else 1
    if not _publish(spark, draft, f"{root}/{GENERATION}{number:010d}"):
        remove_folder(spark, draft)
        return 0
    _remove_covered(spark, folder, newest)
    return records


def _publish(spark: SparkSession, draft: str, generation: str) -> bool:
    """Rename a draft unless its name is taken."""
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    source, target = hadoop.Path(draft), hadoop.Path(generation)
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _remove_covered(spark: SparkSession, folder: str, before: str | None) -> None:
    """Remove what the generation before the newest covers, and the generations before that one."""
    if before is None:
        return
    for row in spark.read.parquet(literal(f"{before}/{COVERED}")).toLocalIterator():
        remove_folder(spark, row.file)
    for generation in _generations(spark, folder):
        if generation < before:
            remove_folder(spark, generation)


def corrupt_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how many lines are records, and how many cannot be read."""
    return _judged_lines(run_records(spark, folder))


def _judged_lines(records: DataFrame) -> DataFrame:
    bad = F.col(CORRUPT).isNotNull()
    return records.agg(
        F.count_if(~bad & F.col("run_id").isNotNull()).alias("records"), F.count_if(bad).alias("corrupt")
    )


def _refuse_corrupt(records: DataFrame, folder: str) -> None:
    corrupt = _judged_lines(records).first().corrupt
    if corrupt:
        raise fail("history.invalid_jsonl", "The run log has lines that are not records.", path=folder, lines=corrupt)


def _sound_records(spark: SparkSession, folder: str) -> DataFrame:
    records = run_records(spark, folder)
    _refuse_corrupt(records, folder)
    return records.drop(CORRUPT)


def list_runs(spark: SparkSession, folder: str, *, table: str | None = None, limit: int | None = None) -> DataFrame:
    """Records, newest first; Spark takes a limited list as a top-k, without a full sort."""
    if limit is not None and limit < 0:
        raise fail("history.invalid_limit", "The limit cannot be negative.", result_code=ResultCode.USAGE_OR_DRIFT, limit=limit)
    records = _sound_records(spark, folder)
    if table is not None:
        records = records.where(F.col("table") == table)
    newest_first = records.orderBy(F.desc("recorded_at"), F.desc("run_id"))
    return newest_first if limit is None else newest_first.limit(limit)


def newest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest record of each table, from partial maxima: no table's records meet in one task."""
    records = _sound_records(spark, folder)
    newest = F.max_by(F.struct(*records.columns), F.struct("recorded_at", "run_id")).alias("newest")
    return records.groupBy("table").agg(newest).select("newest.*")


def find_run(spark: SparkSession, folder: str, run_id: str) -> Row:
    """The newest record of one run."""
    found = list_runs(spark, folder).where(F.col("run_id") == run_id).limit(1).first()
    if found is None:
        raise fail("history.not_found", f"There is no run `{run_id}`.", path=folder, result_code=ResultCode.USAGE_OR_DRIFT, run_id=run_id)
    return found


def _row(values: Mapping[str, Any] | None, schema: T.StructType) -> tuple | None:
    if values is None:
        return None
    out = []
    for field in schema:
        value = values.get(field.name)
        if isinstance(field.dataType, T.StructType):
            value = _row(value, field.dataType)
        elif isinstance(field.dataType, T.ArrayType):
            value = [_row(item, field.dataType.elementType) for item in value or []]
        out.append(value)
    return tuple(out)
