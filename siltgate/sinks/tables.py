"""Table sinks: append after a drift check, or replace through a staging table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from siltgate.errors import ResultCode, fail
from siltgate.functions.naming import companion_name, companion_pattern, quoted, split_identifier
from siltgate.plans.recipe import Settings
from siltgate.plans.types import DeclaredColumn
from siltgate.session import remove_folder
from siltgate.sinks.drift import CHARSET_PROPERTY, REQUIRED_PROPERTY, live_table, schema_drift


def create_table(
    spark: SparkSession, table: str, schema: Sequence[DeclaredColumn], settings: Settings, folder: str | None = None
) -> None:
    """Create the table a schema declares, in a folder of its own or in the given one."""
    ddl = create_table_ddl(table, schema, settings, folder)
    if folder is None:
        # a dropped table that was replaced before may have left its first folder
        database, name = split_identifier(table)
        root = spark.sql(f"DESCRIBE DATABASE {f'`{database}`' if database else spark.catalog.currentDatabase()}").where("info_name = 'Location'").first()[1]
        remove_superseded(spark, table, f"{root.rstrip('/')}/{name}")
    spark.sql(ddl)


def create_table_ddl(table: str, schema: Sequence[DeclaredColumn], settings: Settings, folder: str | None = None) -> str:
    if not schema:
        raise fail("schema.invalid", "A table needs at least one column.", path="schema")
    for option in ("engine", "collation"):
        if not getattr(settings, option).replace("_", "").isalnum():
            raise fail(
                "mysql.invalid_option",
                f"The {option} may only hold letters, digits and underscores.",
                path=f"target.{option}",
                result_code=ResultCode.USAGE_OR_DRIFT,
                option=option,
            )
    columns = ", ".join(
        f"{_column(c.name)} {c.type.sink_ddl()}{'' if c.nullable else ' NOT NULL'}" for c in schema
    )
    required = _literal(json.dumps([c.name for c in schema if not c.nullable]))
    return (
        f"CREATE TABLE {quoted(table)} ({columns}) USING {settings.engine} {f'LOCATION {_literal(folder)} ' if folder else ''}"
        f"DEFAULT COLLATION {settings.collation} "
        f"TBLPROPERTIES ('{REQUIRED_PROPERTY}' = {required}, '{CHARSET_PROPERTY}' = {_literal(settings.charset)})"
    )


def append_rows(spark: SparkSession, table: str, schema: Sequence[DeclaredColumn], df: DataFrame, settings: Settings) -> int:
    """Create the table if needed, else check it for drift, then insert. All rows or none.

    The insert is one job, whose files become visible only when it commits.
    """
    repair(spark, table)
    live = live_table(spark, table)
    if live is None:
        create_table(spark, table, schema, settings)
    else:
        drift = schema_drift(schema, live, settings)
        if drift:
            raise fail(
                "mysql.schema_drift",
                f"The live table `{table}` differs from the declared schema.",
                path="target.table",
                result_code=ResultCode.USAGE_OR_DRIFT,
                table=table,
                diffs=drift,
            )
    try:
        return insert_rows(table, schema, df, settings.file_rows)
    except Exception:
        if live is None:
            _drop_quietly(spark, table)
        raise


def insert_rows(table: str, schema: Sequence[DeclaredColumn], df: DataFrame, file_rows: int = 0) -> int:
    """Insert in declared order; the rows are counted by the writing job itself.

    ``file_rows`` bounds the records of a committed file; 0 sets no bound.
    """
    spark, option = df.sparkSession, "spark.sql.files.maxRecordsPerFile"
    written, before = Observation(), spark.conf.get(option)
    typed = df.select(*[F.col(_column(c.name)).cast(c.type.sink_type()).alias(c.name) for c in schema])
    try:
        if file_rows:
            spark.conf.set(option, str(file_rows))  # an insert takes it from the session alone
        typed.observe(written, F.count(F.lit(1)).alias("rows")).write.insertInto(quoted(table))
    finally:
        spark.conf.set(option, before)
    return written.get["rows"]


#: An empty file that marks a folder whose table has moved on to another one.
SUPERSEDED = "_superseded"


class StagedReplace:
    """Replace a table in two steps: fill a staging table of the run's own, then publish it.

    The target is untouched until then. A target that has the declared shape is published by one
    catalog step: its location moves to the folder of the new rows, so at any moment readers find
    the old rows or the new ones. The folder before stays for readers that still run; the next
    replace removes it. A target of another shape, which no single step can change, is exchanged
    by two renames; a run that dies between them is repaired by the next one (:func:`repair`).
    """

    def __init__(self, spark: SparkSession, table: str, schema: Sequence[DeclaredColumn], settings: Settings, run_id: str):
        self.spark, self.table, self.schema, self.settings = spark, table, schema, settings
        self.staging = companion_name(table, "staging", run_id)
        self.backup = companion_name(table, "backup", run_id)
        repair(spark, table)
        live = live_table(spark, table)
        self.folder = None
        if live is not None and not schema_drift(schema, live, settings):
            self.folder = f"{location(spark, table).rpartition('/')[0]}/{split_identifier(self.staging)[1].lower()}"

    def stage(self, df: DataFrame) -> int:
        try:
            create_table(self.spark, self.staging, self.schema, self.settings, self.folder)
            return insert_rows(self.staging, self.schema, df, self.settings.file_rows)
        except Exception:
            self.discard()
            raise

    def discard(self) -> None:
        _drop_quietly(self.spark, self.staging)
        if self.folder:
            remove_folder(self.spark, self.folder)

    def swap(self) -> None:
        try:
            if self.folder:
                self._publish()
            else:
                self._exchange()
        except Exception:
            self.discard()
            raise

    def _publish(self) -> None:
        before = location(self.spark, self.table)
        self._move(self.folder)
        # what follows only tidies up: the staging name, older folders, and a mark on the last one
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(self.staging)}")
        self.folder = None
        remove_superseded(self.spark, self.table, before)
        mark_superseded(self.spark, before)

    def _move(self, folder: str) -> None:
        self.spark.sql(f"ALTER TABLE {quoted(self.table)} SET LOCATION {_literal(folder)}")

    def _exchange(self) -> None:
        had_table = self.spark.catalog.tableExists(quoted(self.table))
        if had_table:
            self._rename(self.table, self.backup)
        try:
            self._rename(self.staging, self.table)
        except Exception:
            if had_table:
                self._rename(self.backup, self.table)
            raise
        if had_table:
            before = location(self.spark, self.backup)
            self.spark.sql(f"DROP TABLE {quoted(self.backup)}")
            remove_superseded(self.spark, self.table, before)

    def _rename(self, source: str, target: str) -> None:
        self.spark.sql(f"ALTER TABLE {quoted(source)} RENAME TO {quoted(target)}")


def repair(spark: SparkSession, table: str) -> None:
    """Give a table its name back that a run took away and did not live to replace."""
    if spark.catalog.tableExists(quoted(table)):
        return
    schema, name = split_identifier(table)
    backups = spark.sql(f"SHOW TABLES {f'IN `{schema}` ' if schema else ''}LIKE {_literal(companion_pattern(name, 'backup'))}")
    last = backups.where(~F.col("isTemporary")).agg(F.max("tableName")).first()[0]
    if last is not None:
        backup = f"{schema}.{last}" if schema else last
        spark.sql(f"ALTER TABLE {quoted(backup)} RENAME TO {quoted(table)}")


def location(spark: SparkSession, table: str) -> str:
    """The folder that holds a table's rows."""
    described = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)} AS JSON").first()[0])
    return described["location"].rstrip("/")


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def mark_superseded(spark: SparkSession, path: str) -> None:
    files, mark = _folder(spark, f"{path}/{SUPERSEDED}")
    if files.exists(mark.getParent()):
        files.create(mark, True).close()


def remove_superseded(spark: SparkSession, table: str, current: str) -> None:
    """Remove marked folders beside ``current`` that earlier replaces of the table left."""
    files, parent = _folder(spark, current.rpartition("/")[0])
    name = split_identifier(table)[1]
    for pattern in (name.lower(), companion_pattern(name, "staging")):
        for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(parent, f"{pattern}/{SUPERSEDED}")) or []:
            files.delete(found.getPath().getParent(), True)


def replace_rows(
    spark: SparkSession, table: str, schema: Sequence[DeclaredColumn], df: DataFrame, settings: Settings, *, run_id: str
) -> int:
    """All-or-nothing replacement; a drifted target is replaced like any other."""
    staged = StagedReplace(spark, table, schema, settings, run_id)
    loaded = staged.stage(df)
    staged.swap()
    return loaded


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _drop_quietly(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
    except Exception:  # the first error is the one to report
        return
