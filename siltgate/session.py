"""What the engine needs from the session: a shared scratch folder and a UTC clock."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siltgate.errors import ResultCode, fail

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets one temporary folder per
    application, because driver and executors share the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise fail(
            "engine.scratch_required",
            "Set spark.checkpoint.dir to a folder that every executor can reach.",
            result_code=ResultCode.USAGE_OR_DRIFT,
        )
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = "file:" + tempfile.mkdtemp(prefix="run-siltgate-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_root(spark)}/siltgate/{label}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the scratch folder and read it back: its inputs never run again."""
    return stored_table(df, scratch_path(df.sparkSession, label))


def stored_table(df: DataFrame, path: str) -> DataFrame:
    """The same at a path that the caller knows, to remove it after use."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder and all below it; it may be absent."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def require_utc(spark: SparkSession) -> None:
    """Formatted datetimes pass through zoned timestamps, which only UTC keeps unchanged."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in {"UTC", "Z", "GMT", "ETC/UTC", "+00:00", "UTC+0"}:
        raise fail(
            "engine.session_timezone",
            "Formatted datetime casts need spark.sql.session.timeZone=UTC.",
            result_code=ResultCode.USAGE_OR_DRIFT,
            zone=zone,
        )


def pin_file_splits(spark: SparkSession) -> None:
    """Keep file splits the same from one action to the next.

    Split sizes depend on the parallelism seen when a plan starts, which dynamic allocation
    changes. Row numbering counts splits in one job and uses the counts in another, so the
    value in force now is written down as the setting unless the user has chosen one.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        leaf = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        parallelism = int(leaf) if leaf else spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(parallelism))
