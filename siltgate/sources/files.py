"""Paths as they are: names with pattern characters, and whole folders read as one scan.

Spark reads a path with any of ``\\ [ ] { } * ?`` as a pattern, and names files in its metadata as
URIs, with blanks and others encoded. A path that exists is meant literally; any other is a
pattern. Files of a folder are told apart by their URI, the key of every step on them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltgate.errors import fail

_PATTERN = re.compile(r"[\\\[\]{}*?]")


def literal(path: str) -> str:
    """The pattern that matches this path alone."""
    return _PATTERN.sub(r"\\\g<0>", path)


def readable(spark: SparkSession, path: str, code: str = "source.not_found") -> str:
    """What a reader is to be given for a path, or an error if neither it nor a match of it exists."""
    files, hadoop = _hadoop(spark, path)
    if files.exists(hadoop):
        return literal(path)
    if not files.globStatus(hadoop):
        raise fail(code, "The path does not exist.", path=path)
    return path


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def decoded_path(uri: Column) -> Column:
    """The path that a file's URI stands for."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def folder_scan(
    spark: SparkSession, directory: str, form: str, names: str, *, recursive: bool, own_folder: str | None = None, **options
) -> DataFrame:
    """One scan of the files below a directory whose names match a pattern.

    A file that cannot be read to its end gives the rows before the fault, or none, and does not
    end the scan; callers compare what was read with the file's size. Which files are meant is a
    condition on the URI, so Spark prunes the others before it reads.
    """
    reader = spark.read.format(form).options(recursiveFileLookup=True, pathGlobFilter=names, ignoreCorruptFiles=True, **options)
    path, scan = decoded_path(F.col("_metadata.file_path")), reader.load(readable(spark, directory, "scan.directory_not_found"))
    if not recursive:
        scan = scan.where(F.regexp_replace(path, "/[^/]*$", "") == root_path(spark, directory))
    if own_folder:
        scan = scan.where(~F.contains(path, F.lit(f"/{own_folder.strip('/')}/")))
    return scan


def root_path(spark: SparkSession, directory: str) -> str:
    """A directory in full, written as the paths of its files begin."""
    files, hadoop = _hadoop(spark, directory)
    return files.makeQualified(hadoop).toString().rstrip("/")


def listed_files(scan: DataFrame) -> DataFrame:
    """(file): the URIs a scan has listed, empty files included, without a list in Python."""
    spark = scan.sparkSession
    uris = spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles())
    listed = spark._jsparkSession.createDataset(uris, spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(listed, spark).select(F.regexp_replace("value", "^file:/+", "file:/").alias("file"))
