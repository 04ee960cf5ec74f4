"""Lesson texts from files and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import files as stored


def _placed(under: Column, text: Column) -> list[Column]:
    """The path under the root, the file's stem, the first folder under the root (null at the top) and the text."""
    return [
        under.alias("course_path"),
        F.regexp_extract(under, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("course_name"),
        F.nullif(F.regexp_extract(under, r"^([^/]+)/", 1), F.lit("")).alias("first_dir"),
        text.alias("text"),
    ]


def _scanned(files: DataFrame, root: str) -> DataFrame:
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^file:/+", "/")
    return files.select(*_placed(_under(path, root), F.col("value")))


def _under(path: Column, root: str) -> Column:
    plain = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    return F.regexp_replace(path, rf"^.*?\Q{plain}\E/", "")


def read_lesson(spark: SparkSession, path: str) -> DataFrame:
    """One file as one row: the whole text, so that its lines keep their order."""
    return _scanned(spark.read.text(path, wholetext=True), path.rsplit("/", 1)[0] if "/" in path else ".")


def read_lessons(spark: SparkSession, directory: str) -> DataFrame:
    """All *.txt files under a directory.  Courses are keyed by their path under it, so that two files of one name in
    two folders stay two courses.  Files on a mounted file system are listed and read by tasks of many files each; those
    on any other are left to Spark."""
    if folder := stored.mounted(spark, directory):
        return stored.contents(spark, folder, ".txt").select(*_placed(F.col("rel_path"), F.col("content").cast("string")))
    return _scanned(spark.read.text(directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt"), directory)


def literal_lesson(spark: SparkSession, text: str) -> DataFrame:
    """A text given as such is one sentence: neither split nor rewritten."""
    return spark.createDataFrame([(text,)], "text string")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df
