"""Files of any kind, written where their rows are, listed and read by tasks."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a task reads of files, at most but for a file larger than that, and what it hands on at a time.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 1 << 25, 10_000, 1 << 23


def _target(directory: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a plain path is a local one."""
    if "://" in directory or directory.startswith("file:"):
        return fs.FileSystem.from_uri(directory.replace("file:/", "file:///", 1) if directory.startswith("file:/") and not directory.startswith("file://") else directory)
    return fs.LocalFileSystem(), directory


def _batch(names: list[str], read: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(read, pa.binary())], names=["rel_path", "content"])


def write_files(rows: DataFrame, directory: str) -> DataFrame:
    """rows(file, content binary) -> (file, size), once something reads the result: every task writes its own rows' files
    below the directory, which all executors must reach.  A file appears under its name when it is whole, so a task that
    is tried again leaves nothing half done; two rows of one name leave one file."""
    _target(directory)  # an unknown kind of file system is an error here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _target(directory)
        mark, made = f"_{TaskContext.get().taskAttemptId()}", set()
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, content in zip(names, contents, strict=True):
                path = posixpath.join(base, name)
                folder, last = posixpath.split(path)
                part = posixpath.join(folder, f".{last}{mark}")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64())], names=["file", "size"])

    return rows.select(F.col("file").cast("string").alias("file"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "file string, size long")


def mounted(spark: SparkSession, directory: str) -> str | None:
    """The plain path of a folder that Python can reach on every machine; none if it is on another file system, or isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    plain = store.makeQualified(path).toUri()
    return plain.getPath() if plain.getScheme() == "file" and os.path.isdir(plain.getPath()) else None


def _shown(name: bytes) -> bool:
    """Whether Spark's own file sources would take a name."""
    return not (name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_"))


def _walk(root: bytes, top: bytes, suffix: bytes) -> Iterator[tuple[bytes, int]]:
    """Relative path and size of the files with content of the root itself, if top is empty, or else of all below top."""
    folders = [top]
    while folders:
        folder = folders.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                if not _shown(entry.name):
                    continue
                if entry.is_dir():
                    if top:
                        folders.append(os.path.join(folder, entry.name))
                elif entry.name.endswith(suffix) and (size := entry.stat().st_size):
                    yield os.path.join(folder, entry.name), size


def walked(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(rel_path binary, size) of all files with content below a mounted folder.  Each folder right below it is one
    task's, so the driver holds no list of files."""
    root, ending = os.fsencode(folder), os.fsencode(suffix)
    with os.scandir(root) as entries:
        tops = [b"", *(e.name for e in entries if _shown(e.name) and e.is_dir())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                found = _walk(root, top, ending)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.binary()), pa.array([s for _, s in part], pa.int64())], names=["rel_path", "size"])

    return spark.createDataFrame([(bytearray(t),) for t in tops], "top binary").mapInArrow(run, "rel_path binary, size long")


def contents(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(rel_path string, content binary) of all files with content below a mounted folder.  Tasks are as many as their
    bytes ask for: Spark's file sources count 4 MB for opening a file, which makes a task of a few small ones."""
    found = walked(spark, folder, suffix)
    n, size = found.select(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, -(-size // TASK_BYTES), -(-n // TASK_FILES), min(2 * spark.sparkContext.defaultParallelism, n // 64))
    root = os.fsencode(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, read, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with open(os.path.join(root, name), "rb") as file:
                    content = file.read()
                names.append(name.decode("utf-8", "replace"))
                read.append(content)
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _batch(names, read)
                    names, read, held = [], [], 0
            if names:
                yield _batch(names, read)

    return found.select("rel_path").repartition(tasks, "rel_path").mapInArrow(run, "rel_path string, content binary")


def listed(spark: SparkSession, directory: str) -> DataFrame:
    """(rel_path, size) of all files with content below a directory; none if there is no such directory.  No content is
    read."""
    if folder := mounted(spark, directory):
        return walked(spark, folder).select(F.col("rel_path").cast("string").alias("rel_path"), "size")
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return spark.createDataFrame([], "rel_path string, size long")
    root = store.makeQualified(path).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length")
    return files.select(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), rf"^.*?\Q{root}\E/", "").alias("rel_path"), F.col("length").alias("size"))


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
