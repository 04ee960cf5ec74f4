"""Course archives: a zip with course.json, meta.json and the sounds of its sentences and segments."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import increments
from lectern.sources import files

_ENTRY = (1980, 1, 1, 0, 0, 0)


def pack(course: str, meta: str, sounds: dict[str, bytes], created_at: str) -> bytes:
    """The archive's bytes.  Only sounds handed in are packed, none that an earlier run left behind."""
    out = io.BytesIO()
    described = {k: v for k, v in json.loads(meta).items() if v is not None} | {"created_at": created_at}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in (("course.json", json.loads(course)), ("meta.json", described)):
            archive.writestr(zipfile.ZipInfo(name, _ENTRY), json.dumps(content, ensure_ascii=False, indent=2), zipfile.ZIP_DEFLATED)
        for name in sorted(sounds):
            archive.writestr(zipfile.ZipInfo(name, _ENTRY), sounds[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def build_archives(courses: DataFrame, suffix: str = ".pack", created_at: str | None = None) -> DataFrame:
    """courses(name, course_json, meta_json, sounds array<struct<path, content>>) -> (file, content): an archive a course,
    built where the course is."""
    when = created_at or datetime.now(UTC).isoformat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = row["name"] if row["name"].endswith(suffix) else row["name"] + suffix
                content = pack(row["course_json"], row["meta_json"], {s["path"]: s["content"] for s in row["sounds"] or []}, when)
                yield pa.RecordBatch.from_pydict({"file": [name], "content": [content]})

    return courses.select("name", "course_json", "meta_json", "sounds").mapInArrow(run, "file string, content binary")


def write_archives(archives: DataFrame, directory: str) -> int:
    """Writes the archives from where they were built; returns their number."""
    return files.write_files(archives, directory).count()


def extract_new(spark: SparkSession, path: str, directory: str, suffix: str = ".pack", keep: bool = True) -> int:
    """Writes the members of zip files that end in suffix and aren't in the directory at equal size; returns their number.
    keep=False deletes the zip files afterwards.  Contents are read again for the members that are wanted only."""
    found = members(spark, path)
    wanted = increments.to_extract(found.select("member", "file_size"), files.listed(spark, directory), suffix)
    rows = found.join(wanted.select("member", "rel_path").distinct(), "member").select(F.col("rel_path").alias("file"), "content")
    n = files.write_files(rows, directory).count()
    if not keep:
        files.remove(spark, path)
    return n


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, file_size, content) of zip files."""
    return members_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def members_of(zips: DataFrame) -> DataFrame:
    """(archive, member, file_size, content) of zips(path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with zipfile.ZipFile(io.BytesIO(row["content"])) as archive:
                    for info in archive.infolist():
                        yield pa.RecordBatch.from_pydict({"archive": [row["path"]], "member": [info.filename], "file_size": [info.file_size], "content": [archive.read(info)]})

    return zips.mapInArrow(run, "archive string, member string, file_size long, content binary")


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Release lists from JSON files."""
    return spark.read.schema("tag_name string, created_at string, assets array<struct<name: string, size: bigint, browser_download_url: string>>").json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of [slug, date, title] triples as rows."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return rows.select(F.col("r")[0].alias("slug"), F.col("r")[1].alias("date"), F.col("r")[2].alias("title"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The triples as one JSON array, in order; a manifest is small."""
    rows = sorted((r["slug"], r["date"], r["title"]) for r in manifest.collect())
    text = json.dumps([list(r) for r in rows], ensure_ascii=False)
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    one = manifest.sparkSession.createDataFrame([(name, bytearray(text.encode()))], "file string, content binary")
    files.write_files(one, folder).count()
