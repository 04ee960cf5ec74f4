"""Command line: lesson files or folders to course archives, lists of categories and voices."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog, courses, increments
from lectern.plans.course import build_courses
from lectern.sources import archives, files, lesson_files


def convert(spark: SparkSession, lessons: DataFrame, target: str, voice: str | None = None, engine: str = "stub", category: str | None = None, splitter: str = "auto", suffix: str = ".pack") -> int:
    """Writes one archive for each lesson with any text; returns their number."""
    built = build_courses(lessons, "course_path", "text", splitter, engine)
    named = lessons.select("course_path", "course_name", "first_dir").join(built, "course_path")
    slug = catalog.batch_category(F.col("first_dir"), F.lit(category).cast("string"))
    said = catalog.voice(F.lit(voice).cast("string"), catalog.VOICES)["voice"]
    rows = named.select(
        F.regexp_replace("course_path", r"\.txt$", "").alias("name"),
        courses.course_json(F.col("sentences")).alias("course_json"),
        F.to_json(courses.course_meta(F.col("course_name"), F.lit(engine), said, slug)).alias("meta_json"),
        F.array().cast("array<struct<path:string,content:binary>>").alias("sounds"),
    )
    return archives.write_archives(archives.build_archives(rows, suffix), target)


def convert_new(spark: SparkSession, lessons: DataFrame, target: str, manifest: str, date: str, rebuild: bool = False, limit: int | None = None, verify: bool = True, category: str | None = None, **more) -> int:
    """Converts the lessons that the manifest doesn't name, at most ``limit`` of each category, and records those whose
    archive is there.  rebuild: all lessons, recorded once each.  verify=False records without looking.  A lesson is known
    by its category, the date and its path."""
    known = archives.read_manifest(spark, manifest) if os.path.exists(manifest) else spark.createDataFrame([], "slug string, date string, title string")
    slug = F.coalesce(catalog.batch_category(F.col("first_dir"), F.lit(category).cast("string")), F.lit(""))
    items = lessons.withColumns({"slug": slug, "date": F.lit(date), "title": F.col("course_path")})
    same = known.select("slug", "title").distinct()
    wanted = items if rebuild else items.join(same, ["slug", "title"], "left_anti")
    if limit is not None:
        wanted = increments.first_of_category(wanted, limit, ["course_path"]).drop("rank")
    made = convert(spark, wanted.select(*lessons.columns), target, category=category, **more)
    tried = wanted.select(*increments.KEY)
    if verify:
        there = files.listed(spark, target).select(F.regexp_replace("rel_path", r"\.[^./]*$", ".txt").alias("title"))
        tried = tried.join(there, "title", "left_semi").select(*increments.KEY)
    again = tried.select("slug", "title")
    kept = known.join(again, ["slug", "title"], "left_anti").select(*increments.KEY) if rebuild else known
    archives.write_manifest(increments.recorded(kept, tried.withColumn("ok", F.lit(True))), manifest)
    return made


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern", description=__doc__)
    parser.add_argument("what", help="'voices', 'categories', a .txt file, a folder, or a text to speak")
    parser.add_argument("-o", "--output", default="courses")
    parser.add_argument("--voice")
    parser.add_argument("--engine", default="stub")
    parser.add_argument("--category")
    parser.add_argument("--splitter", default="auto")
    parser.add_argument("--suffix", default=".pack")
    parser.add_argument("--manifest", help="a JSON file of what was converted before; only new lessons are, and are added")
    parser.add_argument("--date", default=datetime.now(UTC).date().isoformat(), help="the date to record in the manifest")
    parser.add_argument("--rebuild", action="store_true", help="convert what the manifest names too")
    parser.add_argument("--limit", type=int, help="with a manifest: at most so many lessons of a category")
    parser.add_argument("--skip-verify", action="store_true", help="with a manifest: record without looking for the archives")
    parser.add_argument("--extract", metavar="DIR", help="write the archives inside a zip file that DIR lacks")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if args.what == "voices":
        for row in catalog.voices(spark).orderBy("pos").collect():
            print(row["voice"])
    elif args.what == "categories":
        for row in catalog.categories(spark).orderBy("pos").select(catalog.category_line(F.col("slug"), F.col("name")).alias("line")).collect():
            print(row["line"])
    elif args.extract:
        print(f"{archives.extract_new(spark, args.what, args.extract, args.suffix)} new archive(s) in {args.extract}")
    elif os.path.exists(args.what):
        folder = os.path.isdir(args.what)
        read = lesson_files.read_lessons if folder else lesson_files.read_lesson
        more = {"voice": args.voice, "engine": args.engine, "category": args.category, "splitter": args.splitter, "suffix": args.suffix}
        try:
            lessons = lesson_files.require_rows(read(spark, os.path.abspath(args.what)), f"lessons in {args.what}" if folder else "text")
        except ValueError as error:
            print(error, file=sys.stderr)
            return 1
        if args.manifest:
            made = convert_new(spark, lessons, args.output, os.path.abspath(args.manifest), args.date, args.rebuild, args.limit, not args.skip_verify, **more)
        else:
            made = convert(spark, lessons, args.output, **more)
        if not made and not args.manifest:
            print("No sentences found.", file=sys.stderr)
            return 1
        print(f"{made} course(s) in {args.output}")
    else:
        row = catalog.speak(lesson_files.literal_lesson(spark, args.what), "text", args.engine).select("speech.*").first()
        print(f"{row['duration_s']:.2f} s at {row['sample_rate']} Hz")
    return 0


if __name__ == "__main__":
    sys.exit(main())
