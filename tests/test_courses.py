import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.operators import catalog, courses, increments, lessons
from lectern.plans.course import build_courses, describe, spoken_units
from lectern.sources import archives, files, lesson_files
from lectern.streaming import lesson_stream

LONG = "The Long Ferry Line was sold in May for 2.4 million francs (about  $7,300), and its oldest boats are now for hire at 120,000 pesos ($6,900) a week."


def test_segments_show_numbers_and_say_words(spark):
    df = spark.createDataFrame([("c", LONG)], "k string, text string")
    units = spoken_units(df, "k")
    rows = units.where("seg_pos >= 0").orderBy("seg_pos").collect()
    shown, said = " ".join(r.text for r in rows), " ".join(r.tts for r in rows)
    assert len(rows) == 4
    for number in ("2.4 million", "$7,300", "120,000", "$6,900"):
        assert number in shown
    for words in ("two point four million", "seven thousand three hundred dollars", "one hundred twenty thousand pesos", "six thousand nine hundred dollars"):
        assert words in said and words not in shown
    assert units.where("seg_pos = -1").first().text == LONG


def test_course_json_and_archive(spark):
    df = spark.createDataFrame([("c", f"Short one. {LONG}\nÜber.")], "k string, text string")
    built = build_courses(df, "k")
    sound = F.array(F.struct(F.lit("audio/sent_0000.wav").alias("path"), F.lit(b"RIFF").alias("content")))
    rows = built.select(F.lit("c").alias("name"), courses.course_json(F.col("sentences")).alias("course_json"), F.lit(describe(spark, "c", category="culture-society")).alias("meta_json"), sound.alias("sounds"))
    for name, file in (("c", "c.pack"), ("c.pack", "c.pack")):
        r = archives.build_archives(rows.withColumn("name", F.lit(name)), created_at="now").first()
        assert r.file == file
    with zipfile.ZipFile(io.BytesIO(r.content)) as z:
        assert z.namelist() == ["course.json", "meta.json", "audio/sent_0000.wav"]
        course, meta = json.loads(z.read("course.json")), json.loads(z.read("meta.json"))
    assert [s["id"] for s in course["sentences"]] == [0, 1, 2]
    assert "segments" not in course["sentences"][0] and course["sentences"][2]["text"] == "Über."
    assert [g["audio"] for g in course["sentences"][1]["segments"]] == [f"audio/sent_0001_{i:02d}.wav" for i in range(4)]
    assert meta == {"title": "c", "language": "en", "version": "1.0", "engine": "stub", "voice": "af_sarah", "category": "culture-society", "category_name": "Culture & Society", "created_at": "now"}
    assert "category" not in json.loads(describe(spark, "c"))


def test_failures(spark, monkeypatch):
    def picky(texts):
        if texts.str.contains("bad").any():
            raise RuntimeError("no voice")
        return catalog.stub_speech(texts)

    monkeypatch.setitem(catalog.ENGINES, "picky", picky)
    df = spark.createDataFrame([("c", "Good. This is bad. Fine.")], "k string, text string")
    assert [s.id for s in build_courses(df, "k", engine="picky").first().sentences] == [0, 2]
    long = "This sentence is so long, as anyone can see, that it has to be cut, and its bad third part, of all parts, has no voice at all."
    built = build_courses(spark.createDataFrame([("c", long)], "k string, text string"), "k", engine="picky")
    assert built.count() == 0  # the sentence itself has none either
    df = spark.createDataFrame([("c", 0, -1, "a b", 1.0, None), ("c", 0, 0, "a", 0.5, None), ("c", 0, 1, "b", None, "e"), ("c", 0, 2, "c", 0.5, None), ("c", 1, -1, "d", None, "e"), ("c", 1, 0, "d", 1.0, None), ("c", 2, -1, "x", 1.0, None), ("c", 2, 0, "x", None, "e")], "k string, sent_id int, seg_pos int, text string, duration_s double, error string")
    found = courses.courses(df, "k").first().sentences
    assert [(s.id, s.segments and [g.text for g in s.segments]) for s in found] == [(0, ["a"]), (2, None)]
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "e"), (1, 2, None), (2, 0, None), (2, 1, None)], "k int, seg_pos int, error string")
    assert sorted((r.k, r.seg_pos) for r in lessons.until_first_failure(rows, ["k"]).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_engines():
    @catalog.register_engine("mute")
    def mute(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"duration_s": 0.0 * texts.str.len(), "sample_rate": 1, "error": None})

    assert catalog.engines() == ["mute", "stub"] and catalog.engine("mute") is mute
    del catalog.ENGINES["mute"]
    with pytest.raises(ValueError, match="unknown engine"):
        catalog.engine("mute")


def test_catalog(spark, tmp_path):
    df = spark.createDataFrame([("culture-society",), ("x",), ("",), (None,)], "s string")
    got = df.select(catalog.category_name(F.col("s")), catalog.detected_category(F.col("s")), catalog.batch_category(F.col("s"), F.lit("given"))).collect()
    assert [tuple(r) for r in got] == [("Culture & Society", "culture-society", "culture-society"), ("x", None, "given"), ("", None, "given"), ("", None, "given")]
    line = df.select(catalog.category_line(F.lit("y" * 30), F.lit("n"))).first()[0]
    assert line == "y" * 30 + " n"
    asked = spark.createDataFrame([(None,), ("b",), ("z",)], "a string").select(catalog.voice(F.col("a"), ["a", "b"]).alias("v")).collect()
    assert [tuple(r.v) for r in asked] == [("a", True), ("b", True), ("a", False)]
    for name in ("b.onnx", "a.onnx", "a.json"):
        (tmp_path / name).touch()
    assert catalog.discovered_voices(spark, str(tmp_path)) == ["a", "b"]
    assert catalog.discovered_voices(spark, str(tmp_path / "none")) == []


ITEMS = "slug string, date string, title string, ok boolean"
OLD, NEW = ("business-politics", "2026-08-01T17:00:00Z", "Old Article"), ("business-politics", "2026-08-02T17:00:00Z", "New Article")


def test_increments(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps([OLD]))
    manifest = archives.read_manifest(spark, str(tmp_path / "manifest.json"))
    items = spark.createDataFrame([(*OLD, True), (*NEW, True)], ITEMS)
    new = increments.unpublished(items, manifest)
    assert [r[0] for r in new.select(increments.pack_name(F.col("date"), F.col("title"))).collect()] == ["day-20260802-new-article.pack"]
    assert increments.recorded(manifest, new).count() == 2
    assert increments.recorded(manifest.limit(0), new.withColumn("ok", F.lit(False))).count() == 0
    assert sorted(r[0] for r in items.select(increments.pack_name(F.col("date"), F.col("title"), ".x")).collect()) == ["day-20260801-old-article.x", "day-20260802-new-article.x"]
    assert increments.recorded(manifest, items).count() == 2
    assert [r.title for r in increments.first_of_category(items, 1, ["date"]).collect()] == ["Old Article"]


def test_extract_and_releases(spark, tmp_path):
    members = spark.createDataFrame([("All/a/x.pack", 3), ("All/b/y.pack", 4), ("z.pack", 5), ("All/a/readme.txt", 1), ("All/../../evil.pack", 6)], "member string, file_size long")
    there = spark.createDataFrame([("a/x.pack", 3), ("b/y.pack", 99)], "rel_path string, size long")
    got = sorted((r.rel_path, r.file_size) for r in increments.to_extract(members, there).collect())
    assert got == [("b/y.pack", 4), ("evil.pack", 6), ("z.pack", 5)]
    releases = [{"tag_name": f"v{i}", "created_at": f"2026-01-0{i}T00:00:00Z", "assets": [{"name": "a.zip", "size": 2048 * i, "browser_download_url": "u"}, {"name": "b.txt", "size": 1, "browser_download_url": "u"}]} for i in range(1, 8)]
    (tmp_path / "r.json").write_text(json.dumps(releases))
    df = archives.read_releases(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in increments.list_releases(df, 2).collect()] == [("v7", "2026-01-07", 2), ("v6", "2026-01-06", 2)]
    assert increments.release(df).first().tag_name == "v7" and increments.release(df, "v3").first().tag_name == "v3"
    assert [tuple(r) for r in increments.zip_assets(increments.release(df, "v2")).collect()] == [("v2", "a.zip", 4.0)]
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("All/a/x.pack", "abc")
    assert [(r.member, r.file_size) for r in archives.members(spark, str(tmp_path / "all.zip")).collect()] == [("All/a/x.pack", 3)]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in put"
    for path, text in {"top.txt": "One. Two.", "culture-society/a.txt": "Hello there.\n\nAgain.", "other/deep/a.txt": "Bye.", "other/empty.txt": "\n \n", "other/no.md": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_lesson_files(spark, folder):
    got = lesson_files.read_lessons(spark, str(folder)).orderBy("course_path").collect()
    assert [(r.course_path, r.course_name, r.first_dir) for r in got] == [("culture-society/a.txt", "a", "culture-society"), ("other/deep/a.txt", "a", "other"), ("other/empty.txt", "empty", "other"), ("top.txt", "top", None)]
    assert lesson_files.read_lesson(spark, str(folder / "top.txt")).first().course_path == "top.txt"
    with pytest.raises(ValueError, match="no lessons"):
        lesson_files.require_rows(lesson_files.read_lessons(spark, str(folder)).limit(0), "lessons")


def test_lessons_are_read_in_tasks_of_many_files(spark, tmp_path):
    """As Spark's own source reads them, names and bytes of all kinds, but not in a task for every 32 files."""
    root = tmp_path / "in put"
    texts = {f"s {i % 3}/d{i}.txt": f"Text {i}.\n".encode() for i in range(1500)}
    texts |= {"a+b %20é/x.y.txt": "Über\r\n".encode(), "deep/er/ä.txt": b"\xff\xfe\x00", "top.txt": b"\xef\xbb\xbfOne", "_=/in.txt": b"1", "none.txt": b"", ".hid.txt": b"1", "_hid/a.txt": b"1", "s 0/.hid/a.txt": b"1", "s 0/a.md": b"1"}
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text)
    got = lesson_files.read_lessons(spark, str(root))
    source = lesson_files._scanned(spark.read.text(str(root), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt"), str(root))
    assert got.rdd.getNumPartitions() <= 8 < source.rdd.getNumPartitions()
    shown = lambda df: sorted(tuple(r) for r in df.select("course_path", "course_name", F.coalesce("first_dir", F.lit("-")), F.hex("text")).collect())
    assert shown(got) == shown(source) and got.count() == 1504
    assert shown(lesson_files.read_lessons(spark, f"file://{root}")) == shown(got)
    with pytest.raises(Exception, match="(?i)path"):
        lesson_files.read_lessons(spark, str(tmp_path / "none"))


def test_folder_to_archives(spark, folder, tmp_path):
    n = cli.convert(spark, lesson_files.read_lessons(spark, str(folder)), str(tmp_path / "out"), category="given")
    made = sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.pack"))
    assert n == 3 and made == ["culture-society/a.pack", "other/deep/a.pack", "top.pack"]
    metas = {}
    for name in made:
        with zipfile.ZipFile(tmp_path / "out" / name) as z:
            metas[name] = json.loads(z.read("meta.json"))["category"]
    assert metas == {"culture-society/a.pack": "culture-society", "other/deep/a.pack": "given", "top.pack": "given"}


def test_stream_takes_only_what_is_new(spark, folder, tmp_path):
    out, mark = str(tmp_path / "rows"), str(tmp_path / "mark")
    for n in (5, 6):
        lesson_stream.run_once(lesson_stream.sentence_stream(spark, str(folder)), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == n
        (folder / "new.txt").write_text("It is 2.5 now")
    assert spark.read.parquet(out).where("tts = 'It is two point five now'").count() == 1


def test_files_are_written_where_their_rows_are(spark, tmp_path):
    rows = spark.createDataFrame([(f"a b/{i}.x", bytearray(b"x" * i)) for i in range(1, 21)], "file string, content binary").repartition(3)
    for base in (str(tmp_path / "out"), f"file://{tmp_path}/out"):
        assert sorted(tuple(r) for r in files.write_files(rows, base).collect()) == sorted((f"a b/{i}.x", i) for i in range(1, 21))
    assert sorted(tuple(r) for r in files.listed(spark, str(tmp_path / "out")).collect()) == sorted((f"a b/{i}.x", i) for i in range(1, 21))
    assert not [p for p in (tmp_path / "out").rglob(".*") if "_" in p.name]
    assert files.listed(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)scheme|unrecognized|filesystem"):
        files.write_files(rows, "nothing://x/y")


def test_extraction_writes_only_what_is_missing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name, text in (("All/a/x.pack", "abc"), ("All/b/y.pack", "abcd"), ("All/readme.txt", "no"), ("All/../../evil.pack", "e")):
            z.writestr(name, text)
    (tmp_path / "out/a").mkdir(parents=True)
    (tmp_path / "out/a/x.pack").write_text("abc")
    assert archives.extract_new(spark, str(tmp_path / "all.zip"), str(tmp_path / "out")) == 2
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*.pack")} == {"a/x.pack": "abc", "b/y.pack": "abcd", "evil.pack": "e"}
    assert archives.extract_new(spark, str(tmp_path / "all.zip"), str(tmp_path / "out"), keep=False) == 0
    assert not (tmp_path / "all.zip").exists()


def test_manifest_of_converted_lessons(spark, folder, tmp_path):
    lessons, out, manifest = lesson_files.read_lessons(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "m.json")
    titles = lambda: sorted(x[2] for x in json.loads((tmp_path / "m.json").read_text()))
    assert cli.convert_new(spark, lessons, out, manifest, "2026-01-01", limit=1, category="given") == 2  # of each category
    assert titles() == ["culture-society/a.txt", "other/deep/a.txt"]
    assert cli.convert_new(spark, lessons, out, manifest, "2026-01-02", category="given") == 1
    assert titles() == ["culture-society/a.txt", "other/deep/a.txt", "top.txt"]  # the empty one has no archive
    assert cli.convert_new(spark, lessons, out, manifest, "2026-01-03", category="given") == 0
    assert cli.convert_new(spark, lessons, out, manifest, "2026-01-04", rebuild=True, category="given") == 3
    assert len(titles()) == 3 and {x[1] for x in json.loads((tmp_path / "m.json").read_text())} == {"2026-01-04"}
    cli.convert_new(spark, lessons, out, manifest, "2026-01-05", verify=False, category="given")
    assert "other/empty.txt" in titles()


def test_nothing_to_convert_is_an_error_with_a_message(spark, tmp_path, capsys):
    (tmp_path / "none").mkdir()
    assert cli.main([str(tmp_path / "none"), "-o", str(tmp_path / "out")]) == 1
    assert "no lessons" in capsys.readouterr().err
    (tmp_path / "empty.txt").write_text(" \n")
    assert cli.main([str(tmp_path / "empty.txt"), "-o", str(tmp_path / "out")]) == 1
    assert "No sentences" in capsys.readouterr().err
