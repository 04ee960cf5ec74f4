"""From lesson texts to nested courses: one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import spoken
from lectern.operators import catalog, courses, lessons, segmenting


def spoken_units(texts: DataFrame, key: str, text_col: str = "text", splitter: str = "auto", engine: str = "stub") -> DataFrame:
    """(key, sent_id, seg_pos, text, tts, duration_s, error): every sentence (seg_pos -1) and, if there are more than one,
    its segments, which are cut from the shown text and have spoken texts of their own.  One pass: each text is split
    once and each unit goes through the speech engine once."""
    sents = lessons.sentences(texts, key, text_col).withColumn("display", spoken.display_text(F.col("raw")))
    parts = sents.select(key, "sent_id", "raw", "display", segmenting.splitter(splitter)(F.col("display")).alias("parts"))
    segments = F.when(F.size("parts") > 1, F.transform("parts", lambda p, i: F.struct(i.alias("seg_pos"), p.alias("text"), p.alias("source"))))
    own = F.struct(F.lit(-1).alias("seg_pos"), F.col("display").alias("text"), F.col("raw").alias("source"))
    units = parts.select(key, "sent_id", F.explode(F.concat(F.array(own), F.coalesce(segments, F.array()))).alias("u")).select(key, "sent_id", "u.*")
    said = catalog.speak(units.select(key, "sent_id", "seg_pos", "text", spoken.spoken_text(F.col("source")).alias("tts")), "tts", engine)
    return said.select(key, "sent_id", "seg_pos", "text", "tts", F.col("speech.duration_s").alias("duration_s"), F.col("speech.error").alias("error"))


def build_courses(texts: DataFrame, key: str, text_col: str = "text", splitter: str = "auto", engine: str = "stub") -> DataFrame:
    """(key, sentences)."""
    return courses.courses(spoken_units(texts, key, text_col, splitter, engine), key)


def describe(spark: SparkSession, name: str, engine: str = "stub", voice: str | None = None, category: str | None = None) -> str:
    """The meta record of one course as JSON; an unknown voice gives way to the default."""
    known = catalog.VOICES
    row = spark.range(1).select(F.to_json(courses.course_meta(F.lit(name), F.lit(engine), catalog.voice(F.lit(voice).cast("string"), known)["voice"], F.lit(category).cast("string"))).alias("meta"))
    return row.first()["meta"]
