"""Nested course records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.catalog import category_name


def sentence_audio(sent_id: Column) -> Column:
    return F.format_string("audio/sent_%04d.wav", sent_id.cast("int"))


def segment_audio(sent_id: Column, seg_pos: Column) -> Column:
    return F.format_string("audio/sent_%04d_%02d.wav", sent_id.cast("int"), seg_pos.cast("int"))


def courses(units: DataFrame, key: str) -> DataFrame:
    """(key, sentences) from units(key, sent_id, seg_pos, text, duration_s, error): seg_pos is -1 for a sentence itself.

    A sentence whose speech failed goes, with its segments; the others keep their ids.  Its segments stop before the
    first that failed; a sentence without any has null, so its JSON has no such field.  The rows of a course are shuffled
    once: what is grouped by course and sentence lies together by course already.
    """
    part = F.struct("seg_pos", "text", segment_audio(F.col("sent_id"), F.col("seg_pos")).alias("audio"), "duration_s")
    own, failed = F.col("seg_pos") < 0, F.col("error").isNotNull()
    grouped = units.repartition(key).groupBy(key, "sent_id").agg(
        F.max(F.when(own & ~failed, F.struct("text", "duration_s"))).alias("own"),
        F.min(F.when(~own & failed, F.col("seg_pos"))).alias("stop"),
        F.array_sort(F.collect_list(F.when(~own & ~failed, part))).alias("parts"),
    )
    spoken = F.filter("parts", lambda p: F.coalesce(p["seg_pos"] < F.col("stop"), F.lit(True)))
    segments = F.transform(spoken, lambda p: F.struct(p["text"].alias("text"), p["audio"].alias("audio"), p["duration_s"].alias("duration_s")))
    kept = grouped.where("own is not null").select(key, "sent_id", "own", F.when(F.size(spoken) > 0, segments).alias("segments"))
    record = F.struct(F.col("sent_id").cast("int").alias("id"), F.col("own.text").alias("text"), sentence_audio(F.col("sent_id")).alias("audio"), F.col("own.duration_s").alias("duration_s"), "segments")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(record)).alias("sentences"))


def course_json(sentences: Column) -> Column:
    """Compact JSON; the archive writer indents it."""
    return F.to_json(F.struct(sentences.alias("sentences")))


def course_meta(title: Column, engine: Column, voice: Column, category: Column, language: str = "en", version: str = "1.0") -> Column:
    """The description of a course; both category fields are null without a category."""
    slug = F.nullif(category, F.lit(""))
    return F.struct(title.alias("title"), F.lit(language).alias("language"), F.lit(version).alias("version"), engine.alias("engine"), voice.alias("voice"), slug.alias("category"), F.when(slug.isNotNull(), category_name(slug)).alias("category_name"))
