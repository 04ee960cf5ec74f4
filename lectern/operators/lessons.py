"""From texts to paragraphs and numbered sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import sentences as S
from lectern.functions import spoken
from lectern.functions.text import lines, trim


def paragraphs(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, para_pos, para): trimmed lines that aren't blank, numbered by their line."""
    rows = texts.select(key, F.posexplode(lines(F.col(text_col))).alias("para_pos", "line"))
    return rows.select(key, "para_pos", trim(F.col("line")).alias("para")).where("para <> ''")


def _paragraphs_of(text: Column) -> Column:
    return F.filter(F.transform(lines(text), trim), lambda p: p != "")


def sentences(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, sent_id, raw): sentence ids count through a text from 0.

    A text's sentences are made in its row, so their positions are their ids and nothing is shuffled.
    """
    said = F.flatten(F.transform(_paragraphs_of(F.col(text_col)), S.split_sentences))
    return texts.select(key, F.posexplode(said).alias("sent_id", "raw"))


def with_speech(rows: DataFrame, text_col: str = "raw") -> DataFrame:
    """Adds display and tts."""
    return rows.withColumns({"display": spoken.display_text(F.col(text_col)), "tts": spoken.spoken_text(F.col(text_col))})


def keep_spoken(rows: DataFrame, failed_col: str = "error") -> DataFrame:
    """Sentences whose speech failed go; the others keep their ids."""
    return rows.where(F.col(failed_col).isNull())


def until_first_failure(segments: DataFrame, keys: list[str], failed_col: str = "error") -> DataFrame:
    """The segments of each sentence before its first failed one."""
    whole = Window.partitionBy(*keys)
    first = F.min(F.when(F.col(failed_col).isNotNull(), F.col("seg_pos"))).over(whole)
    return segments.withColumn("first_failed", first).where("first_failed is null or seg_pos < first_failed").drop("first_failed")


def counts(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, n_paragraphs, n_sentences) of texts with any, from one scan."""
    paras = texts.select(key, _paragraphs_of(F.col(text_col)).alias("paras")).where(F.size("paras") > 0)
    n_sentences = F.aggregate("paras", F.lit(0).cast("long"), lambda n, p: n + F.size(S.split_sentences(p)))
    return paras.select(key, F.size("paras").cast("long").alias("n_paragraphs"), n_sentences.alias("n_sentences"))
