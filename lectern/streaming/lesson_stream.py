"""A folder of lessons as a stream: new files become paragraphs and sentences; the checkpoint is the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import sentences as S
from lectern.functions import spoken
from lectern.functions.text import lines, trim


def sentence_stream(spark: SparkSession, directory: str) -> DataFrame:
    """(course, para_pos, sent_pos, raw, display, tts): stateless, so every file is independent of the others."""
    files = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(directory, wholetext=True)
    paras = files.select(F.col("_metadata.file_path").alias("course"), F.posexplode(lines(F.col("value"))).alias("para_pos", "line"))
    paras = paras.select("course", "para_pos", trim(F.col("line")).alias("para")).where("para <> ''")
    rows = paras.select("course", "para_pos", F.posexplode(S.split_sentences(F.col("para"))).alias("sent_pos", "raw"))
    return rows.withColumns({"display": spoken.display_text(F.col("raw")), "tts": spoken.spoken_text(F.col("raw"))})


def run_once(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Handles what is new since the last run, then stops."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
