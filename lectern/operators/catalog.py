"""Small dimensions: categories, voices, speech engines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Category slugs and names, in order of declaration.
CATEGORIES = {
    "business-politics": "Business & Politics",
    "culture-society": "Culture & Society",
    "health-lifestyle": "Health & Lifestyle",
    "science-technology": "Science & Technology",
    "travel-experiences": "Travel & Experiences",
}

# Voices of the "kokoro" engine; its first is the default.
VOICES = """
    af_sarah af_nicole af_sonia af_reese af_liam
    am_michael am_michael_2 am_adam am_mic...tral
    bf_emma bf_ella bf_isabella bf_lily
    bm_george bm_leon bf_rare_1 bf_rare_2
""".split()


def _names() -> Column:
    return F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])


def category_name(slug: Column) -> Column:
    """The slug's name; an unknown slug names itself, none is empty."""
    slug = F.coalesce(slug, F.lit(""))
    return F.coalesce(_names()[slug], slug)


def detected_category(directory: Column) -> Column:
    """A directory name that is a slug, else null."""
    return F.when(directory.isin(*CATEGORIES), directory)


def batch_category(directory: Column, given: Column) -> Column:
    """A detected category goes before the given one."""
    return F.coalesce(detected_category(directory), given)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(CATEGORIES.items())], "pos int, slug string, name string")


def category_line(slug: Column, name: Column) -> Column:
    """Slug filled up to 25 characters, a space, name; longer slugs are not cut."""
    return F.concat(F.when(F.length(slug) < 25, F.rpad(slug, 25, " ")).otherwise(slug), F.lit(" "), name)


def voice(asked: Column, known: list[str]) -> Column:
    """struct(voice, known): none asked for, or an unknown one, gives the first; known is false only for the latter."""
    found = asked.isin(*known)
    return F.struct(F.when(found, asked).otherwise(F.lit(known[0])).alias("voice"), (asked.isNull() | found).alias("known"))


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(VOICES)], "pos int, voice string")


def discovered_voices(spark: SparkSession, directory: str) -> list[str]:
    """Sorted stems of the *.onnx files in a directory; none if there is no such directory."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(n.removesuffix(".onnx") for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.endswith(".onnx"))


#: Speech engines: name -> function from texts to rows of (duration_s, sample_rate, error).
ENGINES: dict[str, Callable[[pd.Series], pd.DataFrame]] = {}


def register_engine(name: str):
    def add(function: Callable[[pd.Series], pd.DataFrame]):
        ENGINES[name] = function
        return function

    return add


def engines() -> list[str]:
    return sorted(ENGINES)


def engine(name: str) -> Callable[[pd.Series], pd.DataFrame]:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(engines())}")
    return ENGINES[name]


@register_engine("stub")
def stub_speech(texts: pd.Series) -> pd.DataFrame:
    """Speech of 60 ms a character at 24 kHz: no sound, but durations that depend on the text alone."""
    return pd.DataFrame({"duration_s": texts.fillna("").str.len() * 0.06, "sample_rate": 24000, "error": None})


_SPEECH = pa.struct([("duration_s", pa.float64()), ("sample_rate", pa.int32()), ("error", pa.string())])


def speak(rows: DataFrame, text_col: str, name: str = "stub") -> DataFrame:
    """Adds speech: struct(duration_s, sample_rate, error).  A text that fails has an error and no duration.

    The engine runs over Arrow batches as an opaque step, so the optimizer can't call it again for each field used.
    """
    function = engine(name)
    at = rows.columns.index(text_col)

    def alone(text: str | None) -> dict:
        try:
            return function(pd.Series([text])).iloc[0].to_dict()
        except Exception as error:
            return {"duration_s": None, "sample_rate": None, "error": str(error)}

    def said(texts: list[str | None]) -> list[dict]:
        try:
            return function(pd.Series(texts, dtype=object)).to_dict("records")
        except Exception:  # one bad text must not fail the others: they are tried alone
            return [alone(t) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = said(batch.column(at).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPEECH)], names=[*batch.schema.names, "speech"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("speech", StructType.fromDDL("duration_s double, sample_rate int, error string"))]))
