"""WAV files in binary columns: samples, durations, and the way back.  Only these need Python."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)


def _open(content: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(content)) as sound:
        width, channels, rate = sound.getsampwidth(), sound.getnchannels(), sound.getframerate()
        raw = sound.readframes(sound.getnframes())
    if width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        kind, zero, full = {1: (np.uint8, 128, 128), 2: ("<i2", 0, 1 << 15), 4: ("<i4", 0, 1 << 31)}[width]
        x = (np.frombuffer(raw, kind).astype(np.float64) - zero) / full
    return x.reshape(-1, channels).mean(axis=1), rate


def decode(content: Column) -> Column:
    """struct(samples, sr, duration_s); nulls for what can't be read, so that it has no pauses."""

    @F.pandas_udf("samples array<double>, sr int, duration_s double")
    def decoded(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                x, rate = _open(content)
                rows.append((x, rate, len(x) / rate))
            except Exception:
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["samples", "sr", "duration_s"])

    return decoded(content)


def encode(samples: Column, sr: Column) -> Column:
    """16-bit mono WAV bytes of samples within -1 and 1."""

    @F.pandas_udf("binary")
    def encoded(xs: pd.Series, rates: pd.Series) -> pd.Series:
        out = []
        for x, rate in zip(xs, rates, strict=True):
            file = io.BytesIO()
            with wave.open(file, "wb") as sound:
                sound.setnchannels(1)
                sound.setsampwidth(2)
                sound.setframerate(int(rate))
                sound.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).round().astype("<i2").tobytes())
            out.append(file.getvalue())
        return pd.Series(out)

    return encoded(samples, sr)
