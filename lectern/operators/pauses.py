"""Silence in sampled signals: frame energies, a trailing mean, a threshold from the median, runs below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import bind

# Seconds and ratios of the detector.
FRAME_S = 0.020
LEAST_PAUSE_S = 0.100
THRESHOLD_RATIO = 0.08
SMOOTHED_FRAMES = 3


def with_frames(signals: DataFrame, samples_col: str = "samples", sr_col: str = "sr") -> DataFrame:
    """Adds frames: array of (n, rms), tumbling frames of 20 ms of which the last may be shorter, and step: a frame's
    seconds.  Samples stay in their row; they are neither exploded nor shuffled.  They are bound, so that an expression
    behind them is computed once for a signal and not once for a frame."""
    width = F.floor(F.lit(FRAME_S) * F.col(sr_col)).cast("int")
    square = lambda a, x: a + x.cast("double") * x.cast("double")

    def frame(samples: Column, j: Column) -> Column:
        part = F.slice(samples, j * width + 1, width)
        return bind(part, lambda xs: F.struct(F.size(xs).cast("long").alias("n"), F.sqrt(F.aggregate(xs, F.lit(0.0), square) / F.size(xs)).alias("rms")))

    def frames(samples: Column) -> Column:
        starts = F.when(F.size(samples) > 0, F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda j: frame(samples, j))

    return signals.withColumns({"frames": bind(F.col(samples_col), frames), "step": width / F.col(sr_col)})


def with_energy(framed: DataFrame) -> DataFrame:
    """Adds energy: for each frame the mean rms over it and the two before it.  The frames' rms are bound, so that they are
    made once for a signal and not once for a frame, wherever the optimizer puts the expression."""

    def mean(rms: Column, j: Column) -> Column:
        first = F.greatest(j - (SMOOTHED_FRAMES - 1), F.lit(0))
        return F.aggregate(F.slice(rms, first + 1, j - first + 1), F.lit(0.0), lambda a, x: a + x) / (j - first + 1)

    return framed.withColumn("energy", bind(F.col("frames.rms"), lambda rms: F.transform(rms, lambda _, j: mean(rms, j))))


def _median(values: Column) -> Column:
    """The middle value, or the mean of the two."""
    return bind(F.array_sort(values), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


def pauses(signals: DataFrame, key: str, samples_col: str = "samples", sr_col: str = "sr") -> DataFrame:
    """(key, start_s, end_s) of runs of at least 100 ms below 8 % of the median energy; a run ends where the first louder
    frame starts, or with the signal.  A signal is one row, and so is all that is known of it until its runs are told."""
    marked = with_energy(with_frames(signals.select(key, F.col(samples_col).alias("samples"), F.col(sr_col).alias("sr"))))
    marked = marked.select(key, "sr", "step", F.size("samples").alias("n"), "energy", (_median(F.col("energy")) * THRESHOLD_RATIO).alias("threshold"))
    quiet = marked.select(key, "sr", "step", "n", F.transform("energy", lambda e: e < F.col("threshold")).alias("quiet"))
    places = F.transform("quiet", lambda _, j: j)
    begins = F.filter(places, lambda j: F.get("quiet", j) & ~F.coalesce(F.get("quiet", j - 1), F.lit(False)))
    ends = F.filter(places, lambda j: F.get("quiet", j) & ~F.coalesce(F.get("quiet", j + 1), F.lit(False)))
    runs = quiet.select(key, "sr", "step", "n", F.size("quiet").alias("last"), F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("r"))
    end = F.when(F.col("r.b") == F.col("last") - 1, F.col("n") / F.col("sr")).otherwise((F.col("r.b") + 1) * F.col("step"))
    spans = runs.select(key, (F.col("r.a") * F.col("step")).alias("start_s"), end.alias("end_s"))
    return spans.where(F.col("end_s") - F.col("start_s") >= LEAST_PAUSE_S)


def with_duration(spans: DataFrame) -> DataFrame:
    return spans.withColumn("duration_s", F.col("end_s") - F.col("start_s"))
