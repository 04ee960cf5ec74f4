import math
import statistics

import pytest
from pyspark.sql import functions as F

from lectern.operators import pauses, timing
from lectern.sources import sounds


def plain_pauses(x, sr):
    width = int(0.02 * sr)
    rms = [math.sqrt(sum(v * v for v in x[i : i + width]) / len(x[i : i + width])) for i in range(0, len(x), width)]
    smooth = [sum(rms[max(0, j - 2) : j + 1]) / len(rms[max(0, j - 2) : j + 1]) for j in range(len(rms))]
    quiet = [e < statistics.median(smooth) * 0.08 for e in smooth]
    out, start = [], None
    for j, q in enumerate([*quiet, False]):
        if q and start is None:
            start = j * (width / sr)
        elif not q and start is not None:
            end = len(x) / sr if j == len(quiet) else j * (width / sr)
            if end - start >= 0.1:
                out.append((round(start, 9), round(end, 9)))
            start = None
    return out


def tone(n, quiet, level=0.5):
    return [0.0 if any(a <= i < b for a, b in quiet) else level * math.sin(i) for i in range(n)]


SIGNALS = {
    1: (1000, tone(2000, [(500, 900)])),
    2: (1000, tone(2000, [(500, 640), (1700, 2000)])),  # a short run of quiet frames, and one to the end
    3: (1000, tone(2000, [(0, 1500)])),  # mostly silent: no threshold, no pauses
    4: (8000, tone(8000, [(1600, 2720)])),
    5: (1000, tone(1010, [(860, 1010)])),  # a partial last frame
    6: (1000, tone(30, [])),
    7: (1000, tone(3000, [(300, 420), (600, 700), (1000, 1100)])),
}


def test_pauses_against_a_loop(spark):
    df = spark.createDataFrame([(k, sr, x) for k, (sr, x) in SIGNALS.items()], "id int, sr int, samples array<double>")
    got = pauses.pauses(df, "id").collect()
    for k, (sr, x) in SIGNALS.items():
        assert sorted((round(r.start_s, 9), round(r.end_s, 9)) for r in got if r.id == k) == plain_pauses(x, sr), k
    assert pauses.pauses(df.limit(0), "id").count() == 0


def test_sounds_round_trip(spark):
    x = tone(400, [(100, 200)])
    df = spark.createDataFrame([(1, x)], "id int, samples array<double>").select("id", sounds.encode(F.col("samples"), F.lit(8000)).alias("content"))
    r = df.union(spark.createDataFrame([(2, bytearray(b"no sound"))], "id int, content binary")).select("id", sounds.decode(F.col("content")).alias("s")).orderBy("id").collect()
    assert r[0].s.sr == 8000 and r[0].s.duration_s == 0.05
    assert max(abs(a - b) for a, b in zip(r[0].s.samples, x, strict=True)) < 1e-4
    assert r[1].s.samples is None


@pytest.mark.parametrize(("text", "apart", "words"), [("Hi!there, 2.5", True, ["Hi", "there", "2", "5"]), ("Hi!there, 2.5", False, ["Hi", "!there", "2", "5"]), ("a  b?\nc", True, ["a", "b", "c"])])
def test_words(spark, text, apart, words):
    rows = spark.createDataFrame([(1, text, 2.0)], "id int, t string, d double")
    got = timing.rounded(timing.word_intervals(rows, "id", "t", "d", closing_apart=apart)).orderBy("pos").collect()
    assert [r.word for r in got] == words
    assert got[0].start_s == 0 and got[-1].end_s == 2
    assert all(a.end_s == b.start_s for a, b in zip(got, got[1:], strict=False))


def test_weights_and_wordless_texts(spark):
    rows = spark.createDataFrame([(1, "aa b", 3.0), (2, "?!", 1.0), (3, " ", 1.0)], "id int, t string, d double")
    got = {(r.id, r.pos): (r.word, r.start_s, r.end_s) for r in timing.word_intervals(rows, "id", "t", "d", weight=F.length).collect()}
    assert got == {(1, 0): ("aa", 0.0, 2.0), (1, 1): ("b", 2.0, 3.0), (2, 0): ("?!", 0.0, 1.0), (3, 0): ("", 0.0, 1.0)}
    none = timing.word_intervals(rows, "id", "t", "d", weight=lambda w: F.lit(0)).collect()
    assert {(r.id, r.word) for r in none} == {(1, "aa b"), (2, "?!"), (3, "")}
    assert timing.word_intervals(rows, "id", "t", "d", blank=False).where("id = 3").count() == 0


@pytest.mark.parametrize("name", ["frame_energy", "smoothed_energy", "pause_regions"])
def test_signals_are_not_computed_again_for_each_frame(spark, name):
    """The samples' own expression stands once in the plan: neither in a filter nor in a frame's lambda."""
    from lectern.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("embedding#") <= 3 and plan.count("1.0E-4") == 1


def test_frames_of_nulls_and_empty_signals(spark):
    df = spark.createDataFrame([(1, 1000, None), (2, 1000, []), (3, 1000, [3.0, 4.0])], "id int, sr int, samples array<double>")
    got = {r.id: (len(r.frames), r.energy) for r in pauses.with_energy(pauses.with_frames(df)).collect()}
    assert got == {1: (0, []), 2: (0, []), 3: (1, [math.sqrt(12.5)])}


def test_sums_before_against_a_loop(spark):
    arrays = [[float(k * 7 % 12 + 1) for k in range(n)] for n in (0, 1, 3, 4, 5, 16, 17, 64, 257, 3000)]
    df = spark.createDataFrame([(x,) for x in [*arrays, None]], "x array<double>")
    for r in df.select("x", timing.sums_before(F.col("x")).alias("s")).collect():
        assert r.s == (None if r.x is None else [sum(r.x[:k]) for k in range(len(r.x))])


@pytest.mark.parametrize("weight", [None, F.length])
def test_no_array_goes_through_the_explosion(spark, weight):
    """Beside the exploded array a row carries its key and numbers only: arrays or texts would be copied for each word."""
    rows = spark.createDataFrame([(1, "aa b", 3.0)], "id int, t string, d double")
    plan = timing.word_intervals(rows, "id", "t", "d", weight=weight)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().head()
    kept = [plan.requiredChildOutput().apply(k).dataType().simpleString() for k in range(plan.requiredChildOutput().size())]
    assert kept and not {"string"} & set(kept) and not [k for k in kept if k.startswith("array")]
