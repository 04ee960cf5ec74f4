"""Word intervals inside a spoken sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, bind, trim

PUNCTUATION = (".", ",", "?", "!")


def tokens(text: Column, closing_apart: bool = True) -> Column:
    """Words between white space with . , ? ! set apart; closing_apart=False puts no space after ? and !."""
    spaced = F.regexp_replace(text, "([.,?!])", " $1 ") if closing_apart else F.regexp_replace(F.regexp_replace(text, "([.,])", " $1 "), "([?!])", " $1")
    return F.filter(F.split(spaced, rf"{SPACE}+", -1), lambda w: w != "")


def _running(numbers: Column) -> Column:
    """The sums before each number, appended one by one: for short arrays."""
    sums = F.aggregate(numbers, F.array(F.lit(0.0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    return bind(sums, lambda s: F.slice(s, 1, F.size(s) - 1))


def sums_before(numbers: Column, levels: int = 5) -> Column:
    """For each number of an array that isn't empty the sum of those before it; a null counts as zero.

    Sums of four numbers each come first, and the sums before these are found in the same way, so the work grows with the
    length: only an array shorter by 4 ** levels is built up number by number.
    """
    if not levels:
        return _running(numbers)

    def of(xs: Column) -> Column:
        at = lambda k, n: F.coalesce(F.get(xs, k * 4 + n if n else k * 4), F.lit(0.0))
        fours = F.sequence(F.lit(0), F.shiftright(F.size(xs) - 1, 2))
        totals = F.transform(fours, lambda k: at(k, 0) + at(k, 1) + at(k, 2) + at(k, 3))

        def four(first: Column, k: Column) -> Column:
            return F.array(first, first + at(k, 0), first + at(k, 0) + at(k, 1), first + at(k, 0) + at(k, 1) + at(k, 2))

        return F.slice(F.flatten(F.transform(sums_before(totals, levels - 1), four)), F.lit(1), F.size(xs))

    return bind(numbers, lambda xs: F.when(F.size(xs) > 0, of(xs)).otherwise(F.transform(xs, lambda _: F.lit(0.0))))


def word_intervals(rows: DataFrame, key: str, text_col: str, duration_col: str, weight=None, closing_apart: bool = True, blank: bool = True) -> DataFrame:
    """(key, pos, word, start_s, end_s), unrounded: each word's share of the duration is that of its weight.

    weight: word column -> number column, 1 by default.  Without any weight the whole text is one interval; a blank
    text has it only if ``blank``.  The last word ends with the sentence.  Sums are made in the row: nothing is shuffled.
    """
    words = F.filter(tokens(F.col(text_col), closing_apart), lambda w: ~w.isin(*PUNCTUATION))
    base = rows.select(F.col(key), F.col(text_col).alias("text"), F.col(duration_col).cast("double").alias("duration"), words.alias("words"))
    if weight is None:
        base = base.withColumn("total", F.size("words").cast("double"))
    else:
        base = base.withColumn("weights", F.transform("words", lambda w: weight(w).cast("double")))
        base = base.withColumn("total", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)).withColumn("before", sums_before(F.col("weights")))
    alone = F.lit(True) if blank else (F.size("words") > 0) | (trim(F.col("text")) != "")
    alone = F.when(alone, F.array(trim(F.col("text")))).otherwise(F.array().cast("array<string>"))
    # Only words and numbers go through the explosion: an array there, if only for its size, would be copied for each word.
    base = base.withColumn("n", F.size("words"))
    if weight is None:
        spread = base.select(key, "duration", "total", "n", F.posexplode(F.when(F.col("total") > 0, F.col("words")).otherwise(alone)).alias("pos", "word"))
        before, own = F.col("pos").cast("double"), F.lit(1.0)
    else:
        nothing = F.array_repeat(F.lit(None).cast("double"), F.size(alone))
        entries = F.when(F.col("total") > 0, F.arrays_zip(F.col("words").alias("word"), "before", F.col("weights").alias("weight")))
        entries = entries.otherwise(F.arrays_zip(alone.alias("word"), nothing.alias("before"), nothing.alias("weight")))
        spread = base.select(key, "duration", "total", "n", F.posexplode(entries).alias("pos", "w")).select(key, "duration", "total", "n", "pos", "w.*")
        before, own = F.col("before"), F.col("weight")
    whole = F.col("total") <= 0
    start = F.when(whole, 0.0).otherwise(F.col("duration") * before / F.nullif(F.col("total"), F.lit(0.0)))
    end = F.when(whole | (F.col("pos") == F.col("n") - 1), F.col("duration")).otherwise(F.col("duration") * (before + own) / F.nullif(F.col("total"), F.lit(0.0)))
    return spread.select(key, "pos", "word", start.alias("start_s"), end.alias("end_s"))


def rounded(intervals: DataFrame) -> DataFrame:
    return intervals.withColumns({"start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)})
