"""From written to spoken text: pronunciation markers, then numbers, in six ordered rules.

``{{prn:shown|said}}`` shows its first half and says its second (the first pipe counts); without a pipe it shows and says
the same.  The number rules run on the spoken half, each on the result of the one before: dollars with a multiplier,
dollars, percentages, decimals, integers with commas, integers of five digits or more.

Numbers of 10**15 or more have no scale word; they stay as they are written.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, bind, rewrite

# English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {2: "twenty", 3: "thirty", 4: "forty", 5: "fifty", 6: "sixty", 7: "seventy", 8: "eighty", 9: "ninety"}
SCALES = ["", "thousand", "million", "billion", "trillion"]

#: More digits than this (without leading zeros) have no words.
MOST_DIGITS = 3 * len(SCALES)

_DIGIT = r"\p{Nd}"
_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_GROUPED = rf"{_DIGIT}{{1,3}}(?:,{_DIGIT}{{3}})*"

DOLLARS_SCALED = rf"\$(?:{_GROUPED}){SPACE}*(?:billion|million|trillion|thousand){_NOT_BEFORE}"
DOLLARS = rf"\$(?:{_GROUPED})"
PERCENT = rf"{_DIGIT}+(?:\.{_DIGIT}+)?{SPACE}*%"
DECIMAL = rf"{_NOT_AFTER}{_DIGIT}+\.{_DIGIT}+{_NOT_BEFORE}"
COMMAS = rf"{_NOT_AFTER}{_DIGIT}{{1,3}},{_DIGIT}{{3}}(?:,{_DIGIT}{{3}})*{_NOT_BEFORE}"
LONG_INTEGER = rf"{_NOT_AFTER}{_DIGIT}{{5,}}{_NOT_BEFORE}"


def below_thousand(n: int) -> str:
    """Words of 0 to 999; 0 has none."""
    words = [ONES[n // 100], "hundred"] if n >= 100 else []
    n %= 100
    if n >= 20:
        words.append(TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else ""))
    elif n:
        words.append(ONES[n])
    return " ".join(words)


def _listed(words: list[str]) -> Column:
    """An array of words as one literal: the optimizer folds the split."""
    return F.split(F.lit("|".join(words)), r"\|", -1)


@lru_cache(1)
def _foreign_digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and their ASCII forms in the same order."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *_foreign_digits())


def whole_words(digits: Column) -> Column:
    """Words of a string of ASCII digits; null if it is too long."""
    table = _listed([below_thousand(i) for i in range(1000)])

    def scaled(scale: str):
        return lambda c: F.when(c > 0, F.concat(F.element_at(table, c + 1), F.lit(scale)))

    def spell(n: Column) -> Column:
        parts = []
        for power in range(len(SCALES) - 1, -1, -1):
            chunk = F.pmod(F.call_function("div", n, F.lit(1000**power)), F.lit(1000)).cast("int")
            parts.append(bind(chunk, scaled(f" {SCALES[power]}" if power else "")))
        return F.when(n == 0, F.lit(ONES[0])).when(n > 0, F.concat_ws(" ", *parts))

    return bind(F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= MOST_DIGITS, digits).cast("long"), spell)


def digit_words(digits: Column) -> Column:
    """Each digit by its name."""
    table = _listed(ONES[:10])
    each = F.filter(F.split(digits, ""), lambda d: d != "")
    return F.array_join(F.transform(each, lambda d: F.element_at(table, (d.cast("int") + 1))), " ")


def words_only(number: Column) -> Column:
    """Words of an integer or decimal written with optional commas; null for what is no such number or has no words.

    A decimal loses its sign, as only a positive whole part is spelled; an integer keeps it.
    """

    def of(plain: Column) -> Column:
        whole = F.regexp_extract(plain, r"^[+-]?([0-9]+)$", 1)
        sign = F.when(plain.startswith("-") & ~whole.rlike("^0+$"), F.lit("minus ")).otherwise("")
        before = F.regexp_extract(plain, r"^([+-]?[0-9]+)\.", 1)
        after = F.regexp_replace(F.regexp_extract(plain, r"^[^.]*\.([^.]*)", 1), "[^0-9]", "")
        lead = F.when(before.startswith("-"), F.lit(ONES[0])).otherwise(whole_words(F.regexp_replace(before, r"^\+", "")))
        decimal = F.when(before != "", F.concat(lead, F.lit(" point "), digit_words(after)))
        return F.when(plain.contains("."), decimal).when(whole != "", F.concat(sign, whole_words(whole)))

    return bind(F.regexp_replace(ascii_digits(number), ",", ""), of)


def number_words(number: Column) -> Column:
    """The words of a number; what has none comes back unchanged."""
    return F.coalesce(words_only(number), number)


def _spelled(match: Column) -> Column:
    """Words of the only number in a match; null if it is too long."""

    def of(number: Column) -> Column:
        after = F.regexp_extract(number, r"\.([0-9]+)$", 1)
        words = whole_words(F.substring_index(number, ".", 1))
        return bind(words, lambda w: F.when(after != "", F.concat(w, F.lit(" point "), digit_words(after))).otherwise(w))

    return bind(F.regexp_replace(ascii_digits(F.regexp_extract(match, rf"{_DIGIT}[{_DIGIT},.]*", 0)), ",", ""), of)


def _rule(text: Column, trigger, pattern: str, spoken) -> Column:
    """A rule behind a cheap test of what all its matches hold, and one for a match: a split compiles its pattern again."""
    return bind(text, lambda t: F.when(trigger(t) & t.rlike(pattern), rewrite(t, pattern, lambda m: F.coalesce(spoken(m), m))).otherwise(t))


def say_scaled_dollars(text: Column) -> Column:
    return _rule(text, lambda t: t.contains("$"), DOLLARS_SCALED, lambda m: F.concat(_spelled(m), F.lit(" "), F.regexp_extract(m, "[a-z]+$", 0), F.lit(" dollars")))


def say_dollars(text: Column) -> Column:
    return _rule(text, lambda t: t.contains("$"), DOLLARS, lambda m: F.concat(_spelled(m), F.lit(" dollars")))


def say_percent(text: Column) -> Column:
    return _rule(text, lambda t: t.contains("%"), PERCENT, lambda m: F.concat(_spelled(m), F.lit(" percent")))


def say_decimals(text: Column) -> Column:
    return _rule(text, lambda t: t.rlike(rf"{_DIGIT}\.{_DIGIT}"), DECIMAL, _spelled)


def say_commas(text: Column) -> Column:
    return _rule(text, lambda t: t.rlike(rf"{_DIGIT},{_DIGIT}"), COMMAS, _spelled)


def say_long_integers(text: Column) -> Column:
    return _rule(text, lambda t: t.rlike(rf"{_DIGIT}{{5}}"), LONG_INTEGER, _spelled)


RULES = (say_scaled_dollars, say_dollars, say_percent, say_decimals, say_commas, say_long_integers)


def display_text(text: Column) -> Column:
    """Markers give way to what they show."""
    return F.regexp_replace(text, r"\{\{prn:(?=[^}])([^}|]*)(?:\|[^}]*)?\}\}", "$1")


def marked_speech(text: Column) -> Column:
    """Markers give way to what they say; numbers stay."""
    return F.regexp_replace(text, r"\{\{prn:(?=[^}])(?:[^}|]*\|)?([^}]*)\}\}", "$1")


#: Where a text may be cut for the rules: after a white space between two letters.  No match crosses it, as white space in
#: a match follows a digit, and a word ends there as it does at a text's end.
BETWEEN_WORDS = rf"(?<=\p{{L}}{SPACE})(?=\p{{L}})"


def _all_rules(text: Column) -> Column:
    for rule in RULES:
        text = rule(text)
    return text


def speak_numbers(text: Column) -> Column:
    """All rules in order.  They run on the pieces with digits alone, so that most of a text is searched once and not once
    for each rule."""
    said = lambda p: F.when(p.rlike(_DIGIT), _all_rules(p)).otherwise(p)
    return bind(text, lambda t: F.when(t.rlike(_DIGIT), F.array_join(F.transform(F.split(t, BETWEEN_WORDS, -1), said), "")).otherwise(t))


def spoken_text(text: Column) -> Column:
    """What a voice reads: markers, then numbers."""
    return speak_numbers(marked_speech(text))


def text_pair(text: Column) -> Column:
    return F.struct(display_text(text).alias("display_text"), spoken_text(text).alias("tts_text"))
