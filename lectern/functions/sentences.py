"""Sentences of a text: missing spaces put in, then cut after . ! ? and closing quotes.

Both steps are one regular expression each.  The leading look-behind for an ender or quote is a cheap test that keeps
the nested guards from running at every character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import trim

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc dept est govt inc corp ltd jan feb mar apr jun jul aug sep oct nov dec ave blvd rd ln".split()

#: Not an ender: one after an abbreviation or a single letter.
GUARD = rf"(?<!(?i:(?<!\p{{L}})(?:{'|'.join(ABBREVIATIONS)}|\p{{L}})))"
_ENDER = rf"{GUARD}[.!?]"
MISSING_SPACE = rf'(?U)(?<=[.!?"])(?:(?<={_ENDER})(?=\p{{IsUppercase}})|(?<={_ENDER}")(?=\S))'
#: a.m. and p.m. do end a sentence before one white space and an upper-case letter.
BOUNDARY = rf'(?U)(?<=[.!?"])(?=\s+[\p{{IsUppercase}}"])(?<=(?:{_ENDER}|(?i:[ap]\.m)\.(?=\s\p{{IsUppercase}}))"{{0,4}})\s+'


def with_missing_spaces(text: Column) -> Column:
    return F.regexp_replace(text, MISSING_SPACE, " ")


def split_sentences(text: Column) -> Column:
    """array<string>, in order; a blank text is one sentence, as it is."""
    parts = F.filter(F.transform(F.split(with_missing_spaces(trim(text)), BOUNDARY, -1), trim), lambda s: s != "")
    return F.when(trim(text) == "", F.array(text)).otherwise(parts)
