"""Unicode-aware trimming and line handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace sees it: Unicode white space and the four separators U+001C to U+001F.
SPACE = r"(?U:[\s\x1c-\x1f])"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def lines(text: Column) -> Column:
    """The lines of a text, cut at CRLF, CR and LF only."""
    return F.split(text, r"\r\n|\r|\n", -1)


def bind(value: Column, function) -> Column:
    """function(value) with value computed once, however often the function uses it: a lambda's variable stands for
    it, so chained rules keep a plan of linear size."""
    return F.element_at(F.transform(F.array(value), function), 1)


def rewrite(text: Column, pattern: str, replacement) -> Column:
    """Replaces every match of a pattern by ``replacement(match)``: what lies between the matches and the matches
    themselves are zipped together again, all inside the JVM."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, matches, lambda a, m: F.concat(a, F.coalesce(replacement(m), F.lit("")))), "")
