"""Read-along segments of a sentence.

A sentence of up to ``HARD_MAX`` characters is one segment and never leaves the JVM.  Longer ones go to an Arrow UDF:
they are cut at sentence ends, commas and a width of ``WIDTH``, and the pieces are then regrouped by rules about short
pieces, ragged edges, clauses and grammar.  Every rule only moves words between neighbours, so the segments joined by
a space are the sentence with its white space collapsed.

The first cut stands in for an outside package whose rules are inferred from documented examples: sentence ends, then
commas and semicolons, then words up to the width.  Colons, abbreviations and words beyond the width are unproven.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import trim

# Lengths in characters.
WIDTH = 45
SHORT = 22
HARD_MAX = 65
MERGED_MAX = HARD_MAX + 10

# Word lists of the regrouping rules.
CONJUNCTIONS = frozenset("and but or nor yet so because although though while whereas when whenever if unless until once since as after before".split())
PREPOSITIONS = frozenset("in on at by for with without from to about through across during despite including according".split())
NEVER_LAST = frozenset("a an the to in on at for with by of and or but nor yet".split())
NEVER_FIRST = frozenset("a an to of".split())
PRONOUNS = frozenset("you me him her us them".split())
AUXILIARIES = frozenset(
    "don't doesn't didn't won't wouldn't can't couldn't shouldn't mightn't mustn't is are was were has have had do does did will would can could should may might must shall".split()
)
DASHES = frozenset("—–")

_ENDS = (".", "!", "?")
_EDGE = "\",;:!?.-—–'"
_EDGE_FIRST = "\",;:!?.-—'"
_EDGE_GRAMMAR = '",;:!?.()-—'

Words = list[str]


def _size(words: Words) -> int:
    return sum(map(len, words)) + max(0, len(words) - 1)


def _ends(words: Words) -> bool:
    return words[-1].endswith(_ENDS)


def _fill(words: Iterable[str], width: int) -> list[Words]:
    """Greedy lines of at most ``width`` characters."""
    out: list[Words] = []
    for word in words:
        if out and _size(out[-1]) + 1 + len(word) <= width:
            out[-1].append(word)
        else:
            out.append([word])
    return out


def first_cut(sentence: str, width: int = WIDTH) -> list[Words]:
    pieces: list[Words] = []
    for part in re.split(r"(?<=[.!?])\s+", sentence):
        for clause in [part] if len(part) <= width else re.split(r"(?<=[,;])\s+", part):
            if words := clause.split():
                pieces += [words] if len(clause) <= width else _fill(words, width)
    return pieces


def _absorb_short(pieces: list[Words]) -> list[Words]:
    """Short pieces join a neighbour; the order of tries depends on how the piece ends."""
    done: list[Words] = []
    todo = pieces[::-1]
    while todo:
        piece = todo.pop()
        if _size(piece) >= SHORT or not (done or todo):
            done.append(piece)
            continue
        if not todo:  # the last piece never stays short
            done[-1] = done[-1] + piece
            continue
        if _ends(piece):
            tries = ["back"]
        elif piece[-1].endswith(",") and done:
            tries = ["ahead"] if _ends(done[-1]) else ["back", "ahead"]
        else:
            tries = ["ahead", "back"]
        for way in tries:
            if way == "back" and done and _size(done[-1] + piece) <= MERGED_MAX:
                done[-1] = done[-1] + piece
                break
            if way == "ahead" and _size(piece + todo[-1]) <= MERGED_MAX:
                done.append(piece + todo.pop())  # the pair is settled
                break
        else:
            done.append(piece)
    return done


def _smooth_edges(pieces: list[Words]) -> list[Words]:
    """Words that may not end a piece move on to the next, unless a sentence has just ended before them; a piece with a
    first word that may not begin one joins the piece before if the limit allows."""
    if len(pieces) < 2:
        return pieces
    moved: list[Words] = []
    carry: Words = []
    for number, piece in enumerate(pieces):
        words, carry = carry + piece, []
        if number < len(pieces) - 1:
            while words and words[-1].strip(_EDGE).lower() in NEVER_LAST and not (len(words) > 1 and words[-2].endswith(_ENDS)):
                carry.insert(0, words.pop())
        if words:
            moved.append(words)
    out: list[Words] = []
    for words in moved:
        if out and words[0].strip(_EDGE_FIRST).lower() in NEVER_FIRST and _size(out[-1] + words) <= HARD_MAX:
            out[-1] = out[-1] + words
        else:
            out.append(words)
    return out


def _rejoin_clauses(pieces: list[Words]) -> list[Words]:
    """A piece that ends in an object pronoun takes in one that begins with an auxiliary."""
    out: list[Words] = []
    settled = False
    for words in pieces:
        joins = out and not settled and out[-1][-1].strip(_EDGE).lower() in PRONOUNS and words[0].strip(_EDGE).lower() in AUXILIARIES
        if joins:
            out[-1] = out[-1] + words
        else:
            out.append(words)
        settled = bool(joins)
    return out


def _by_grammar(words: Words) -> list[Words]:
    """Cuts a long piece before the conjunction, preposition or dash nearest its middle, again and again."""
    if len(words) <= 3:
        return [words]
    total, left = sum(len(w) + 1 for w in words), 0
    middle, best = len(words) // 2, None
    overlong = None
    for at, word in enumerate(words):
        if 0 < at < len(words) - 1:
            plain, right = word.strip(_EDGE_GRAMMAR).lower(), total - left
            both = left > 15 and right > 15
            if (both and (plain in CONJUNCTIONS or word in DASHES)) or (left > 25 and plain in PREPOSITIONS):
                cost = abs(at - middle) - (3 if word in DASHES else 0)
                if best is None or cost < best[0]:
                    best = (cost, at)
        left += len(word) + 1
        if overlong is None and left > 50 and at > 1:
            overlong = at
    if best is None:
        return [words] if overlong is None else [words[:overlong], words[overlong:]]
    halves = words[: best[1]], words[best[1] :]
    return [piece for half in halves for piece in (_by_grammar(half) if _size(half) > HARD_MAX else [half])]


def segments_of(sentence: str) -> list[str]:
    """The segments of one sentence; a blank one is returned as it is."""
    text = sentence.strip()
    if not text:
        return [sentence]
    if len(text) <= HARD_MAX:
        return [text]
    pieces = first_cut(text)
    if len(pieces) < 2:
        return [text]
    pieces = _rejoin_clauses(_smooth_edges(_absorb_short(pieces)))
    pieces = [p for piece in pieces for p in (_by_grammar(piece) if _size(piece) > HARD_MAX else [piece])]
    pieces = _smooth_edges(pieces)
    return [" ".join(p) for p in pieces] if len(pieces) > 1 else [text]


def _long_segments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else segments_of(t))


def phrases(sentence: Column) -> Column:
    """array<string>: only long sentences are sent to Python, the others as nulls."""
    text = trim(sentence)
    cut = F.pandas_udf(_long_segments, "array<string>")
    return F.when(sentence.isNull(), F.lit(None)).when(text == "", F.array(sentence)).when(F.length(text) <= HARD_MAX, F.array(text)).otherwise(cut(F.when(F.length(text) > HARD_MAX, text)))


def _sentences(text: Column) -> Column:
    from lectern.functions.sentences import split_sentences

    return split_sentences(text)


#: Splitters by name; four names mean the same phrases.
SPLITTERS: dict[str, Callable[[Column], Column]] = {"sentence": _sentences} | dict.fromkeys(("auto", "nlp", "rules", "phrasplit"), phrases)


def splitter(name: str = "auto") -> Callable[[Column], Column]:
    if name not in SPLITTERS:
        raise ValueError(f"unknown splitter {name!r}; known: {', '.join(SPLITTERS)}")
    return SPLITTERS[name]


def explode_segments(sentences: DataFrame, text_col: str, name: str = "auto") -> DataFrame:
    """Adds (seg_pos, segment): one row for each segment."""
    return sentences.select("*", F.posexplode(splitter(name)(F.col(text_col))).alias("seg_pos", "segment"))
