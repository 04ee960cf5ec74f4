"""Personal data with offsets into the original text, also behind disguises.

Base kinds (code-point spans, leftmost and non-overlapping per kind; a match that fails its test is dropped, no retry):
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip, four numbers with dots, each at most 255; card,
12 to 19 digits that pass Luhn's test; phone, a plus sign and 9 to 15 digits.

Deobfuscation: transducers rewrite the text piece by piece and carry each output character's source interval along:
(1) look-alike letters, full-width and enclosed forms, the decimal digits of any script and dashes to ASCII, invisible
characters to nothing; (2) ``[at]``, ``(dot)`` and the like to ``@`` and ``.``; spaced ``at`` ... ``dot`` where they make
an address; ``dot`` between four numbers, in digits or spelled; (3) runs of seven or more spelled digits to digits, a
leading ``plus`` to ``+``.  Detectors run on the result; spans that are new are mapped back and added unless a span of
their kind holds them.  Each transducer runs only where a cheap test finds its trigger.

A spelled address may have any number of dots and labels of any length.  Its last label has two or three letters or is
in ``_TOP``, is none of the prepositions in ``_GOES_ON``, and its host doesn't begin with a word of ``_POINTING`` ("look at
the dot in the middle").

Null text is empty; an empty table gives an empty result.  Repeated rows, null ids and other columns, whatever their
names, change nothing.  Time grows with the text's length and its number of matches, never with their product.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import id_and_text, map_texts

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "<EMAIL>", "ip": "<IP_ADDRESS>", "card": "<CARD_NUMBER>", "phone": "<PHONE_NUMBER>"}

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterable[Span]:
    """From each @ outward: to the left over local characters up to the last match, to the right by the domain rule."""
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            at = last = m.end()
        else:
            last = max(last, start)  # what lies before can't belong to a later @
            at += 1


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def detect(text: str) -> list[Span]:
    """(start, end, kind), by start and then by kind as listed."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Mapped:
    """A text with, for each of its characters, the interval of source characters it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = starts if starts is not None else list(range(len(text)))
        self.ends = ends if ends is not None else list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replaces the intervals (start, end, by), sorted and disjoint; a replacement stands for all it replaces."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, by in edits:
            parts += [self.text[at:a], by]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if by and b > a:
                starts += [self.starts[a]] * len(by)
                ends += [self.ends[b - 1]] * len(by)
            at = b
        parts.append(self.text[at:])
        return Mapped("".join(parts), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Both bounds grow along the text."""
        return self.starts[start], self.ends[end - 1]


#: Letters that look like ASCII ones: Cyrillic, then Greek.
_LOOK = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝкмтνοαρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABESIJKMHOPCTYXaesijopcyxdhqwkmtvoaptuikABEZHIKMNOPTYX", strict=True))
_DASHES = dict.fromkeys("‐‑‒–—―−﹣－", "-")
_INVISIBLE = dict.fromkeys("­​‌‍‎‏⁠﻿", "")
_SPACES = dict.fromkeys("              　", " ")
_TABLE = _LOOK | _DASHES | _INVISIBLE | _SPACES
#: Decimal digits of scripts other than ASCII.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd")
#: One pass over the text tells whether any character may change: the tables' own, foreign digits, wide and enclosed forms.
_ODD = re.compile("[" + re.escape("".join(_TABLE) + _DIGITS) + "\u3002\uff61\uff01-\uff5e\u24b6-\u24e9\U0001d400-\U0001d7ff]")


def _may_change(text: str) -> bool:
    """Whether look_alikes may find anything.  Latin-1 texts, most of all, hold two characters that it rewrites."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD.search(text) is not None
    return "\xa0" in text or "\xad" in text


def _plain(c: str) -> str:
    if (known := _TABLE.get(c)) is not None:
        return known
    if c in "\u3002\uff61":
        return "."
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def look_alikes(text: Mapped) -> Mapped:
    edits = [(m.start(), m.end(), by) for m in _ODD.finditer(text.text) if (by := _plain(m[0])) != m[0]] if _may_change(text.text) else []
    return text.rewrite(edits) if edits else text


_AT = r"(?:at|arroba|arobase|chez|ät|@)"
_DOT = r"(?:dot|punkt|point|punto|\.)"
_OPEN, _CLOSE = r"[ ]{0,3}[\[({<][ ]{0,3}", r"[ ]{0,3}[\])}>][ ]{0,3}"
_FENCED = re.compile(rf"{_OPEN}(?:(?P<at>{_AT})|(?P<dot>{_DOT})){_CLOSE}", re.IGNORECASE)
_SAID_DOT = r" {1,3}(?:dot|punkt|point|punto) {1,3}"
_SPOKEN_AT = re.compile(r" {1,3}(at|arroba|arobase) {1,3}|@", re.IGNORECASE)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_SAID_DOT})[A-Za-z0-9-]+)+", re.IGNORECASE)
#: The part before the at, read backwards.
_BEFORE = re.compile(r"[A-Za-z0-9_%+-]+(?:(?:\.| {1,3}(?:tod|tknup|tniop|otnup) {1,3})[A-Za-z0-9_%+-]+)*(?![A-Za-z0-9._%+@-])", re.IGNORECASE)
_SPOKEN_DOT = re.compile(r" +(?:dot|punkt|point|punto) +", re.IGNORECASE)
#: Which spelled dots go with which spelled at.
_SAID_WITH = {"at": {"dot", "punkt"}, "arobase": {"dot", "point"}, "arroba": {"dot", "punto"}, "@": {"dot", "punkt", "point", "punto"}}
#: Last labels of more than three letters that count with spelled dots.
_TOP = frozenset("aero arpa asia blog club cloud coop design email example group help host info invalid jobs life link live local localhost media mobi museum name network news online page post shop site social space store studio team tech test today travel video website wiki work world zone".split())
#: Last labels with which a sentence goes on after the word dot.
_GOES_ON = frozenset("in at on of to as is by or if so we he up an and the for but was are can has had who she you its his her our one two".split())
#: Host labels after which dot is a plain word.
_POINTING = frozenset("the a an this that each every one any some which no his her its my your our their red blue black white green small big tiny last first".split())
_DOT_WORDS = (" dot ", " punkt ", " point ", " punto ")


def _spoken_addresses(text: str) -> list[tuple[int, int, str]]:
    """From each at outward, by spelled dots; the edits that turn an address into an ordinary one."""
    edits: list[tuple[int, int, str]] = []
    back, free = text[::-1], 0
    for m in _SPOKEN_AT.finditer(text):
        if not (host := _HOST.match(text, m.end())) or not (before := _BEFORE.match(back, len(text) - m.start(), len(text) - free)):
            continue
        start, at = len(text) - before.end(), (m[1] or "@").lower()
        dots = [*_SPOKEN_DOT.finditer(text, start, m.start()), *_SPOKEN_DOT.finditer(text, *host.span())]
        labels = re.split(r"[ .]+", host[0].lower())
        top = labels[-1]
        fits = top.isalpha() and (2 <= len(top) <= 3 or top in _TOP) and top not in _GOES_ON and labels[0] not in _POINTING
        if dots and fits and {d[0].strip().lower() for d in dots} <= _SAID_WITH[at]:
            edits += [(*d.span(), ".") for d in dots]
            edits.append((*m.span(), "@"))
            free = host.end()
    return sorted(edits)


def at_and_dot(text: Mapped) -> Mapped:
    if any(c in text.text for c in "[({<"):
        edits = [(*m.span(), "@" if m["at"] else ".") for m in _FENCED.finditer(text.text)]
        text = text.rewrite(edits) if edits else text
    lower = text.text.lower()
    if any(w in lower for w in _DOT_WORDS):  # a spaced "at" counts only with a spelled dot, as words of a sentence do not
        if edits := _spoken_addresses(text.text):
            text = text.rewrite(edits)
        edits = []
        for m in _SPOKEN_IP.finditer(text.text):
            numbers = [*_NUMBER.finditer(text.text, *m.span())]
            for a, b in pairwise([*numbers, None]):
                edits.append((*a.span(), "".join(_NAMES.get(d.lower(), d) for d in _ONE.findall(a[0]))))
                if b:
                    edits.append((a.end(), b.start(), "."))
        text = text.rewrite(edits) if edits else text
    return text


#: Digit names of English, German, French and Spanish, 0 to 9.
_NAMES = {
    name: str(digit)
    for names in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, name in enumerate(names.split())
} | {"oh": "0", "zwo": "2"}
_LEAST_SPELLED = 7
_WORD = "|".join(sorted(_NAMES, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?P<plus>plus|\+)[ -]{{0,3}})?(?:(?:{_WORD}|[0-9])(?:[ .,/-]{{1,3}}|(?<=[0-9]))){{{_LEAST_SPELLED - 1},}}(?:{_WORD}|[0-9])(?![\w])", re.IGNORECASE)
_ONE = re.compile(rf"plus|{_WORD}|[0-9+]", re.IGNORECASE)
#: A number of an address in digits or spelled digit by digit, and four of them with spelled dots.
_PART = rf"(?:[0-9]+|(?:{_WORD})(?:[ -](?:{_WORD})){{0,2}})"
_NUMBER = re.compile(_PART, re.IGNORECASE)
_SPOKEN_IP = re.compile(rf"(?<![\w.]){_PART}(?:{_SAID_DOT}{_PART}){{3}}(?!\w)", re.IGNORECASE)


def _named(text: str) -> bool:
    """Whether any word is a digit's name."""
    text = text.lower()
    for gap in ".,/-":
        text = text.replace(gap, " ")
    return not _NAMES.keys().isdisjoint(text.split())


def spelled_digits(text: Mapped) -> Mapped:
    if not _named(text.text):
        return text
    edits = []
    for m in _SPELLED.finditer(text.text):
        if sum(c.isdigit() for c in m[0]) > len(m[0]) // 3:
            continue  # digits as such: the base detectors see them
        digits = [(*part.span(), "+" if part[0].lower() in ("plus", "+") else _NAMES.get(part[0].lower(), part[0])) for part in _ONE.finditer(text.text, *m.span())]
        gaps = [(a[1], b[0], "" if a[2] == "+" else " ") for a, b in pairwise(digits) if b[0] > a[1]]
        edits += sorted(digits + gaps)
    return text.rewrite(edits) if edits else text


def deobfuscate(text: str) -> Mapped | None:
    """The normalised text with its map, or None if nothing changed."""
    lower = text.lower()
    spoken = any(w in lower for w in _DOT_WORDS)
    fenced = any(c in text for c in "[({<") and _FENCED.search(text) is not None
    odd = _may_change(text)
    if not (spoken or fenced or odd or (_named(text) and _SPELLED.search(text))):
        return None
    whole = Mapped(text)
    out = spelled_digits(at_and_dot(look_alikes(whole)))
    return None if out is whole else out


def _spoken_phones(out: Mapped) -> list[Span]:
    """Runs of 9 to 15 spelled digits are phone numbers even without a plus sign."""
    found = []
    for m in re.finditer(r"(?<![0-9+])(?<![0-9] )[0-9](?: [0-9]){8,14}(?! ?[0-9])", out.text):
        a, b = out.source(*m.span())
        if b - a > 2 * (m.end() - m.start()):  # words stood there
            found.append((*m.span(), "phone"))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both sorted."""
    base = detect(text)
    out = deobfuscate(text)
    if out is None:
        return base, base
    known = {kind: [s for s in base if s[2] == kind] for kind in KINDS}
    reach = dict.fromkeys(KINDS, -1)
    added: list[Span] = []
    for a, b, kind in sorted(((*out.source(start, end), kind) for start, end, kind in detect(out.text) + _spoken_phones(out)), key=lambda s: (s[0], -s[1])):
        at = bisect_right(known[kind], a, key=lambda s: s[0]) - 1  # those of a kind don't overlap
        if b > reach[kind] and not (at >= 0 and b <= known[kind][at][1]):
            added.append((a, b, kind))
            reach[kind] = b
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str) -> str:
    """Every span of personal data gives way to its kind's mask; overlapping spans to that of the first."""
    parts, at = [], 0
    for a, b, kind in all_spans(text)[1]:
        if a >= at:
            parts += [text[at:a], MASKS[kind]]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone of the base, n_added, base_sha256, spans): a row for each row of df."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(t) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        added = pa.array([len(spans) - len(base) for base, spans in found], pa.int64())
        hashes = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        texts = pa.array([joined(spans) for _, spans in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, added, hashes, texts], names=["doc_id", *[f"n_{k}" for k in KINDS], "n_added", "base_sha256", "spans"])

    return map_texts(id_and_text(df, id_col, text_col), of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def redact_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its texts redacted; a null text stays null.  All other columns, whatever their names, stay as they are."""
    at = df.columns.index(text_col)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([t if t is None else redact(t) for t in batch.column(at).to_pylist()], pa.string())
        return batch.set_column(at, text_col, texts)

    return map_texts(df, of, df.schema)
