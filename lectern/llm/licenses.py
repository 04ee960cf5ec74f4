"""License scan: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

Text is lower-cased (A-Z) and read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space, so a rule is a
regular expression over words and neither line breaks nor punctuation matter.

Base: places where the words of a phrase in ``BASE`` stand consecutively.  ``SIGNATURES`` holds the rules: clauses of
license texts, addresses, grants, titles and names, with one label for each license however it is named.  An SPDX tag is
read as an expression: every known identifier after it, joined by and, or, with, counts.  A rule is tried only if its
keyword, the longest stretch of plain letters in it, is in the text; one automaton finds all keywords.  Matches are
ranked by priority, then length, then start; one that lies inside a match ranked before it is suppressed.  The score is
1 - prod(1 - confidence) over the kept matches and base places.

A null or empty text has no words, no labels and score 0; an empty table gives an empty result.  Rows are independent:
repeated rows, null ids and other columns, whatever their names, change nothing.  Of two rules that match the same words
with the same priority the earlier one counts.  Rules hold no unbounded gaps and overlaps are settled by a sweep, so time
grows with a text's length and its matches, never with their product.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import id_and_text, map_texts

#: Phrase and label of the base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_CONFIDENCE = 0.5

#: Confidence of each priority: 6 clause of a license text, 5 address or tag, 4 grant, 3 title, 2 name, 1 hint.
CONFIDENCE = {6: 0.95, 5: 0.99, 4: 0.95, 3: 0.8, 2: 0.6, 1: 0.4}
#: Short forms in the signatures.
FORMS = {
    "UNDER": r"(?:licen[cs]ed|released|distributed|published|available|provided|redistribute it|redistribute it and or modify it) (?:to you )?(?:under|with|by)(?: the)?(?: terms of)?(?: the)?(?: gnu)?",
    "VER": r"(?:version |v)?",
    "LIC": r"licen[cs]e",
}

#: Label, then its signatures: the words of its SPDX identifier (id), or a priority and a pattern over words.
SIGNATURES = r"""
mit
  id mit
  6 permission is hereby granted free of charge to any person obtaining a copy
  6 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
  5 opensource org licen[cs]es? mit
  5 licen[cs]e badge mit
  4 UNDER mit(?: LIC)?
  4 made available under mit
  3 (?:the|a|an) mit LIC
  3 mit x11 LIC
  2 mit LIC
  2 mit style LIC
  2 expat LIC
mit-0
  id mit 0
  4 UNDER mit 0
  3 mit no attribution(?: LIC)?
  2 mit 0 LIC
x11
  id x11
  6 except as contained in this notice the name of [a-z0-9 ]{1,60} shall not be used in advertising
  2 x11 LIC
isc
  id isc
  6 permission to use copy modify and or distribute this software for any purpose with or without fee
  6 permission to use copy modify and distribute this software for any purpose with or without fee
  5 opensource org licen[cs]es? isc
  4 UNDER isc(?: LIC)?
  2 isc LIC
bsd-4-clause
  id bsd 4 clause
  6 all advertising materials mentioning features or use of this software must display
  3 (?:4|four) clause bsd(?: LIC)?
  3 original bsd LIC
  2 bsd 4 clause(?: LIC)?
bsd-3-clause
  id bsd 3 clause
  6 neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse
  5 opensource org licen[cs]es? bsd 3 clause
  3 (?:3|three) clause bsd(?: LIC)?
  3 (?:new|modified|revised) bsd LIC
  2 bsd 3 clause(?: LIC)?
  2 bsd 3(?: clause)? LIC
bsd-2-clause
  id bsd 2 clause
  5 opensource org licen[cs]es? bsd 2 clause
  3 (?:2|two) clause bsd(?: LIC)?
  3 (?:simplified|freebsd) bsd LIC
  2 bsd 2 clause(?: LIC)?
  2 freebsd LIC
0bsd
  id 0bsd
  3 zero clause bsd(?: LIC)?
  2 0bsd(?: LIC)?
bsd
  6 redistribution and use in source and binary forms with or without modification are permitted
  6 redistributions of source code must retain the above copyright notice this list of conditions
  6 redistributions in binary form must reproduce the above copyright notice
  4 UNDER bsd(?: LIC)?
  3 (?:the|a) bsd LIC
  2 bsd(?: style)? LIC
apache-2.0
  id apache 2 0
  6 licen[cs]ed under the apache LIC VER2 0 the LIC you may not use this file
  6 you may not use this file except in compliance with the LIC
  6 unless required by applicable law or agreed to in writing software distributed under the LIC
  5 apache org licen[cs]es LIC 2 0
  5 opensource org licen[cs]es? apache 2 0
  4 UNDER apache(?: LIC)? VER2(?: 0)?
  3 apache(?: software)? LIC VER2(?: 0)?
  2 apache 2(?: 0)?(?: LIC)?
  2 asl VER2 0
apache-1.1
  id apache 1 1
  3 apache(?: software)? LIC VER1 1
  2 apache 1 1
apache-1.0
  id apache 1 0
  3 apache(?: software)? LIC VER1 0
apache
  4 UNDER apache(?: LIC)?
  2 apache(?: software)? LIC
agpl-3.0
  id agpl 3 0(?: only| or later)?
  5 gnu org licen[cs]es agpl 3 0
  4 UNDER agpl ?VER3(?: 0)?
  3 (?:gnu )?affero general public LIC VER3(?: 0)?
  2 (?:the |gnu )?agpl ?v?3(?: 0)?(?: only| or later)?
agpl-1.0
  id agpl 1 0(?: only| or later)?
  3 (?:gnu )?affero general public LIC VER1(?: 0)?
agpl
  id agpl
  4 UNDER agpl
  2 gnu agpl
  2 (?:gnu )?affero general public LIC
lgpl-3.0
  id lgpl 3 0(?: only| or later)?
  5 gnu org licen[cs]es lgpl 3 0
  4 UNDER lgpl ?VER3(?: 0)?
  3 (?:gnu )?lesser general public LIC VER3(?: 0)?
  2 (?:the |gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.1
  id lgpl 2 1(?: only| or later)?
  5 gnu org licen[cs]es lgpl 2 1
  5 gnu org licen[cs]es old licen[cs]es lgpl 2 1
  4 UNDER lgpl ?VER2 1
  3 (?:gnu )?lesser general public LIC as published by the free software foundation either VER2 1
  3 (?:gnu )?lesser general public LIC VER2 1
  2 (?:the |gnu )?lgpl ?v?2 1(?: only| or later)?
lgpl-2.0
  id lgpl 2 0(?: only| or later)?
  3 (?:gnu )?library general public LIC VER2(?: 0)?
  2 (?:gnu )?library general public LIC
  2 (?:the |gnu )?lgpl ?v?2 0(?: only| or later)?
lgpl
  id lgpl
  4 UNDER lgpl
  2 gnu lgpl
  2 the lgpl
  2 (?:gnu )?lesser general public LIC
gpl-3.0
  id gpl 3 0(?: only| or later)?
  6 general public LIC as published by the free software foundation either VER3 of the LIC or
  5 gnu org licen[cs]es gpl 3 0
  5 opensource org licen[cs]es? gpl 3 0
  4 UNDER gpl ?VER3(?: 0)?
  3 (?:gnu )?general public LIC VER3(?: 0)?
  2 (?:the |gnu )?gpl ?v?3(?: 0)?(?: only| or later)?
  2 gnu gpl VER3(?: 0)?
gpl-2.0
  id gpl 2 0(?: only| or later)?
  6 general public LIC as published by the free software foundation either VER2 of the LIC or
  5 gnu org licen[cs]es gpl 2 0
  5 gnu org licen[cs]es old licen[cs]es gpl 2 0
  5 opensource org licen[cs]es? gpl 2 0
  4 UNDER gpl ?VER2(?: 0)?
  3 (?:gnu )?general public LIC VER2(?: 0)?
  2 (?:the |gnu )?gpl ?v?2(?: 0)?(?: only| or later)?
  2 gnu gpl VER2(?: 0)?
gpl-1.0
  id gpl 1 0(?: only| or later)?
  3 (?:gnu )?general public LIC VER1(?: 0)?
gpl
  id gpl
  6 this (?:program|library) is free software you can redistribute it and or modify it
  6 is free software you can redistribute it and or modify it under the terms of the gnu
  5 gnu org licen[cs]es gpl
  4 UNDER gpl
  2 gnu general public LIC
  2 gnu gpl
  2 the gpl
  2 gpl LIC
  2 gpl compatible
gpl-exception
  3 with (?:the )?classpath exception
  3 classpath exception 2 0
  3 gcc runtime library exception
  3 linking exception
gfdl-1.3
  id gfdl 1 3(?: only| or later)?
  5 gnu org licen[cs]es fdl 1 3
  3 (?:gnu )?free documentation LIC VER1 3
gfdl-1.2
  id gfdl 1 2(?: only| or later)?
  3 (?:gnu )?free documentation LIC VER1 2
gfdl
  id gfdl
  6 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
  2 gnu fdl
  2 (?:gnu )?free documentation LIC
mpl-2.0
  id mpl 2 0
  6 this source code form is subject to the terms of the mozilla public LIC
  5 mozilla org mpl 2 0
  4 UNDER mpl VER2(?: 0)?
  3 mozilla public LIC VER2(?: 0)?
  2 mpl ?v?2(?: 0)?
mpl-1.1
  id mpl 1 1
  5 mozilla org mpl mpl 1 1
  3 mozilla public LIC VER1 1
  2 mpl VER1 1
mpl
  6 the contents of this file are subject to the mozilla public LIC
  5 mozilla org mpl
  2 mozilla public LIC
epl-2.0
  id epl 2 0
  5 eclipse org legal epl 2 0
  5 eclipse org legal epl v20
  3 eclipse public LIC VER2(?: 0)?
  2 epl VER2 0
epl-1.0
  id epl 1 0
  5 eclipse org legal epl v10
  3 eclipse public LIC VER1(?: 0)?
  2 epl VER1 0
epl
  2 eclipse public LIC
edl-1.0
  5 eclipse org org documents edl v10
  2 eclipse distribution LIC
eupl-1.2
  id eupl 1 2
  3 european union public LIC VER1 2
  2 eupl VER1 2
eupl
  id eupl 1 1
  2 european union public LIC
cddl-1.1
  id cddl 1 1
  3 common development and distribution LIC VER1 1
cddl-1.0
  id cddl 1 0
  3 common development and distribution LIC VER1 0
cddl
  6 the contents of this file are subject to the terms of the common development and distribution LIC
  2 common development and distribution LIC
  2 cddl LIC
cpl-1.0
  id cpl 1 0
  2 common public LIC
cpal-1.0
  id cpal 1 0
  2 common public attribution LIC
ipl-1.0
  id ipl 1 0
  2 ibm public LIC
artistic-2.0
  id artistic 2 0
  3 artistic LIC VER2(?: 0)?
artistic-1.0
  id artistic 1 0
  2 artistic LIC
perl
  3 under the same terms as perl(?: itself)?
  2 same terms as perl(?: itself)?
bsl-1.0
  id bsl 1 0
  6 permission is hereby granted free of charge to any person or organization obtaining a copy of the software
  5 boost org LIC 1 0
  3 distributed under the boost software LIC
  2 boost software LIC
busl-1.1
  id busl 1 1
  3 business source LIC VER1 1
  2 business source LIC
elastic-2.0
  id elastic 2 0
  3 elastic LIC VER2(?: 0)?
  2 elastic LIC
sspl-1.0
  id sspl 1 0
  3 server side public LIC VER1
  2 server side public LIC
zlib
  id zlib
  6 this software is provided as is without any express or implied warranty in no event will the authors be held liable
  6 altered source versions must be plainly marked as such
  3 (?:the )?zlib libpng LIC
  2 zlib LIC
libpng
  id libpng(?: 2 0)?
  2 libpng LIC
unlicense
  id unlicense
  6 this is free and unencumbered software released into the public domain
  5 unlicen[cs]e org
  2 the unlicen[cs]e
wtfpl
  id wtfpl
  3 do what the f\w* you want to public LIC
  2 wtfpl
python-2.0
  id (?:python|psf) 2 0
  3 python software foundation LIC
  2 psf LIC
php-3.01
  id php 3 0(?:1)?
  3 php LIC VER3 0(?:1)?
  2 php LIC
ruby
  id ruby
  2 ruby LIC
postgresql
  id postgresql
  2 postgresql LIC
openssl
  id openssl
  6 this product includes software developed by the openssl project
  2 openssl LIC
curl
  id curl
  2 curl LIC
ijg
  id ijg
  6 this software is based in part on the work of the independent jpeg group
ncsa
  id ncsa
  3 university of illinois ncsa open source LIC
  2 ncsa(?: open source)? LIC
w3c
  id w3c
  5 w3 org consortium legal
  3 w3c software notice and LIC
  2 w3c LIC
cecill-2.1
  id cecill (?:1|2) (?:0|1)
  3 cecill VER2 1
  2 cecill(?: free software)? LIC
mulan-2.0
  id mulanpsl (?:1|2) 0
  2 mulan permissive software LIC
vim
  id vim
  2 vim LIC
beerware
  id beerware
  6 if we meet some day and you think this stuff is worth it you can buy me a beer
  2 beer ?ware LIC
openrail
  3 creativeml openrail m
  2 openrail m? ?LIC
llama
  3 llama [234] community LIC
osl-3.0
  id osl (?:1|2|3) (?:0|1)
  2 open software LIC
nposl-3.0
  id nposl 3 0
  3 non profit open software LIC
afl-3.0
  id afl (?:1|2|3) (?:0|1|2)
  2 academic free LIC
ecl-2.0
  id ecl (?:1|2) 0
  2 educational community LIC
ms-pl
  id ms pl
  2 microsoft public LIC
ms-rl
  id ms rl
  2 microsoft reciprocal LIC
ofl-1.1
  id ofl 1 (?:0|1)
  5 scripts sil org ofl
  3 sil open font LIC
  2 open font LIC
odbl-1.0
  id odbl 1 0
  5 opendatacommons org licen[cs]es odbl
  3 open data commons open database LIC
  2 open database LIC
odc-by-1.0
  id odc by 1 0
  5 opendatacommons org licen[cs]es by
  3 open data commons attribution LIC
pddl-1.0
  id pddl 1 0
  5 opendatacommons org licen[cs]es pddl
  2 public domain dedication and LIC
ogl-uk
  id ogl uk (?:1|2|3) 0
  5 nationalarchives gov uk doc open government LIC
  3 contains public sector information licen[cs]ed under the open government LIC
  2 open government LIC
cc0-1.0
  id cc0 1 0
  5 creativecommons org publicdomain zero
  4 UNDER cc0
  3 cc0 1 0(?: universal)?
  2 creative commons zero
  2 cc0
cc-pdm
  5 creativecommons org publicdomain mark
cc-by-nc-nd
  id cc by nc nd [1-4] 0
  5 creativecommons org licen[cs]es by nc nd
  3 creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?
  3 cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa
  id cc by nc sa [1-4] 0
  5 creativecommons org licen[cs]es by nc sa
  3 creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
  3 cc by nc sa(?: [1-4] 0)?
cc-by-nc
  id cc by nc [1-4] 0
  5 creativecommons org licen[cs]es by nc
  3 creative commons attribution non ?commercial(?: [1-4] 0)?
  3 cc by nc(?: [1-4] 0)?
cc-by-nd
  id cc by nd [1-4] 0
  5 creativecommons org licen[cs]es by nd
  3 creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?
  3 cc by nd(?: [1-4] 0)?
cc-by-sa
  id cc by sa [1-4] 0
  5 creativecommons org licen[cs]es by sa
  3 creative commons attribution share ?alike(?: [1-4] 0)?
  3 cc by sa(?: [1-4] 0)?
cc-by
  id cc by [1-4] 0
  5 creativecommons org licen[cs]es by
  4 UNDER cc by
  3 creative commons attribution(?: [1-4] 0)?
  2 cc by(?: [1-4] 0)?
cc
  2 creative commons LIC
  1 some rights reserved
public-domain
  3 (?:placed|released|dedicated) (?:in |to |into )+the public domain
  2 (?:is|are|in) (?:in )?the public domain
  2 public domain work
no-warranty
  1 without (?:any )?warranty of any kind
  1 without warranty
  1 without warranties
  1 no warranty
  1 provided as is
proprietary
  4 this software is the confidential and proprietary information of
  3 proprietary and confidential
  3 confidential and proprietary
  3 unauthori[sz]ed (?:copying|reproduction|use|distribution)[a-z ]{0,40} prohibited
  3 may not be (?:reproduced|copied|distributed|published|broadcast|rewritten)[a-z ]{0,60} without (?:the )?(?:prior |express )*(?:written )?permission
  3 no part of this (?:publication|book|document|work) may be reproduced
  2 for internal use only
  2 do not distribute
  2 not for redistribution
eula
  3 end user LIC agreement
  2 terms of service
  1 terms of use
permission
  2 (?:reprinted|used|reproduced) (?:with|by) (?:kind )?permission
  2 with the permission of the publisher
dual
  3 dual licen[cs]ed
  2 at your option
copyright
  3 copyright(?: c)? (?:19|20)\d\d
  3 copr(?: c)? (?:19|20)\d\d
  2 c (?:19|20)\d\d all rights
  1 copyright notice
  1 copyright holders?
  1 is copyrighted
reserved
  3 all rights (?:are )?reserved
  3 tous droits r(?:e|\xc3\xa9)serv(?:e|\xc3\xa9)s
  3 alle rechte vorbehalten
  3 todos los derechos reservados
  3 tutti i diritti riservati
  3 todos os direitos reservados
  3 alle rechten voorbehouden
  3 wszelkie prawa zastrze
open-source
  1 open source LIC
  1 osi approved
non-commercial
  2 for non commercial use only
  2 free for personal use
  2 for academic use only
  2 for research purposes only
attribution
  1 attribution required
  1 please credit
"""

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Rule(NamedTuple):
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    confidence: float


def keyword_of(pattern: str) -> str:
    """The longest stretch of plain characters that every match holds: outside groups and classes, not optional."""
    found, run, depth, at = [""], "", 0, 0
    while at < len(pattern):
        c, after = pattern[at], pattern[at + 1 : at + 2]
        if c == "\\":
            at += 1
        elif c == "[":
            at = pattern.index("]", at)
        depth += (c == "(") - (c == ")")
        plain = depth == 0 and (c.isalnum() or c == " ") and after not in ("?", "*", "{")
        run = run + c if plain else ""
        found.append(run)
        at += 1
    return max(found, key=len)


def _written() -> list[tuple[str, str, str]]:
    """(label, what stands before the pattern, pattern) of every signature."""
    out, label = [], ""
    for line in SIGNATURES.strip().split("\n"):
        if line.startswith("  "):
            kind, pattern = line.strip().split(" ", 1)
            for short, form in FORMS.items():
                pattern = pattern.replace(short, form)
            out.append((label, kind, pattern))
        else:
            label = line.strip()
    return out


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules but the tags, the highest priority first."""
    made = [
        Rule(label, keyword_of(pattern).encode(), re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )"), int(kind), CONFIDENCE[int(kind)])
        for label, kind, pattern in _written()
        if kind != "id"
    ]
    return tuple(sorted(made, key=lambda r: -r.priority))


@lru_cache(1)
def _keywords() -> ahocorasick.Automaton:
    """Keyword -> the numbers of its rules."""
    numbers: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        numbers.setdefault(rule.keyword, []).append(i)
    found = ahocorasick.Automaton()
    for keyword, at in numbers.items():
        found.add_word(keyword.decode("latin-1"), at)
    found.make_automaton()
    return found


_TAG = re.compile(rb"(?<= )spdx licen[cs]e identifier (?=.)")
_JOINT = re.compile(rb"(?:and|or|with) ")


@lru_cache(1)
def _identifiers() -> tuple[re.Pattern[bytes], tuple[Rule, ...]]:
    """One pattern with a group for each SPDX identifier, the longer first, and their rules."""
    ids = sorted(((pattern, label) for label, kind, pattern in _written() if kind == "id"), key=lambda x: -len(x[0]))
    whole = re.compile("|".join(f"({pattern})(?= )" for pattern, _ in ids).encode())
    return whole, tuple(Rule(label, b"spdx", whole, 5, CONFIDENCE[5]) for _, label in ids)


def tags(flat: bytes) -> list[tuple[int, int, Rule]]:
    """The identifiers of every SPDX expression; the first one's match begins at the tag."""
    whole, named = _identifiers()
    found = []
    for tag in _TAG.finditer(flat):
        start, at = tag.start(), tag.end()
        while m := whole.match(flat, at):
            found.append((start, m.end(), named[m.lastindex - 1]))
            if not (joint := _JOINT.match(flat, m.end() + 1)):
                break
            start = at = joint.end()
    return found


def normalise(text: str | None) -> tuple[bytes, int]:
    """The words, each with a space on both sides, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def base_places(flat: bytes) -> list[tuple[int, str]]:
    """(offset of the space before, label) of every place of every base phrase."""
    found = []
    for phrase, label in BASE:
        needle, at = f" {phrase} ".encode(), -1
        while (at := flat.find(needle, at + 1)) >= 0:
            found.append((at, label))
    return sorted(found)


def detections(flat: bytes) -> list[tuple[int, int, Rule]]:
    """Kept matches (start, end in flat, rule), by place.

    A match inside another that is suppressed lies inside the one that suppresses it, so it is enough to look at all
    matches ranked before it: for each priority one sweep over the matches of that priority and above.
    """
    hit = {i for _, numbers in _keywords().iter(flat.decode("latin-1")) for i in numbers}
    found = [(*m.span(), rules()[i]) for i in sorted(hit) for m in rules()[i].pattern.finditer(flat)]
    if b" spdx " in flat:
        found = tags(flat) + found
    order = sorted(range(len(found)), key=lambda i: (found[i][0], -found[i][1], -found[i][2].priority))
    kept = []
    for priority in {r.priority for _, _, r in found}:
        reach = -1
        for i in order:
            _, end, rule = found[i]
            if rule.priority >= priority:
                if rule.priority == priority and end > reach:
                    kept.append(i)
                reach = max(reach, end)
    return sorted((found[i] for i in kept), key=lambda x: x[:2])


def scan(text: str | None) -> dict:
    flat, n_words = normalise(text)
    places = base_places(flat)
    kept = detections(flat)
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) if places or kept else np.zeros(0, np.int64)
    starts = np.searchsorted(spaces, [at for at, _ in places])
    firsts = np.searchsorted(spaces, [a for a, _, _ in kept])
    lasts = np.searchsorted(spaces, [b for _, b, _ in kept])
    doubt = 1.0
    for _, _, rule in kept:
        doubt *= 1 - rule.confidence
    for _ in places:
        doubt *= 1 - BASE_CONFIDENCE
    base = {label for _, label in places}
    return {
        "n_words": n_words,
        "n_base": len(places),
        "first_word": int(starts.min()) if places else None,
        "last_word": int(starts.max()) if places else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {r.label for _, _, r in kept})),
        "score": 1 - doubt,
        "matches": [{"label": r.label, "first_word": a - 1, "n_words": b - a + 1, "priority": r.priority} for a, b, (_, _, r) in zip(firsts.tolist(), lasts.tolist(), kept, strict=True)],
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,n_words:long,priority:long>>"
_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int64())])))])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df, with the fields of scan()."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([scan(t) for t in batch.column(1).to_pylist()], schema=_ARROW)
        return pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["doc_id", *_ARROW.names])

    return map_texts(id_and_text(df, id_col, text_col), of, SCHEMA)
