import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score string, matches int"


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_whole_table_base_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: plain_base(r.text) for r in docs.collect()}
    got = licenses.scan_licenses(docs).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in got} == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def labels(text):
    return licenses.scan(text)["labels"]


def test_rules():
    assert len(licenses.rules()) > 250 and len({r.pattern for r in licenses.rules()}) == len(licenses.rules())
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache-2.0"
    assert labels("Released under the MIT License.") == "mit"
    assert labels("Licensed under MIT.") == "mit"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc"
    assert labels("GNU Lesser\nGeneral Public License v2.1") == "gpl,lgpl-2.1"
    assert labels("Copyright (c) 2021 Someone. ALL RIGHTS RESERVED") == "copyright,reserved"
    assert labels("See https://www.apache.org/licenses/LICENSE-2.0 for more") == "apache-2.0"
    assert labels("https://creativecommons.org/licenses/by-sa/4.0/") == "cc-by-sa"
    assert labels("a plain text about bsdx and licenses") == ""


@pytest.mark.parametrize("text", ["GPLv3", "GPL-3.0-or-later", "gpl 3", "under the GPL v3", "GNU GPL version 3", "SPDX-License-Identifier: GPL-3.0+", "gnu.org/licenses/gpl-3.0.html"])
def test_one_label_for_each_license(text):
    assert labels(text) == "gpl-3.0"


def test_bare_names_and_expressions():
    assert labels("Apache-2.0") == "apache-2.0" and labels("the GPL") == "gpl"
    assert labels("SPDX-License-Identifier: LGPL-2.1-or-later") == "lgpl-2.1"
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause and more") == "apache-2.0,bsd-3-clause,mit"
    assert labels("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0") == "gpl-2.0,gpl-exception"
    assert labels("SPDX-License-Identifier: nothing known") == "" and labels("spdx license identifier") == ""


def test_keywords():
    assert licenses.keyword_of(r"(?:3|three) clause bsd(?: LIC)?") == " clause bsd"
    assert licenses.keyword_of(r"beer ?ware licen[cs]e") == "ware licen"


def plain_detections(flat):
    """Matches by rank; one inside a kept one goes."""
    found = [(*m.span(), r) for r in licenses.rules() for m in r.pattern.finditer(flat)] + licenses.tags(flat)
    kept = []
    for a, b, r in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0])):
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, r))
    return sorted((a, b, r.priority) for a, b, r in kept)


PIECES = "licensed under the gnu general public license version 3 2 lesser cc by nc sa 4 0 mit apache bsd clause or and spdx identifier all rights reserved copyright 2020 no warranty public domain".split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_detections_against_brute_force(words):
    flat, _ = licenses.normalise(" ".join(words))
    assert [(a, b, r.priority) for a, b, r in licenses.detections(flat)] == plain_detections(flat)


@pytest.mark.parametrize("piece", ["cc by word ", "mit license ", "spdx license identifier mit or ", "all rights reserved ", "permission is hereby granted "])
def test_time_is_linear_in_matches(piece):
    took = []
    for n in (5000, 20000):
        start = time.process_time()
        licenses.scan(piece * n)
        took.append(time.process_time() - start)
    assert took[1] < 9 * took[0] + 0.2


def samples(pattern):
    """The shortest and the longest text of a pattern without unbounded parts."""
    from re import _constants as C
    from re import _parser as P

    def of(tree, longest):
        out = b""
        for op, arg in tree:
            if op is C.LITERAL:
                out += bytes([arg])
            elif op is C.IN:
                out += next(bytes([x]) for x in b"s2az0" if re.match(pattern_of(arg), bytes([x])))
            elif op is C.BRANCH:
                out += sorted((of(x, longest) for x in arg[1]), key=len)[-1 if longest else 0]
            elif op is C.SUBPATTERN:
                out += of(arg[3], longest)
            elif op is C.MAX_REPEAT:
                low, high, body = arg
                out += of(body, longest) * (min(high, 3) if longest else low)
        return out

    def pattern_of(items):
        kind = {C.LITERAL: lambda a: re.escape(bytes([a])), C.RANGE: lambda a: b"%c-%c" % a, C.CATEGORY: lambda a: rb"\d" if "DIGIT" in str(a) else rb"\w"}
        return b"[" + b"".join(kind[op](arg) for op, arg in items) + b"]"

    tree = P.parse(pattern)
    return {of(tree, False), of(tree, True)}


def test_prefilter_loses_no_match():
    """Texts that a rule matches hold its keyword."""
    for rule in licenses.rules():
        assert len(rule.keyword) > 2, rule
        for text in samples(rule.pattern.pattern):
            flat = b" " + text + b" "
            assert rule.pattern.search(flat), (rule, text)
            assert rule.keyword in flat, (rule, text)


def test_containment_and_priority():
    flat, _ = licenses.normalise("licensed under the gnu general public license version 3 or gnu general public license")
    kept = licenses.detections(flat)
    assert [(r.label, r.priority) for _, _, r in kept] == [("gpl-3.0", 3), ("gpl", 2)]


def test_nulls_repeats_long_texts_and_empty_table(spark):
    long = "word " * 300_000 + "cc by " * 3
    rows = [(1, None, "x", "y", 1), (1, None, "x", "y", 1), (None, "", None, None, None), (2, long, "", "", 0)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.n_words, r.n_base, r.first_word, r.labels) for r in got[:3]) == [(0, 0, None, "")] * 3
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].last_word) == (300_006, 3, 300_000, 300_004)
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
