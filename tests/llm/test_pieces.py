import re

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pieces

SCHEMA = "doc_id long, text string, ids string, n_ids string"


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces(pieces.default_model())


@pytest.fixture(scope="module")
def unigram():
    """The library's own Viterbi over the same pieces: the model's type is set to 1 in memory."""
    with open(pieces.default_model(), "rb") as file:
        data = file.read()
    trainer = next(v for k, v in pieces._fields(data) if k == 2)
    assert data.count(trainer) == 1 and trainer.count(b"\x18\x02\x20") == 1
    return sentencepiece.SentencePieceProcessor(model_proto=data.replace(trainer, trainer.replace(b"\x18\x02\x20", b"\x18\x01\x20")))


def brute(p, text):
    """Best sum over all segmentations of the whole text, position by position over all lengths."""
    chunk = p.prefix + text.replace(" ", pieces.SPACE)
    worth = {w: v[1] for w, v in p.automaton.items()}
    best = [0.0] + [float("-inf")] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(max(0, end - 16), end):
            w = chunk[start:end]
            if w in worth:
                best[end] = max(best[end], best[start] + worth[w])
        if best[end] == float("-inf"):
            best[end] = best[end - 1] + p.unknown_score
    return best[-1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abthein \n.é日ß▁<0x>", max_size=40))
def test_whole_text_optimum(ours, text):
    ids = ours.encode(text)
    if text:
        unknown = sum(1 for c in (ours.prefix + text.replace(" ", pieces.SPACE)) if c not in {w for w in ours.automaton.keys() if len(w) == 1})
        normal = [i for i in ids if i not in ours.byte_ids.values()]
        assert sum(ours.scores[normal]) + unknown * ours.unknown_score == brute(ours, text)
    assert ours.decode(ids) == text.replace(pieces.SPACE, " ")


def test_words_against_the_library(spark, ours, unigram):
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in re.findall(r"\S+", r.text)}
    assert len(words) > 10_000
    for w in words:  # the lattice search; the library's faster path misses the optimum for some words
        assert ours.encode(w) == unigram.NBestEncodeAsIds(w, 2)[0], w


def test_round_trip_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pieces.encoding_digest(docs).collect()
    assert len(found) == docs.count() and all(r.round_trip for r in found)
    coded = pieces.encode_documents(docs)
    texts = {r.doc_id: r.text for r in pieces.decode_documents(coded).collect()}
    assert texts == {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: len(r.ids) for r in coded.collect()} == {r.doc_id: r.n_ids for r in found}


def test_forgetting_changes_nothing(monkeypatch, ours):
    texts = [f"word{i} and so on\nline {i}" for i in range(50)]
    want = [ours.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "MEMO", 3)
    assert [ours.encode(t) for t in texts] == want


def test_nulls_repeats_long_texts_clashing_names_and_empty(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "a  b\t😀", "x", "y"), (3, "a  b\t😀", "x", "y"), (None, "z" * 200_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(pieces.encoding_digest(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.n_ids == 0 for r in got] == [True, True, False, False, False] and all(r.round_trip for r in got)
    assert got[2] == got[3]
    assert pieces.encoding_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    ids = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode_documents(ids).first().text is None
