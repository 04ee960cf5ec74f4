import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import spoken
from lectern.operators import segmenting

# Sentences of our own, divided by " / " as the rules say: clauses at commas, lines of up to 45 characters, short pieces
# joined to a neighbour, no article or preposition at a piece's end.
KNOWN = """
Rain fell on the harbour all through the night, / and the boats stayed in their berths.
The baker opens her shop at four every morning, / long before the first bus arrives at the square.
Mountains keep their snow well into / the summer in this part of the country.
We walked along the river, crossed two bridges, / and sat down under an old oak tree to eat our bread.
When the lights went out, / everybody in the hall fell silent, / because nobody knew what had happened.
The old clock in the tower, / which nobody had wound for years, / struck twelve — and all of us looked up at once.
She told them that the road over the pass was closed, / so they don't have to leave before the weekend.
"Never trust a map that is older than you are," the guide said, / and then he folded his own.
Yes. No. / The third answer that the committee wrote / down was a good deal longer than the others.
A violin made of spruce and maple needs many / years of playing to reach the full warmth of its tone.
Short words, here, and there, now, then, again, / and still more of them until the line is full at last.
Counterrevolutionaries misunderstood / uncharacteristically straightforward / recommendations yesterday.
""".strip().split("\n")


@pytest.mark.parametrize("line", KNOWN)
def test_known_segments(line):
    assert segmenting.segments_of(line.replace(" / ", " ")) == line.split(" / ")


WORDS = st.sampled_from("the a an to of in and but or you don't is because however, market. said, glasses information — yes! computer of, \"Too it; interesting".split())


@settings(max_examples=500, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=60))
def test_segments_only_regroup_words(words):
    text = " ".join(words)
    parts = segmenting.segments_of(text)
    assert " ".join(parts) == text
    assert len(parts) == 1 or len(text) > segmenting.HARD_MAX


def test_first_cut_width():
    for piece in segmenting.first_cut("word " * 40 + "unbreakable" * 9):
        assert len(" ".join(piece)) <= segmenting.WIDTH or len(piece) == 1


def test_column_form_sends_only_long_sentences(spark):
    texts = ["", "  ", " short one. ", KNOWN[0].replace(" / ", " "), None, "x" * 65, "y" * 66]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", segmenting.phrases(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [[""], ["  "], ["short one."], KNOWN[0].split(" / "), None, ["x" * 65], ["y" * 66]]


def test_shown_and_spoken_segments_match_in_number(spark):
    texts = ["The temperature is 2.4 degrees.", "About 6.5% of users", "Over 2,000 people attended."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    sizes = df.select(F.size(segmenting.phrases(F.col("t"))), F.size(segmenting.phrases(spoken.spoken_text(F.col("t"))))).collect()
    assert all(tuple(r) == (1, 1) for r in sizes)


def test_splitter_names():
    assert segmenting.splitter("nlp") is segmenting.splitter("rules") is segmenting.splitter()
    with pytest.raises(ValueError, match="unknown splitter"):
        segmenting.splitter("nothing")
    assert re.match("sentence", next(iter(segmenting.SPLITTERS)))
