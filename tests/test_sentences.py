import pytest
from pyspark.sql import functions as F

from lectern.functions import sentences
from lectern.operators import lessons

CASES = {
    "Hello world. Next sentence.": ["Hello world.", "Next sentence."],
    "hello.World": ["hello.", "World"],
    "Dr. Smith is here.": ["Dr. Smith is here."],
    "3 p.m. Please arrive.": ["3 p.m.", "Please arrive."],
    "market.The": ["market.", "The"],
    "Dr.Smith": ["Dr.Smith"],
    "p.m.Please": ["p.m.Please"],
    "p.m.  Please": ["p.m.  Please"],
    'said."Next': ['said."', "Next"],
    "who am I? Next": ["who am I? Next"],
    "Ph.D. He left.": ["Ph.", "D. He left."],
    "The U.S. The end.": ["The U.S. The end."],
    '(he "yes.")': ['(he "yes." )'],
    "It cost 5. 10 came": ["It cost 5. 10 came"],
    'He said "Go!" Then "Stop." "Why?" she asked.': ['He said "Go!"', 'Then "Stop."', '"Why?" she asked.'],
    "Really?! Yes.": ["Really?!", "Yes."],
    "    ": ["    "],
    " Über alles. Élan vital. ": ["Über alles.", "Élan vital."],
}


def test_splits(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    assert {r.t: r.s for r in df.select("t", sentences.split_sentences(F.col("t")).alias("s")).collect()} == CASES


@pytest.mark.parametrize("word", sentences.ABBREVIATIONS)
def test_abbreviations_guard_all_enders(spark, word):
    texts = [f"x {word.title()}{e} Next" for e in ".!?"] + [f"x {word.upper()}. Next", f"{word}. Next", f"pre{word}. Next"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    sizes = [len(r.s) for r in df.select(sentences.split_sentences(F.col("t")).alias("s")).collect()]
    assert sizes == [1, 1, 1, 1, 1, 2 if f"pre{word}" not in sentences.ABBREVIATIONS else 1]


def test_ids_run_through_paragraphs(spark):
    df = spark.createDataFrame([("a", "One. Two.\r\n\r\n  \rThree\nFour. Five!"), ("b", ""), ("c", None)], "k string, text string")
    paras = lessons.paragraphs(df, "k")
    assert [(r.k, r.para_pos, r.para) for r in paras.orderBy("para_pos").collect()] == [("a", 0, "One. Two."), ("a", 3, "Three"), ("a", 4, "Four. Five!")]
    rows = lessons.sentences(df, "k").orderBy("sent_id").collect()
    assert [(r.sent_id, r.raw) for r in rows] == list(enumerate(["One.", "Two.", "Three", "Four.", "Five!"]))
    assert tuple(lessons.counts(df, "k").first()) == ("a", 3, 5)
