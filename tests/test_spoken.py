import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import spoken

# raw, spoken, shown
CASES = [
    ("7.3", "seven point three", "7.3"),
    ("depth was 7.3", "depth was seven point three", "depth was 7.3"),
    ("0.8", "zero point eight", "0.8"),
    ("9.06", "nine point zero six", "9.06"),
    ("A lap took 41.7 seconds", "A lap took forty-one point seven seconds", "A lap took 41.7 seconds"),
    ("8.2%", "eight point two percent", "8.2%"),
    ("3,400 trees", "three thousand four hundred trees", "3,400 trees"),
    ("Fee: $4,050", "Fee: four thousand fifty dollars", "Fee: $4,050"),
    ("{{prn:7.3|seven and a bit}}", "seven and a bit", "7.3"),
    ("{{prn:1989|nineteen eighty-nine}}", "nineteen eighty-nine", "1989"),
    ("{{prn:$3,100|thirty-one hundred dollars}}", "thirty-one hundred dollars", "$3,100"),
    ("8.2% of all boats", "eight point two percent of all boats", "8.2% of all boats"),
    ("34% of Peru's", "thirty-four percent of Peru's", "34% of Peru's"),
    ("No figures in here.", "No figures in here.", "No figures in here."),
    ("$270 million", "two hundred seventy million dollars", "$270 million"),
    # What the reference's rules make of odd numbers.
    ("500 2026", "500 2026", "500 2026"),
    ("12345", "twelve thousand three hundred forty-five", "12345"),
    ("$1", "one dollars", "$1"),
    ("$1.5 million", "one dollars.5 million", "$1.5 million"),
    ("$640000", "six hundred forty dollars000", "$640000"),
    ("$5 billions", "five dollars billions", "$5 billions"),
    ("1,000%", "1,zero percent", "1,000%"),
    ("abc5%", "abcfive percent", "abc5%"),
    ("1,234.5", "1,two hundred thirty-four point five", "1,234.5"),
    ("192.168.1.1", "one hundred ninety-two point one six eight.one point one", "192.168.1.1"),
    ("v2.4 2.45s é2.4", "v2.4 2.45s é2.4", "v2.4 2.45s é2.4"),
    ("3.10", "three point one zero", "3.10"),
    ("1,234,56", "one thousand two hundred thirty-four,56", "1,234,56"),
    ("{{prn:}}", "{{prn:}}", "{{prn:}}"),
    ("{{prn:a|}}", "", "a"),
    ("{{prn:a|b|c}}", "b|c", "a"),
    ("{{prn:x|2,026}}", "two thousand twenty-six", "x"),
    ("1000000000000000", "1000000000000000", "1000000000000000"),
    ("٣.١", "three point one", "٣.١"),
    ("", "", ""),
]


def test_text_pairs(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    got = {r.t: (r.p.tts_text, r.p.display_text) for r in df.select("t", spoken.text_pair(F.col("t")).alias("p")).collect()}
    assert got == {raw: (said, shown) for raw, said, shown in CASES}


@pytest.mark.parametrize("raw", [None])
def test_null(spark, raw):
    row = spark.createDataFrame([(raw,)], "t string").select(spoken.text_pair(F.col("t")).alias("p")).first()
    assert row.p.tts_text is None and row.p.display_text is None


def test_number_words(spark):
    want = {"-5": "minus five", "-2.5": "zero point five", ".5": ".5", "abc": "abc", "5.": "five point ", "2,000": "two thousand", "145": "one hundred forty-five", "0": "zero", "6.5": "six point five", "1.2.3": "one point two", "999999999999999": "nine hundred ninety-nine trillion nine hundred ninety-nine billion nine hundred ninety-nine million nine hundred ninety-nine thousand nine hundred ninety-nine", "1000000": "one million", "": ""}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.w for r in df.select("n", spoken.number_words(F.col("n")).alias("w")).collect()} == want


def plain_words(n):
    if n < 1000:
        return spoken.below_thousand(n)
    for power in (4, 3, 2, 1):
        if n >= 1000**power:
            rest = plain_words(n % 1000**power)
            return f"{spoken.below_thousand(n // 1000**power)} {spoken.SCALES[power]}" + (f" {rest}" if rest else "")


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(1, 10**15 - 1) | st.integers(1, 2000), min_size=50, max_size=80))
def test_number_words_by_recursion(spark, numbers):
    df = spark.createDataFrame([(str(n),) for n in numbers], "n string")
    for r in df.select("n", spoken.number_words(F.col("n")).alias("w")).collect():
        assert r.w == plain_words(int(r.n))


def test_plan_stays_small_and_native(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(spoken.spoken_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and plan.count("regexp_extract_all") <= 2 * len(spoken.RULES)


ODD = ["$5", "$640000", "1,000%", "7", "5", "%", "%6", "million", "thousand", "v2.4", "12345", "1,234,56", "a", "Bé", "x_", "_", ".", ",", "$", "-a", "3.10", "٣.١", "\n", "\t", "\u2003", "\x1c", " ", "  ", "word", "dollars000", "192.168.1.1"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD) | st.just(" "), max_size=40).map("".join), min_size=150, max_size=200))
def test_rules_on_pieces_are_those_on_the_whole(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, "word " * 3000 + "5 % " + "-a " * 3000]], "t string")
    whole = F.col("t")
    for rule in spoken.RULES:
        whole = rule(whole)
    assert df.select("t", spoken.speak_numbers(F.col("t")).alias("p"), whole.alias("w")).where("p <> w or p is null").count() == 0


def test_rules_do_not_search_words_without_digits(spark):
    """A text is cut between words: the rules see the pieces with digits alone."""
    row = spark.createDataFrame([("one two 5 % three v12345 $7 million four",)], "t string")
    assert row.select(F.split("t", spoken.BETWEEN_WORDS, -1).alias("p")).first().p == ["one ", "two 5 % three ", "v12345 $7 million ", "four"]
