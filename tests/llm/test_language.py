import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, host string, said string, id string"


def test_held_out_accuracy_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars > 200").select("doc_id", "text", "lang")
    rows = sorted(docs.where("doc_id % 10 = 0").collect())
    model = language.TextModel.of([(r.text, r.lang) for r in rows[::2]])
    said = [model.languages[int(np.argmax(model.evidence(r.text)))] for r in rows[1::2]]
    assert np.mean([a == r.lang for a, r in zip(said, rows[1::2], strict=True)]) > 0.98


def test_fusion_against_plain_bayes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect())
    model = language.TextModel.of([(r.text, r.lang) for r in rows])
    langs = model.languages
    none = F.lit(None).cast("string")
    got = {r.id: r for r in language.identify(docs, "doc_id", F.col("text"), F.col("lang"), none, F.col("source"), model).collect()}
    whole = [sum(r.lang == x for r in rows) + 1 for x in langs]
    top = [n / sum(whole) for n in whole]
    for r in rows:
        n = [sum(o.source == r.source and o.lang == x for o in rows) for x in langs]
        above = [(a + 20 * t) / (sum(n) + 20) for a, t in zip(n, top, strict=True)]
        n = [a - (r.lang == x) for a, x in zip(n, langs, strict=True)]  # without its own
        prior = [(a + 5 * p) / (sum(n) + 5) for a, p in zip(n, above, strict=True)]
        said = model.evidence(r.text)
        logs = [said[i] + math.log(prior[i]) + math.log(0.9 if x == r.lang else 0.1 / (len(langs) - 1)) for i, x in enumerate(langs)]
        best = max(logs)
        want = 1 / sum(math.exp(x - best) for x in logs)
        assert got[r.doc_id].posterior == pytest.approx(want, rel=1e-6)
        assert got[r.doc_id].language == langs[logs.index(best)] and got[r.doc_id].kept


def test_addresses_and_markup(spark):
    rows = [
        (1, "https://www.Shop.example.de/fr-FR/a?x", "<html dir=ltr lang='FR'><p>x"),
        (2, "http://user@m.a.b.example.co:80/english/", '<HTML\nLANG="en-US">'),
        (3, "//x.org", "<p lang=de>"),
        (4, "no address", None),
        (5, None, ""),
    ]
    df = spark.createDataFrame(rows, "i int, url string, html string")
    host = language.host_of(F.col("url"))
    got = df.select("i", host.alias("h"), language.parent_of(host).alias("p"), language.suffix_language(F.col("url"), host, ["fr", "de"]).alias("s"), language.declared_language(F.col("html")).alias("d")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("shop.example.de", "example.de", "fr", "fr"), ("a.b.example.co", "example.co", None, "en"), ("x.org", "x.org", None, None), (None, None, None, None), (None, None, None, None)]
    shown = spark.createDataFrame([("<html><script>var a='<p>';</script><p>Hi&amp;<!-- no --> you</p>",)], "h string").select(language.visible_text(F.col("h"))).first()[0]
    assert shown.split() == ["Hi", "you"]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = language.identify_pages(pages).collect()
    declared = {r.page_id: r.d for r in pages.select("page_id", language.declared_language(F.col("html")).alias("d")).collect()}
    assert len(got) == len(declared)
    assert np.mean([r.language == declared[r.page_id] for r in got if declared[r.page_id]]) > 0.9


def test_nulls_repeats_clashing_names_and_empty(spark):
    en, fr = "the thing that was there and then this " * 20, "le chat est dans la maison avec une autre " * 20
    rows = [(1, en, "en", "a", "h", "s", "i"), (1, en, "en", "a", "h", "s", "i"), (2, fr, "fr", None, None, None, None), (3, fr, None, "a", "", "", ""), (4, None, "en", "a", "", "", ""), (5, "", None, None, "", "", ""), (None, "12 34 --", "fr", "", "", "", ""), (6, "und der die nicht zu kein " * 30000, "xx", "a", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.language, r.kept) for r in language.identify_documents(df).collect()), key=str)
    assert got == sorted([(1, "en", True), (1, "en", True), (2, "fr", True), (3, "fr", True), (4, "und", False), (5, "und", False), (None, "und", False), (6, "xx", True)], key=str)
    kept = language.accepted_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 3, 6]
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify_documents(empty).count() == 0 and language.accepted_documents(empty).columns == df.columns


def test_a_rare_language_of_a_large_table_is_known(spark):
    rows = [(i, f"the thing was there and number {i} too", "en") for i in range(9000)] + [(9000 + i, f"das ding war hier und nummer {i} auch", "de") for i in range(2)]
    rows += [(None, "the thing", "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("h"))
    got = {r.doc_id: r.language for r in language.identify_documents(df).where("doc_id >= 8990").collect()}
    assert got == {i: "de" if i >= 9000 else "en" for i in range(8990, 9002)}
    sample = language.training_rows(df.selectExpr("doc_id as id", "text", "lang as declared"), 100).collect()
    assert len(sample) == 100 and sum(r.declared == "de" for r in sample) == 2


def test_the_bound_holds_for_rows_that_share_an_id_or_a_text(spark):
    df = spark.range(9000).select(F.lit(1).cast("long").alias("id"), F.lit("the same words").alias("text"), F.lit("en").alias("declared"))
    assert language.training_rows(df, 10).count() == 10
    df = spark.range(9000).select(F.lit(1).cast("long").alias("id"), F.concat(F.lit("words "), "id").alias("text"), F.lit("en").alias("declared"))
    assert language.training_rows(df, 10).count() == 10


def test_whole_training_texts_count(spark):
    """What stands beyond any prefix of a text is known too."""
    rows = [(1, "x" * 30_000 + " das ding war hier und nicht da" * 300, "de", "h"), (2, "y" * 30_000 + " the thing was here and not there" * 300, "en", "h"), (3, "das ding war hier und nicht da", None, None), (4, "the thing was here and not there", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.language for r in language.identify_documents(df).collect()} == {1: "de", 2: "en", 3: "de", 4: "en"}
    model = language.fit(df.selectExpr("doc_id as id", "text", "lang as declared"))
    same = language.TextModel.of([(r[1], r[2]) for r in rows[:2]])
    assert model.languages == same.languages and np.array_equal(model.logs, same.logs)


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "abc abc", "xx", "h"), (2, "abc abc", "yy", "h"), (3, "abc abc", None, None)]
    got = {r.doc_id: r for r in language.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[3].posterior == pytest.approx(0.5) and got[3].text_language == "xx"
    assert (got[1].language, got[2].language) == ("xx", "yy")


def test_quotas():
    assert language.quotas({"a": 1, "b": 500, "c": 9000}, 100) == {"a": 1, "b": 49, "c": 50}
    assert language.quotas({"a": 1, "b": 5}, 100) == {"a": 1, "b": 5}
    assert language.quotas({"a": 3, "b": 5, "c": 7}, 2) == {"a": 1, "b": 1, "c": 1}
