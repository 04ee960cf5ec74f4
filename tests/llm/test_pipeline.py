import inspect

import corpus_pipeline
from lectern.llm import language, mixing, pieces, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"


def test_stages_agree_with_their_operators(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = {r.doc_id for r in language.identify_documents(docs).where("kept").collect()}
    one = corpus_pipeline.language_stage(spark, docs, sf).cache()
    assert {r.doc_id for r in one.collect()} == kept and len(kept) > 0.97 * docs.count()

    groups = simhash.near_copies(one).collect()
    two = corpus_pipeline.near_duplicate_stage(spark, one, sf).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted({r.component_id for r in groups})

    three = corpus_pipeline.personal_data_stage(spark, two, sf).cache()
    texts = {r.doc_id: r.text for r in two.collect()}
    assert {r.doc_id: r.text for r in three.collect()} == {i: pii.redact(t) for i, t in texts.items()}
    assert any("<EMAIL>" in r.text for r in three.collect()) and not any("@" in r.text for r in three.collect())
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = corpus_pipeline.mixing_stage(spark, three, sf).cache()
    rows = {tuple(r) for r in three.collect()}
    copies = [tuple(r) for r in four.collect()]
    assert set(copies) <= rows and max(copies.count(r) for r in set(copies)) <= 2
    goal = mixing.mix(three).groupBy("source").agg({"target": "max"}).collect()
    words = sum(len(r[1].split()) for r in copies)
    assert abs(words - sum(g[1] for g in goal)) < 0.15 * words

    five = corpus_pipeline.token_stage(spark, four, sf).collect()
    coder = pieces.Pieces(pieces.default_model())
    text = {r.doc_id: r.text for r in three.collect()}
    assert len(five) == len(copies) and all(coder.decode(r.ids) == text[r.doc_id] for r in five)
    for stage in (one, two, three, four):
        assert stage.dtypes == docs.dtypes


def test_run_chains_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids"] and out.count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, None, None, "s", "r"), (2, "", "en", "a", 0, "s", "r"), (3, "the thing was there a@b.co " * 20, "en", "a", 5, "s", "r")]
    rows += [(3, *rows[2][1:]), (4, *rows[2][1:]), (None, *rows[2][1:])]
    for table in (rows, []):
        docs = spark.createDataFrame(table, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.dtypes == docs.dtypes
            out.collect()
            docs = spark.createDataFrame(out.collect(), SCHEMA)
        assert corpus_pipeline.token_stage(spark, docs, "").count() == docs.count()
    kept = simhash.first_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, None]
