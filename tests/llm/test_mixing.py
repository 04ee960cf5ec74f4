import heapq
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, shard string, blocks string"


def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * size[s]] if total else []
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = 2.0 * size[s]
        left = 1.5 * sum(size.values()) - sum(full.values())


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in texts.items()}
    size, taken = {}, {}
    for r in got:
        assert r["size"] == words[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(size)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.source_size == size[r.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= 64
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_a_hot_source_over_many_shards(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 37 as int))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"))
    got = mixing.mix(rows, block_words=8, shard_words=1000).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.expr("taken - 2 * size")).alias("over")).collect()
    for r in got:
        assert r.over <= 0 and r.taken == pytest.approx(r.target, rel=0.01)


@pytest.mark.parametrize("claims", [[5.2, 3.1, 1.7], [0.4, 0.4, 0.2], [100.5, 0.5, 7.3, 7.3, 90.4], [1.0] * 9 + [12.6, 0.4]])
def test_highest_quotients(spark, claims):
    seats = round(sum(claims))
    heap, want = [(-c, i, 0) for i, c in enumerate(claims)], [0] * len(claims)
    heapq.heapify(heap)
    for _ in range(seats):
        _, i, k = heapq.heappop(heap)
        want[i] += 1
        heapq.heappush(heap, (-claims[i] / (2 * k + 3), i, k + 1))
    rows = spark.createDataFrame([(0, i, c, 1000, seats) for i, c in enumerate(claims)], "g int, i int, claim double, limit long, seats long")
    got = {r.i: r.quota for r in mixing.sainte_lague(rows, ["g"], ["i"]).collect()}
    assert [got[i] for i in range(len(claims))] == want


def test_nulls_repeats_clashing_names_and_empty(spark):
    rows = [(1, None, "a", "x", "y", "z"), (2, "", None, "x", "y", "z"), (3, "one two", None, None, None, None), (3, "one two", None, None, None, None), (None, "a b c", "a", "", "", ""), (4, "x " * 50_000, "b", "", "", "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 3, 50_000]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    none = spark.createDataFrame([(1, None, None, "", "", "")], SCHEMA)
    assert [(r.target, r.taken) for r in mixing.mix(none).collect()] == [(0.0, 0)]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_documents_on_a_whole_table(spark):
    """Sources come within one document of their quotas, the whole within a few; copies are integers, two at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mixed_documents(docs)
    assert got.dtypes == docs.dtypes
    copies = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in texts.items()}
    size, taken, largest = {}, {}, {}
    for i, r in texts.items():
        size[r.source] = size.get(r.source, 0) + words[i]
        taken[r.source] = taken.get(r.source, 0) + words[i] * copies.get(i, 0)
        largest[r.source] = max(largest.get(r.source, 0), words[i])
    want = plain_targets(size)
    assert max(copies.values()) <= 2
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] + 64
    errors = sorted(abs(taken[s] - want[s]) / want[s] for s in want)
    assert errors[len(errors) // 2] < 0.02
    assert abs(sum(taken.values()) - sum(want.values())) < 0.01 * sum(want.values())
    again = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs.repartition(7)).groupBy("doc_id").count().collect()}
    assert again == copies


def test_whole_documents_by_systematic_choice(spark):
    """Against a loop over each shard's documents by size."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 37 as int))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"))
    dealt, shards = mixing.quotas(mixing.sizes(rows), 8, 500)
    quota = {(r.source, r.shard): r for r in shards.collect()}
    offset = {(r.source, r.shard): r.s for r in shards.where("blocks > 0").select("source", "shard", F.expr(f"pmod(xxhash64({mixing.SEED + 3}, source, shard), blocks)").alias("s")).collect()}
    groups = {}
    for r in dealt.collect():
        if r["size"]:
            groups.setdefault((r.source, r.shard), []).append((-r["size"], r.doc_id))
    want = {}
    for at, members in groups.items():
        total = offset[at]
        for _, doc_id in sorted(members):
            before, total = total, total + quota[at].quota
            if copies := total // quota[at].blocks - before // quota[at].blocks:
                want[doc_id] = copies
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(rows, block_words=8, shard_words=500).groupBy("doc_id").count().collect()}
    assert got == want


def test_whole_documents_of_odd_rows(spark):
    rows = [(1, None, "a", "x", "y", "z"), (2, "", None, "x", "y", "z"), (3, "one two", None, None, None, None), (3, "one two", None, None, None, None), (None, "a b c", "a", "", "", ""), (4, "x " * 50_000, "b", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed_documents(df)
    assert got.dtypes == df.dtypes and {r.doc_id for r in got.collect()} <= {3, None, 4}
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mixed_documents(df.where("doc_id = 1")).count() == 0


def test_running_sums_over_ranges(spark):
    rows = [(i * 7919 % 1009, float(i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(5)
    got = {r.k: (r.n, r.s) for r in mixing.running(df, [F.col("k").desc()], {"n": F.lit(1), "s": F.col("x")}, "t").collect()}
    n, total, want = 0, 0.0, {}
    for k, x in sorted(rows, reverse=True):
        want[k] = (n, total)
        n, total = n + 1, total + x
    assert got == want


def test_plans_have_no_window_over_all_rows(spark):
    """The only windows without a key run over one row a range."""
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id") % 9).alias("source"))
    plan = mixing.targets(mixing.sizes(df))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
