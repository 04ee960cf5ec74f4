import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import boosting, quality

SCHEMA = "doc_id long, text string, features string, score string, label int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {w: windows.count(w) for w in set(windows)}
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = quality.judge(docs, labels).collect()
    assert {r.doc_id: tuple(r[1:7]) for r in got} == want
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.training_rows(quality.document_statistics(docs.join(labels, "doc_id", "left_semi")), labels).collect()
    rows.sort(key=lambda r: r.doc_id * 2654435761 % 2**32)
    half = len(rows) // 2
    trees = quality.train(rows[:half])
    x, y = np.array([r.features for r in rows[half:]]), np.array([r.label for r in rows[half:]])
    kept = trees.probability(x) >= quality.THRESHOLD
    assert kept[y == 1].mean() > 0.97
    assert (kept == (y == 1)).mean() > max(y.mean(), 1 - y.mean())


@pytest.mark.parametrize("sign", [1, -1])
def test_monotone(sign):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (sign * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000) > 0).astype(float)
    trees = boosting.fit(x, y, [sign, 0, -sign])
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.75
    for f, s in ((0, sign), (2, -sign)):
        grid = np.repeat(rng.normal(size=(50, 3)), 40, axis=0)
        grid[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (s * np.diff(trees.margin(grid).reshape(50, 40), axis=1) >= -1e-12).all()


def test_repeat_words_pairs_numbered_first():
    rng = np.random.default_rng(1)
    words = [b"%d" % i for i in rng.integers(0, 12, 400)]
    n, distinct = quality.repeat_words(words)
    assert n == plain(b" ".join(words).decode())[4] and distinct == 12


def test_a_score_equal_to_the_threshold_keeps(spark):
    words = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, words, "k", "s", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    score = quality.judge(docs, none).first().score
    assert quality.judge(docs, none, threshold=score).first().kept and not quality.judge(docs, none, threshold=np.nextafter(score, 2)).first().kept


def test_a_very_long_text(spark):
    text = "\n".join(f"line {i % 7000} with some words of its own {i}" for i in range(60_000))
    r = quality.judge(spark.createDataFrame([(1, text, "", "", 0)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r.n_words, r.word_chars) == (len(text.split()), sum(map(len, text.split())))
    words = text.split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    assert r.n_repeat_words == len(covered)


def test_nulls_repeats_clashing_names_and_empty(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = [(1, None, "x", "y", 1), (2, "a b " * 200, None, None, None), (2, "a b " * 200, None, None, None), (None, " ".join(map(str, range(9000))), "", "", 0)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert sorted((r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in got) == [(0, 0, True, False), (400, 400, True, False), (400, 400, True, False), (9000, 0, False, got[3].kept)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = [r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA), none).collect()]
    assert kept == [False, False, False, True]
    assert quality.judge(spark.createDataFrame([], SCHEMA), none).count() == 0
