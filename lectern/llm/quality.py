"""Quality rules: document statistics, hard rules, and gradient-boosted trees with monotone features.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none).  Statistics are made in one pass over the texts and
written to the shared folder; the trees are fitted on the driver to at most ``TRAIN_ROWS`` labelled documents (chosen by
a hash of the id; only their statistics are collected) and score the written statistics in numpy.

A document fails the base if n_words < 50 or 100 * n_repeat_words > 50 * n_words; otherwise the trees decide: it is kept
if its score is at least ``THRESHOLD``.  Repeated rows are scored alike; labels that repeat an id count once (the
lowest); without labels the trees are a constant that keeps everything the base keeps.  A score equal to ``THRESHOLD``
keeps.  Texts of any length are read whole, in one pass.  Only the named columns are read, so others may have any name.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import boosting
from lectern.llm.common import id_and_text, map_texts, materialize

#: Most labelled rows the trees are fitted to.
TRAIN_ROWS = 20_000
THRESHOLD = 0.35
SYMBOLS = b"#*$%&|<>"
#: Feature names; more of a feature with -1 never raises the score, more of one with 1 never lowers it.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 0, "digits": 0, "upper": 0, "other_ascii": 0, "beyond_ascii": 0, "log_lines": 0, "log_longest_word": -1}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.ones(256, bool)
_CODE[0x80:0xC0] = False  # continuation bytes
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_OTHER = (np.arange(256) < 128) & ~_SPACE & ~_SYMBOL & ~_DIGIT & ~_UPPER & ~_LOWER
_BEYOND = _CODE & (np.arange(256) >= 128)


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """(words in 3-word windows that are found twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(a) < 4:
        return 0, len(ids)
    n = len(ids)
    if n < 1 << 21:
        key = (a[:-2] * n + a[1:-1]) * n + a[2:]
    else:  # pairs are numbered first, so that the product stays within 64 bits
        _, pair = np.unique(a[:-2] * n + a[1:-1], return_inverse=True)
        key = pair * n + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(a), bool)
    for i in range(3):
        covered[i : len(again) + i] |= again
    return int(covered.sum()), n


def statistics(text: str) -> tuple[list[int], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distinct, longest word, lines) and the byte counts."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated, distinct = repeat_words(words)
    chars = int(counts[_CODE & ~_SPACE].sum())
    return [len(words), chars, int(counts[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated, distinct, max(map(len, words), default=0), len(lines)], counts


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the five counts, features array<double> in the order of FEATURES): one row for each row of df."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, hist = zip(*map(statistics, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ([], [])
        c = np.array(rows, np.int64).reshape(-1, 8)
        h = np.array(hist).reshape(-1, 256)
        words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
        ratio = lambda mask: h[:, mask].sum(axis=1) / chars
        x = np.stack([np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / chars, c[:, 3] / np.maximum(c[:, 7], 1), c[:, 4] / words, c[:, 5] / words, ratio(_DIGIT), ratio(_UPPER), ratio(_OTHER), ratio(_BEYOND), np.log1p(c[:, 7]), np.log1p(c[:, 6])], axis=1)
        offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c[:, i]) for i in range(5)], pa.ListArray.from_arrays(offsets, x.ravel())], names=["doc_id", *_COUNTS, "features"])

    return map_texts(id_and_text(df, id_col, text_col), of, f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, features array<double>")


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents; the broadcast side has no more rows than that."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    chosen = named.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return stats.select("doc_id", "features").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("features").alias("features"), F.first("label").alias("label"))


def train(rows: list) -> boosting.Trees:
    rows = sorted(rows, key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in rows]).reshape(-1, len(FEATURES))
    return boosting.fit(x, np.array([r["label"] for r in rows]), list(FEATURES.values()))


def score(stats: DataFrame, trees: boosting.Trees) -> DataFrame:
    """Adds score double to the statistics (features are dropped)."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(trees.probability(x))], names=["doc_id", *_COUNTS, "score"])

    return stats.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, score double")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, score): one row for each row of df."""
    stats = materialize(document_statistics(df, id_col, text_col), "statistics")
    scored = score(stats, train(training_rows(stats, labels).collect()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
