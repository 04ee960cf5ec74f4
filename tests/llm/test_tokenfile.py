import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import rangecoder, tokenfile

SCHEMA = "doc_id long, text string, part string, h string, start int"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenfile.default_tokenizer())


def expected(plain, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def written(spark, df):
    path = tokenfile.write_file(df)
    return spark.read.schema(tokenfile.FILE).parquet(path)


def test_whole_table_against_brute_force(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blocks = written(spark, docs.repartition(3))
    got = sorted(map(tuple, tokenfile.read_documents(blocks).collect()))
    assert got == expected(plain, [(r.doc_id, r.text) for r in docs.collect()])
    total = sum(r[2] for r in got)
    size = blocks.selectExpr("sum(length(payload))").first()[0]
    assert 8 * size / total < 10.5  # bits an id; 16 as they are
    stream = [i for r in tokenfile.read_ids(blocks).orderBy("part", "block").collect() for i in r.ids]
    assert len(stream) == total and stream[got[-1][1] - 1] == 1


def test_long_documents_nulls_repeats_and_empty(spark, plain):
    rows = [(5, "hello world " * 9000), (1, None), (1, ""), (None, "x"), (7, "a"), (7, "a"), (7, "b"), (8, "z" * 5000)]
    df = spark.createDataFrame([(*r, "p", "b", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, tokenfile.read_documents(written(spark, df)).collect()), key=lambda r: r[1])
    same = [r for r in got if r[0] != 7 and r[0] != 1]  # rows of one id are in the order of their texts' hash
    assert same == [r for r in expected(plain, rows) if r[0] != 7 and r[0] != 1]
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in expected(plain, rows)] or {r[0] for r in got} == {r[0] for r in rows}
    assert tokenfile.read_documents(written(spark, spark.createDataFrame([], SCHEMA))).count() == 0


def test_damage_is_found(spark):
    df = spark.createDataFrame([(i, f"some text {i}", "p", "b", 1) for i in range(50)], SCHEMA)
    rows = [r.asDict() for r in written(spark, df).collect()]
    rows[0]["payload"] = bytes([rows[0]["payload"][0] ^ 64, *rows[0]["payload"][1:]])
    with pytest.raises(Exception, match="damaged"):
        tokenfile.read_documents(spark.createDataFrame(rows, tokenfile.FILE)).collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB.,'s \n\té́\x1c\x85 <|endoftext|>Σ9", max_size=30), min_size=1, max_size=4))
def test_words_encode_like_whole_texts(plain, texts):
    ours = tokenfile.words(tokenfile.default_tokenizer()).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in ours] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings_in_any_case(plain):
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>.", "<|endoftext|>x", "x<|startoftext|>y", "<|STARTOFTEXT|>"]
    ours = tokenfile.words(tokenfile.default_tokenizer()).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in ours] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_generations(plain, monkeypatch):
    monkeypatch.setattr(tokenfile, "MEMO", 5)
    coder = tokenfile.Words(tokenfile.default_tokenizer())
    for i in range(30):
        text = f"Word{i % 7} and, then. Again word{i}"
        assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def coded(spark, blocks):
    """(payload, decoded ids) of each block of ids."""
    df = spark.createDataFrame([(i, bytearray(np.asarray(b, "<u2").tobytes()), len(b)) for i, b in enumerate(blocks)], "i int, ids binary, n int")
    got = df.withColumn("payload", rangecoder.encoded(spark, F.col("ids"))).withColumn("back", rangecoder.decoded(spark, F.col("payload"), F.col("n")))
    return [(bytes(r.payload), np.frombuffer(r.back, "<u4")) for r in got.orderBy("i").collect()]


def test_coder_round_trip(spark):
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, spread, rng.integers(0, 2000)) for spread in (1, 2, 40, 3000, 65536) for _ in range(20)]
    blocks += [rng.zipf(1.3, 16384).clip(0, 65535), np.full(16384, 65535), np.zeros(16384), np.tile([3, 65535, 1024, 4096], 4096), np.arange(4096) * 16 + 15, np.array([], int), np.array([7])]
    got = coded(spark, blocks)
    assert all(np.array_equal(a, b) for a, (_, b) in zip(blocks, got, strict=True))
    assert got[0][0] == coded(spark, blocks[:1])[0][0]  # blocks don't depend on one another
    assert len(got[101][0]) < 100 and len(got[102][0]) < 100 and len(got[103][0]) < 1000 and got[105][0] == b""
    random = rng.integers(0, 65536, 16384)
    assert len(coded(spark, [random])[0][0]) < 2.7 * 16384
    context = rng.integers(0, 60000, 40)[np.tile(np.arange(40), 400)]
    assert len(coded(spark, [context])[0][0]) < 600  # order 1 and 2 foresee each id


def test_a_damaged_payload_decodes_to_something(spark):
    rng = np.random.default_rng(6)
    rows = [(bytearray(rng.integers(0, 256, size).astype(np.uint8).tobytes()), 500) for size in (0, 1, 6, 7, 8, 300, 3000) for _ in range(20)]
    df = spark.createDataFrame(rows, "payload binary, n int")
    assert {r[0] for r in df.select(F.length(rangecoder.decoded(spark, F.col("payload"), F.col("n")))).collect()} == {2000}


def test_joined_crc32(spark):
    rng = np.random.default_rng(7)
    rows = [[rng.bytes(int(n)) for n in rng.integers(0, 3000, rng.integers(1, 6))] for _ in range(60)]
    df = spark.createDataFrame([(i, [zlib.crc32(x) for x in r], [len(x) for x in r]) for i, r in enumerate(rows)], "i int, sums array<long>, sizes array<long>")
    got = df.select("i", rangecoder.joined_crc32(spark, F.col("sums"), F.col("sizes")).alias("crc")).orderBy("i").collect()
    assert [r.crc for r in got] == [zlib.crc32(b"".join(r)) for r in rows]
