import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat

SCHEMA = f"conv_id long, turn long, role string, content array<{chat.PART_TYPE}>, formatted string, n int, text string"


def text(x):
    return [("text", x, None, None)]


def test_escape_round_trip(spark):
    bits = ["<|", "<\\|", "<\\\\|", "</s>", "<s>", "[INST]", "[/INST]", "[\\/INST]", "<", "|", "\\", "a", "\n", "end|>", "é"]
    cases = [a + b + c for a in bits for b in bits for c in bits]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_parts_attachments_and_spans(spark):
    rows = [
        (1, 0, "user", [("text", "see", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]),
        (1, 1, "assistant", text("ok <|end|>")),
        (1, 2, "user", [("document", "x", "c.pdf", None), ("odd kind", None, "d", None)]),
        (1, 3, "assistant", []),
        (2, 0, None, None),
    ]
    df = spark.createDataFrame([(*r, "f", 1, "t") for r in rows], SCHEMA)
    one, two = chat.format_chat(df).orderBy("conv_id").collect()
    assert one.formatted == "<|turn|>user<|says|>see<|part|><|image:1|><|part|><|audio:2|><|end|><|turn|>assistant<|says|>ok <\\|end|><|end|><|turn|>user<|says|><|document:3|><|part|><|odd_kind:4|><|end|><|turn|>assistant<|says|><|end|>"
    assert [one.formatted[s.start : s.stop] for s in one.loss_spans] == ["ok <\\|end|>", ""]
    assert [tuple(a) for a in one.attachments] == [(1, "image", "a.png", 256, 0), (2, "audio", "b.wav", 7, 0), (3, "document", "c.pdf", 512, 2), (4, "odd kind", "d", 1, 2)]
    assert one.n_tokens_expanded == 776
    assert (two.n_turns, two.formatted, two.loss_spans, two.n_tokens_expanded) == (1, "<|turn|><|says|><|end|>", [], 0)


def test_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", text(f"turn {t} <|end|> " * 20)) for t in range(3000)] + [(2, 0, "assistant", text("word " * 200_000))]
    df = spark.createDataFrame([(*r, "f", 1, "t") for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(df)).collect()}
    said = ["".join(f"turn {t} <|end|> " * 20 for t in range(1, 3000, 2)), "word " * 200_000]
    for i, loss in enumerate(said, 1):
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].n_turns == 3000


def test_ties_nulls_and_empty_table(spark):
    rows = [(None, 1, "user", text("b")), (None, 1, "user", text("b")), (None, 1, "user", text(None)), (None, None, "assistant", text("first 😀"))]
    df = spark.createDataFrame([(*r, "f", 1, "t") for r in rows], SCHEMA)
    r = chat.digest(chat.format_chat(df)).first()
    said = ["assistant\nfirst 😀\n", "user\n\n", "user\nb\n", "user\nb\n"]
    assert r.turns_sha256 in {hashlib.sha256("".join(x).encode()).hexdigest() for x in (said, [said[0], *said[2:], said[1]])}
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (4, 7, hashlib.sha256("first 😀".encode()).hexdigest())
    assert chat.digest(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="<|[]\\/sINST> \né", max_size=12), min_size=1, max_size=6), min_size=1, max_size=12))
def test_read_back(spark, convs):
    rows = [(i, t, "assistant" if t % 2 else "user", text(x)) for i, c in enumerate(convs) for t, x in enumerate(c)]
    df = spark.createDataFrame([(*r, "f", 1, "t") for r in rows], SCHEMA)
    out = chat.format_chat(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        assert [t.text for t in r.turns] == convs[r.conv_id]
        assert r.loss == "".join(convs[r.conv_id][1::2])
