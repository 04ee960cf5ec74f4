"""Chat formatting of typed content parts.  DataFrame functions only.

A turn's content is an array of parts (type, text, ref, tokens).  Each part is visited by its type: text is escaped and
kept; image, audio, document and any other type become placeholders that are numbered through the conversation, with
the reference and the expanded token count (``PART_TOKENS`` where the part has none) recorded as an attachment.

Template: ``<|turn|>role<|says|>part<|part|>part<|end|>`` for each turn.  Wherever a text or role holds something that
reads as a control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, with or without backslashes after the
bracket) one backslash is put in; taking one out gives the text back exactly, so a text can never end or open a turn.

Order: turn (null first), then role and content, so repeated turns have a defined order and all stay.  Null text, role
and type are the empty string, empty and ``text``; a turn without parts has an empty body; a null conversation id is a
conversation.  An empty table gives an empty result.  Only the named columns are read, so others may have any name.  A
conversation, however long its turns, is one string, so it must fit a task; conversations are never gathered with one
another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TYPE = "struct<type:string,text:string,ref:string,tokens:int>"
#: Tokens that an attachment stands for where its part doesn't say.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
TURN, SAYS, PART, END = "<|turn|>", "<|says|>", "<|part|>", "<|end|>"
_CONTROL = r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def text_part(text: Column) -> Column:
    """Plain text as content of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(f"array<{PART_TYPE}>")


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", learn_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans (code points of ``formatted``, end exclusive,
    one for each turn of ``learn_role``), attachments (number, type, ref, tokens, turn), n_tokens_expanded."""
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(content_col), F.array().cast(f"array<{PART_TYPE}>")).alias("content"),
    )
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    attached = F.filter("content", lambda p: kind(p) != "text")
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", F.col("content").cast("string"))
    so_far = conv.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(conv)).withColumn("n_attached", F.size(attached))
    rows = rows.withColumn("before", F.coalesce(F.sum("n_attached").over(so_far), F.lit(0)))

    expanded = F.create_map(*[F.lit(x) for pair in PART_TOKENS.items() for x in pair])
    notes = F.transform(
        attached,
        lambda p, i: F.struct(
            (F.col("before") + i + 1).cast("int").alias("number"),
            kind(p).alias("type"),
            p["ref"].alias("ref"),
            F.coalesce(p["tokens"], expanded[kind(p)], F.lit(1)).cast("int").alias("tokens"),
            F.col("turn").alias("turn"),
        ),
    )
    number = lambda i: F.col("before") + F.size(F.filter(F.slice("content", 1, i + 1), lambda q: kind(q) != "text"))
    visited = F.transform(
        "content",
        lambda p, i: F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.regexp_replace(kind(p), "[^A-Za-z0-9_]", "_"), F.lit(":"), number(i), F.lit("|>"))),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    rows = rows.withColumn("notes", notes).withColumn("head", head).withColumn("body", F.array_join(visited, PART))
    length = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("at", F.coalesce(F.sum(length).over(so_far), F.lit(0)))
    start = (F.col("at") + F.length("head")).cast("long")
    span = F.struct(start.alias("start"), (start + F.length("body")).alias("stop"))
    turn = F.struct("n", F.concat("head", "body", F.lit(END)).alias("text"), F.when(F.col("role") == learn_role, span).alias("span"), "notes")
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("turns"))
    notes = F.flatten("turns.notes")
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join("turns.text", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
        notes.alias("attachments"),
        F.aggregate(notes, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens_expanded"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from the formatted string alone; parts stay separated and numbered as written."""
    parts = F.split(formatted, r"<\|turn\|>")
    texts = F.slice(parts, F.lit(2), F.size(parts))  # the part before the first mark is empty

    def turn(x: Column) -> Column:
        role = F.substring_index(x, SAYS, 1)
        body = F.substring(x, F.length(role) + (len(SAYS) + 1), F.length(x) - F.length(role) - (len(SAYS) + len(END)))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(texts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """Read back from the output of format_chat: turns, loss text and their hashes."""
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
