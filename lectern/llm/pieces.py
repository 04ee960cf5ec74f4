"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The best segmentation has the greatest sum of piece scores; at equal sums the longer last piece wins.  The automaton
reads a chunk once; at each position it follows output links to every piece that ends there (longest first), and each
relaxes that position's best score.  A character no piece ends with becomes its UTF-8 bytes (or the unknown id).

A chunk is a run of spaces with what follows up to the next space.  No piece holds a space after another character
(checked when the model is read; else the whole text is one chunk), and none holds a line break if the alphabet has
none, so the chunks' best segmentations together are the text's.  Chunks recur, so each worker keeps up to ``MEMO`` of
them; forgetting changes the speed only.

Decoding joins the pieces' bytes.  It restores every text without the character U+2581, which stands for a space.
A null text is empty; empty texts have no ids.  Rows are independent: repeated rows, null ids, other columns and empty
tables change nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import id_and_text, map_texts

SPACE = "▁"
#: Chunks a worker remembers.
MEMO = 300_000
_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """The pieces of a model file with identity normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        entries = [dict(_fields(v)) for k, v in fields if k == 1]
        rules = next((dict(_fields(v)) for k, v in fields if k == 3), {})
        if rules.get(2) or rules.get(4, 1):
            raise ValueError("only models that neither map characters nor drop spaces are supported")
        self.prefix = SPACE if rules.get(3, 1) else ""
        names = [e[1].decode() for e in entries]
        scores = [float(np.frombuffer(e[2], "<f4")[0]) if 2 in e else 0.0 for e in entries]
        kinds = [e.get(3, _NORMAL) for e in entries]
        self.unknown = kinds.index(_UNKNOWN)
        self.byte_ids = {int(names[i][3:5], 16): i for i, k in enumerate(kinds) if k == _BYTE}
        self.automaton = ahocorasick.Automaton()
        for i, (name, score, kind) in enumerate(zip(names, scores, kinds, strict=True)):
            if kind in (_NORMAL, _USER):
                self.automaton.add_word(name, (len(name), score, i))
        self.automaton.make_automaton()
        usable = [n for n, k in zip(names, kinds, strict=True) if k in (_NORMAL, _USER)]
        self.unknown_score = min(scores) - 10
        self.chunked = not any(SPACE in n.lstrip(SPACE) for n in usable)
        self.breaks = self.chunked and not any("\n" in n for n in usable)
        self.scores = np.array(scores)
        self.bytes = [bytes([int(n[3:5], 16)]) if k == _BYTE else b"" if k in (_CONTROL, _UNUSED) else " ⁇ ".encode() if k == _UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.after_space: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}

    def best(self, chunk: str) -> tuple[int, ...]:
        """Single-pass Viterbi; the chunk's spaces are written as U+2581."""
        size = len(chunk)
        score: list[float | None] = [0.0] + [None] * size
        last: list[tuple[int, int]] = [(0, 0)] * (size + 1)  # length and id of the piece that ends here
        done = 0

        def settle(upto: int) -> int:
            for p in range(done + 1, upto + 1):
                if score[p] is None:
                    score[p], last[p] = score[p - 1] + self.unknown_score, (1, -1)
            return upto

        for end, (length, worth, piece) in self.automaton.iter(chunk):
            end += 1
            if done < end - 1:
                done = settle(end - 1)
            total = score[end - length] + worth
            if score[end] is None or total > score[end]:
                score[end], last[end] = total, (length, piece)
        done = settle(size)
        ids: list[int] = []
        p = size
        while p:
            length, piece = last[p]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(chunk[p - 1].replace(SPACE, " ").encode("utf-8", "surrogatepass")))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            p -= length
        return tuple(reversed(ids))

    def _known(self, memo: dict[str, tuple[int, ...]], key: str, chunk: str) -> tuple[int, ...]:
        ids = memo.get(key)
        if ids is None:
            if len(memo) >= MEMO:
                memo.clear()
            ids = memo[key] = self.best(chunk)
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        if not self.chunked:
            return list(self.best(self.prefix + text.replace(" ", SPACE)))
        if self.breaks and self.prefix and SPACE not in text and "  " not in text and text[0] != " ":
            after, bare = self.after_space, self.bare
            for n, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if n:
                    ids += self._known(bare, "\n", "\n")
                    if words[0]:
                        ids += bare.get(words[0]) or self._known(bare, words[0], words[0])
                    words = words[1:]
                for word in words:
                    ids += after.get(word) or self._known(after, word, SPACE + word)
            return ids
        for chunk in _CHUNKS.findall(self.prefix + text.replace(" ", SPACE)):
            ids += self._known(self.bare, chunk, chunk)
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        table = self.bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One automaton a worker and model file."""
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): one row for each row of df."""
    path = model or default_model()

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([pieces(path).encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return map_texts(id_and_text(df, id_col, text_col), of, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): one row for each row of df; null ids give a null text."""
    path = model or default_model()

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([None if ids is None else pieces(path).decode(ids) for ids in batch.column(1).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return map_texts(df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{ids_col}` as array<int>) as ids"), of, "doc_id long, text string")


def encoding_digest(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32 of the ids as little-endian 32-bit numbers, score, round_trip): encodes and decodes again."""
    path = model or default_model()

    def one(text: str) -> tuple[int, int, float, bool]:
        ids = pieces(path).encode(text)
        packed = np.array(ids, "<u4")
        return len(ids), zlib.crc32(packed.tobytes()), float(pieces(path).scores[packed].sum()), pieces(path).decode(ids) == text

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], names=["doc_id", "n_ids", "ids_crc32", "score", "round_trip"])

    return map_texts(id_and_text(df, id_col, text_col), of, "doc_id long, n_ids long, ids_crc32 long, score double, round_trip boolean")
