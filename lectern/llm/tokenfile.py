"""Token ids of whole documents as files of independently coded, checksummed blocks.

Writing: documents in ascending id order (null first; repeated ids by their texts' hash) are tokenized, an end id is
appended to each, and every partition's stream of ids is cut into blocks of ``rangecoder.BLOCK`` ids.  A file is a
Parquet table in the shared folder with one row for each block: part, block, n_ids, the ordinal of its first document in
the part, the ids, starts and numbers of token ids of the documents in it, whether its first document began earlier and
its last goes on, crc32 of the block's ids as little-endian 32-bit numbers, and the range coder's payload.  Parts are in
document order.

Reading decodes any rows alone, checks every block's crc32 and returns one piece for each document in each block;
pieces are put together by adding lengths and combining crc32 sums, so no document's ids are gathered in one place.

Python only tokenizes, with a bounded memo of words between spaces, line breaks and tabs, at which this tokenizer always
cuts.  Coding, decoding and checksums run in the JVM.

Null and empty texts have the end id only.  Rows that repeat an id or a whole row are documents of their own; those of
one id are dealt by their text's hash, so they don't meet in one task.  A very long text runs through many blocks.  Only
the two named columns are read, so other columns may have any name.  An empty table gives no blocks.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import rangecoder
from lectern.llm.common import id_and_text, save

END_ID = 1
#: Blocks handed over at once.
BLOCKS_AT_ONCE = 16
TEXTS_AT_ONCE = 64
#: Words in each of a worker's two memo generations.
MEMO = 450_000
#: Words that are tokenized in one call.
WORDS_AT_ONCE = 512
#: In lower-case Latin-1: a comma or full stop after what is surely no mark is what this doesn't find.
_MARKED_STOP = re.compile(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\xde\xf7][.,] ")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of whole texts, 16 bits each, from those of their words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > rangecoder.VOCABULARY:
            raise ValueError("ids must be below 65536")
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)", re.IGNORECASE)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Tokens that end a word, if this tokenizer marks them.
        self.ends = np.array([name.endswith(suffix) for name in names]) if suffix else None
        self.bare = self._bare(path)

    def _bare(self, path: str):
        """The same model without normalizer and byte mapping, which leave words of a to z as they are: two thirds of the
        time.  None if a probe shows another tokenizer, for which that isn't so."""
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        try:
            bare = type(self.tokenizer).from_str(json.dumps(parts))
        except Exception:  # a model that can't stand without the rest
            return None
        letters = "abcdefghijklmnopqrstuvwxyz"
        probe = " ".join(letters[i:j] for i in range(26) for j in range(i + 1, 27))
        same = bare.encode(probe).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return bare if same else None

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u2").tobytes() for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str], tokenizer) -> list[bytes]:
        """The ids of words of letters, which this tokenizer never cuts, in one call; by one call a word if that fails."""
        if self.ends is None:
            return self._alone(words)
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            stops = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
            if len(stops) != len(some) or stops[-1] != 2 * len(ids):
                out += self._alone(some)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        return out

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of words into the memo.  Letters and a run of ASCII marks after them are looked up alone, since
        the tokenizer cuts between them; any other word, and one with a special string, as it is written."""
        young, old = self.young, self.old
        latin, letters, whole, cut = set(), set(), set(), []
        for w in words:
            if w in old:
                young[w] = old[w]
                continue
            core = w if w.isalpha() else w.rstrip(_MARKS)
            if not core.isalpha():
                whole.add(w)
                continue
            latin_core = core.isascii()
            plain = core.lower() if latin_core else core
            if plain not in young:
                (latin if latin_core else letters).add(plain)
            if plain is not w and plain != w:
                mark = w[len(core) :]
                if mark not in young:
                    whole.add(mark)
                cut.append((w, plain, mark))
        for found, tokenizer in ((latin, self.bare or self.tokenizer), (letters, self.tokenizer)):
            some = list(found)
            young.update(zip(some, self._together(some, tokenizer), strict=True))
        some = list(whole)
        young.update(zip(some, self._alone(some), strict=True))
        for w, plain, mark in cut:
            young[w] = young[plain] + young[mark]

    def _spaced(self, text: str) -> str:
        """The text with spaces between its words.  Where that surely changes no id, in lower case, as the tokenizer has it
        anyway, and with a space before commas and full stops, so that the memo sees fewer different words.  Sure are
        texts without special strings, which the tokenizer takes as they are written, in Latin-1, where no letter's lower
        case depends on others; a comma or full stop after another mark must stay with it."""
        text = text.replace("\n", " ").replace("\t", " ")
        if "<" in text and self.special.search(text):
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        text = text.lower()
        return text if _MARKED_STOP.search(text) else text.replace(". ", " . ").replace(", ", " , ")

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # nothing here forms cycles, and the memo is large
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > MEMO:
            self.young, self.old = {"": b""}, self.young
        get, out, holes, missing = self.young.get, [], [], set()
        for text in texts:
            split = self._spaced(text).split(" ")
            ids = list(map(get, split))
            try:
                out.append(b"".join(ids))
            except TypeError:  # some word isn't known
                at = [i for i, x in enumerate(ids) if x is None]
                missing.update([split[i] for i in at])
                holes.append((len(out), ids, [(i, split[i]) for i in at]))
                out.append(b"")
        if missing:
            self._learn(missing)
        for number, ids, at in holes:
            for i, word in at:
                ids[i] = self.young[word]
            out[number] = b"".join(ids)
        return out


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


FILE = "part int, block long, n_ids int, first_doc long, doc_ids array<long>, doc_starts array<int>, doc_sizes array<int>, begun boolean, goes_on boolean, ids_crc32 long, payload binary"
_CUT = FILE.replace("payload", "ids")
_ROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("doc_sizes", pa.list_(pa.int32())), ("begun", pa.bool_()), ("goes_on", pa.bool_()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class _Cutter:
    """Cuts one part's stream of ids into blocks."""

    def __init__(self, part: int):
        self.part, self.block, self.doc = part, 0, 0
        self.ready: list[dict] = []
        self._start(False)

    def _start(self, begun: bool) -> None:
        self.ids: list[np.ndarray] = []
        self.room = rangecoder.BLOCK
        self.row = {"part": self.part, "block": self.block, "first_doc": self.doc, "doc_ids": [], "doc_starts": [], "doc_sizes": [], "begun": begun}

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            piece = ids[at : at + self.room]
            self.row["doc_starts"].append(rangecoder.BLOCK - self.room)
            at += len(piece)
            self.room -= len(piece)
            self.ids.append(piece)
            self.row["doc_ids"].append(doc_id)
            self.row["doc_sizes"].append(len(piece))
            if not self.room:
                self._close(at < len(ids))
        self.doc += 1
        if self.room == rangecoder.BLOCK:
            self.row["first_doc"] = self.doc

    def _close(self, goes_on: bool) -> None:
        ids = np.concatenate(self.ids)
        self.ready.append(self.row | {"n_ids": len(ids), "goes_on": goes_on, "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "ids": ids.tobytes()})
        self.block += 1
        self._start(goes_on)

    def finish(self) -> None:
        if self.ids:
            self._close(False)

    def taken(self) -> pa.RecordBatch:
        rows, self.ready = self.ready, []
        return pa.RecordBatch.from_pylist(rows, schema=_ROW)


def write_file(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the documents' ids and returns the file's path in the shared folder."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                for doc_id, ids in zip(part.column(0).to_pylist(), words(path).encode(part.column(1).to_pylist()), strict=True):
                    cutter.add(doc_id, np.frombuffer(ids + end, "<u2"))
                if len(cutter.ready) >= BLOCKS_AT_ONCE:
                    yield cutter.taken()
        cutter.finish()
        if cutter.ready:
            yield cutter.taken()

    keyed = id_and_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    cut = ordered.mapInArrow(run, _CUT)
    coded = cut.withColumn("payload", rangecoder.encoded(df.sparkSession, F.col("ids")))
    return save(coded.drop("ids"), "token-blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks with ``ids``, little-endian 32-bit numbers, for their payload.  A block whose ids don't match its
    checksum is an error."""
    ids = rangecoder.decoded(blocks.sparkSession, F.col("payload"), F.col("n_ids"))
    what = F.concat(F.lit("block "), F.col("block").cast("string"), F.lit(" of part "), F.col("part").cast("string"), F.lit(" is damaged"))
    whole = F.when(F.crc32("ids") == F.col("ids_crc32"), F.col("ids")).otherwise(F.raise_error(what))
    return blocks.withColumn("ids", ids).withColumn("ids", whole).drop("payload")


def read_pieces(blocks: DataFrame) -> DataFrame:
    """(part, doc, block, doc_id, start, n, ids_crc32): each document's piece of each block; start counts within the
    part."""
    placed = F.arrays_zip("doc_ids", "doc_starts", "doc_sizes")
    each = read_blocks(blocks).select("part", "block", "first_doc", "ids", F.posexplode(placed).alias("i", "d"))
    crc = F.crc32(F.substring("ids", 4 * F.col("d.doc_starts") + 1, 4 * F.col("d.doc_sizes")))
    start = F.col("block") * rangecoder.BLOCK + F.col("d.doc_starts")
    return each.select("part", (F.col("first_doc") + F.col("i")).alias("doc"), "block", F.col("d.doc_ids").alias("doc_id"), start.alias("start"), F.col("d.doc_sizes").cast("long").alias("n"), crc.alias("ids_crc32"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file, all from decoded ids.  start counts the ids of
    all documents before it: the parts' sizes are summed up over one row a part."""
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n_part").over(order), F.lit(0)).alias("part_start"))
    piece = F.struct("block", "n", "ids_crc32")
    docs = read_pieces(blocks).groupBy("part", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    crc = rangecoder.joined_crc32(blocks.sparkSession, F.col("pieces.ids_crc32"), F.transform("pieces.n", lambda n: 4 * n))
    whole = F.when(F.size("pieces") == 1, F.col("pieces")[0]["ids_crc32"]).otherwise(crc)
    return docs.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("start")).alias("start"), "n_tokens", whole.alias("ids_crc32"))


def read_ids(blocks: DataFrame) -> DataFrame:
    """(part, block, ids array<int>): the decoded blocks, for consumers of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["part", "block", "ids"])

    return read_blocks(blocks).select("part", "block", "ids").mapInArrow(run, "part int, block long, ids array<int>")
