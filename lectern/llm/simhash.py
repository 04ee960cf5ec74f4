"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance.

Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words joined by one space with
repeats; a text of fewer words is one shingle, a text without words (or null) has fingerprint zero.  A bit is set if
it is set in more than half of the shingles' XXH64 values (seed 42).

Links: two fingerprints that differ in at most 3 bits agree on at least two of five blocks, so every pair meets in
one of ten buckets, each keyed by two blocks (25 or 26 bits).  Equal fingerprints are one node.  Inside a bucket a
walk emits a spanning forest of the verified links, never all pairs.  A bucket of more than
``HOT_BUCKET`` fingerprints is dealt out again by five of eight blocks (40 bits), which bounds any group by 2**24
fingerprints.

Nulls in the id column are kept; such rows take part with a null id.  Repeated rows and equal texts share a node, however
many there are.  Very long texts are hashed whole, in stretches.  An empty table gives an empty result.  Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, map_texts, materialize, runs
from lectern.llm.components import connected_components

MAX_BITS = 3
WIDTH = 3
SEED = 42
HOT_BUCKET = 1_000_000
#: Hashes whose bits are unpacked at once (64 bytes each).
CHUNK = 1 << 16


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([digest(flat[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id long, fp long): one row for each row of df; fp holds the 64 bits as a signed number."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_texts(id_and_text(df, id_col, text_col), of, "doc_id long, fp long")


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that cover 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block_keys(fp: Column, n: int, same: int) -> Column:
    """An array with one key for each choice of ``same`` of n blocks: the choice's number and the blocks' bits."""
    blocks = _blocks(n)
    keys = []
    for number, chosen in enumerate(combinations(range(n), same)):
        key = F.lit(number).cast("long")
        for i in chosen:
            shift, width = blocks[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    return F.array(*keys)


def _differing(x: np.ndarray) -> np.ndarray:
    """Bits set in each row of 64-bit words."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _walk(fps: np.ndarray, nodes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one small group, from the first node of each part to the others: what is reached leaves the rest,
    so at most len - 1 links are emitted."""
    while len(fps) > 1:
        start, front, fps, nodes = nodes[0], [fps[0]], fps[1:], nodes[1:]
        while front and len(fps):
            near = _differing(fps ^ front.pop()) <= bits
            if near.any():
                yield np.full(int(near.sum()), start), nodes[near]
                front.extend(fps[near])
                fps, nodes = fps[~near], nodes[~near]


def _link_group(fps: np.ndarray, nodes: np.ndarray, bits: int, n: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one bucket.  Large groups are split again by choices of n - bits of n blocks, which loses no pair."""
    fps = fps.reshape(len(fps), -1)
    if len(fps) <= 4096 or n > 16 or fps.shape[1] > 1:
        yield from _walk(fps, nodes, bits)
        return
    for chosen in combinations(_blocks(n), n - bits):
        mask = sum(((1 << w) - 1) << s for s, w in chosen)
        key = fps[:, 0] & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                yield from _link_group(fps[part], nodes[part], bits, n + 4)


def _link_sorted(bits: int):
    """Links inside runs of equal keys of key-sorted batches; a run that goes on in the next batch is carried over."""

    def links(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, sizes = np.r_[0, cuts], np.diff(np.r_[0, cuts, len(keys)])
        left, right = [], []
        pairs = starts[sizes == 2]  # most buckets with any pair hold two
        near = _differing(fps[pairs] ^ fps[pairs + 1]) <= bits
        left.append(nodes[pairs[near]])
        right.append(nodes[pairs[near] + 1])
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for a, b in _link_group(fps[at : at + size], nodes[at : at + size], bits):
                left.append(a)
                right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            fp = np.stack([np.asarray(batch.column(i)).view(np.uint64) for i in range(2, batch.num_columns)], axis=1)
            if held and key[-1] == held[-1][0][-1]:  # all of one run so far
                held.append((key, fp, node))
                continue
            cut = int(np.searchsorted(key, key[-1], side="left"))
            held.append((key[:cut], fp[:cut], node[:cut]))
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(key[cut:], fp[cut:], node[cut:])]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _bucket_links(keyed: DataFrame, bits: int) -> DataFrame:
    """keyed: (key, node, words of the fingerprint)."""
    # By node too: walks then begin at the least node, so that buckets with the same rows give the same links.
    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(_link_sorted(bits), "a long, b long")


def near_links(nodes: DataFrame, bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """nodes: (fp long, distinct; node long).  Returns (a, b): connections whose components are those of all pairs of
    fingerprints at ``bits`` or fewer differing bits.  The hot keys are at most 10 n / hot_bucket rows."""
    keyed = nodes.select(F.explode(_block_keys(F.col("fp"), bits + 2, 2)).alias("key"), "node", "fp")
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_bucket).select("key")
    hot = materialize(hot, "hot-buckets")
    if hot.isEmpty():
        return _bucket_links(keyed, bits)
    finer = keyed.join(hot, "key", "left_semi").select("node", "fp").distinct()
    finer = finer.select(F.explode(_block_keys(F.col("fp"), 8, 8 - bits)).alias("key"), "node", "fp")
    return _bucket_links(keyed.join(hot, "key", "left_anti"), bits).union(_bucket_links(finer, bits))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of df; component_id is the smallest id reachable over links."""
    marked = materialize(fingerprints(df, id_col, text_col, width), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = connected_components(near_links(nodes.where("node is not null"), bits))
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


# --- near copies by the share of common shingles -------------------------------------------------------------------
#
# Two texts that share 80 % of their five-word shingles differ in some 15 % of a fingerprint's bits, too many for exact
# pigeonholing of 64 bits.  Long fingerprints are cut into many blocks instead: of two-word shingles, which fewer edits
# touch.  Where a passage was added, cut or replaced the two-word similarity is ``SIMILARITY`` too; blocks are sized for
# that: such a pair shares one with a chance of ``CHANCE``.  A block has as many bits as the number of rows, so that the
# mean bucket doesn't grow with the corpus, and as many blocks as the chance then asks for (``block_shape``); a bucket of
# more than ``WIDE_BUCKET`` rows is dealt out as pairs of chunks.  The Hamming distance of 128-bit
# fingerprints of five-word shingles (each once), its limit ``DEVIATIONS`` standard deviations beyond what ``SIMILARITY``
# gives, then leaves loose groups.  Inside each group the exact share of common shingles decides, so no pair below
# ``SIMILARITY`` is linked.

COPY_WIDTH = 5
SIMILARITY = 0.8
BLOCK_WIDTH = 2
#: The least number of blocks and of bits in one.
BLOCKS = 96
BLOCK_BITS = 18
CHANCE = 0.99
#: Rows of a bucket that are compared with one another in one task.
WIDE_BUCKET = 1 << 14
CHECK_WORDS = 2
DEVIATIONS = 4.0
#: Texts, and shingles, of a loose group that are compared at once with as many others.
CHUNK_TEXTS = 256
CHUNK_SHINGLES = 1 << 19
#: The most bits of the filter that keeps texts outside loose groups from being shuffled (16 MB).
FILTER_BITS = 27


def _odd(first: int, n: int) -> np.ndarray:
    """Multipliers that mix a hash in n ways."""
    return (np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def block_shape(n_rows: int, similarity: float = SIMILARITY, chance: float = CHANCE) -> tuple[int, int]:
    """(number of blocks, bits in one) for so many rows."""
    bits = max(BLOCK_BITS, max(1, n_rows - 1).bit_length())
    agree = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return max(BLOCKS, int(np.ceil(np.log(1 - chance) / np.log(1 - agree**bits)))), bits


def bits_for(similarity: float, total: int = 64 * CHECK_WORDS, deviations: float = 1.0) -> int:
    """Differing bits of two fingerprints at a Jaccard similarity, and some standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return round(total * share + deviations * np.sqrt(total * share * (1 - share)))


def _long_fingerprint(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """64 bits for each multiplier: majority bits of differently mixed hashes."""
    counts = np.zeros(64 * len(odd), np.int64)
    for at in range(0, len(hashes), 2048):
        x = hashes[at : at + 2048, None] * odd
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def _content(text: str) -> bytes:
    """128-bit hash of the words."""
    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()))


def _sketch(text: str, width: int, shape: tuple[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(128-bit hash of the words, block keys, fingerprint to filter with)."""
    blocks, bits = shape
    content = _content(text)
    long = _long_fingerprint(np.unique(shingle_hashes(text, BLOCK_WIDTH)), _odd(CHECK_WORDS, -(-blocks * bits // 64)))
    wide = np.unpackbits(long.view(np.uint8), bitorder="little")[: blocks * bits]
    keys = wide.reshape(blocks, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    return content, keys | (np.arange(blocks, dtype=np.int64) << bits), _long_fingerprint(np.unique(shingle_hashes(text, width)), _odd(0, CHECK_WORDS))


def sketches(df: DataFrame, shape: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", width: int = COPY_WIDTH) -> DataFrame:
    words = [f"f{i}" for i in range(CHECK_WORDS)]

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, keys, check = zip(*[_sketch(t, width, shape) for t in batch.column(1).to_pylist()], strict=True)
        keys = pa.ListArray.from_arrays(np.arange(0, shape[0] * len(keys) + 1, shape[0], dtype=np.int32), np.concatenate(keys))
        check = np.stack(check).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), keys, *[pa.array(check[:, i]) for i in range(CHECK_WORDS)]], names=["doc_id", "content", "keys", *words])

    return map_texts(id_and_text(df, id_col, text_col), of, f"doc_id long, content binary, keys array<long>, {', '.join(f'{w} long' for w in words)}")


def _contracted(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: a node's links to smaller ones give way to one to the least of these, and to
    links from it to the others, which the nodes of a large group share.  A node has as many smaller ones as buckets it
    is in, or chunks of them, at most."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    met = down.groupBy("a").agg(F.collect_set("b").alias("all")).withColumn("b", F.array_min("all"))
    others = F.transform(F.filter("all", lambda x: x != F.col("b")), lambda x: F.struct(x.alias("a"), F.col("b").alias("b")))
    return met.select(F.explode(F.concat(F.array(F.struct("a", "b")), others)).alias("link")).select("link.a", "link.b").distinct()


def _in_chunks(keyed: DataFrame, hot_bucket: int) -> DataFrame:
    """Buckets over ``hot_bucket`` rows are dealt out as pairs of chunks of about that size: every pair of rows still
    meets, and no task holds more than two chunks."""
    hot = materialize(keyed.groupBy("key").agg(F.ceil(F.count("*") / hot_bucket).cast("int").alias("chunks")).where("chunks > 1"), "hot-buckets")
    if hot.isEmpty():
        return keyed
    rows = keyed.join(hot, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return keyed.join(hot, "key", "left_anti").union(rows.select(key.alias("key"), *keyed.columns[1:]))


class _Sets:
    """Sets of shingles, none empty, of which one at a time is compared with some others."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes = np.array([len(x) for x in sets])
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.cells = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.mark = np.zeros(len(self.cells), np.int32)
        self.similarity = similarity

    def near(self, f: int, others: np.ndarray) -> np.ndarray:
        """Whether each of the others has a Jaccard similarity of at least ``similarity`` with f."""
        mine = self.cells[self.starts[f] : self.starts[f] + self.sizes[f]]
        self.mark[mine] = 1
        if 8 * len(others) >= len(self.sizes):
            common = np.add.reduceat(self.mark[self.cells], self.starts)[others]
        else:
            common = np.array([self.mark[self.cells[self.starts[i] : self.starts[i] + self.sizes[i]]].sum() for i in others], np.int64)
        self.mark[mine] = 0
        return common >= self.similarity * (self.sizes[f] + self.sizes[others] - common) - 1e-9

    def walk(self, rest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(one, those first reached from it): spanning links of the near pairs among rest."""
        while len(rest) > 1:
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                f = front.pop()
                near = self.near(f, rest)
                if near.any():
                    yield f, rest[near]
                    front.extend(rest[near].tolist())
                    rest = rest[~near]


def _chunk_links(side: np.ndarray, sets: _Sets) -> Iterator[tuple[int, int]]:
    """Links of a chunk with itself, or between two, where what is linked inside each already counts as one: as many
    links as there are such parts, less one, at most."""
    chunks = [np.flatnonzero(side == x) for x in np.unique(side)]
    if len(chunks) == 1:
        for f, reached in sets.walk(chunks[0]):
            yield from ((f, i) for i in reached.tolist())
        return
    part = np.arange(len(side))
    for chunk in chunks:
        for f, reached in sets.walk(chunk):
            part[reached] = part[f]
    one, two = chunks
    for f in one.tolist():
        if not len(open_ := two[part[two] != part[f]]):
            continue
        for i in open_[sets.near(f, open_)].tolist():
            if part[i] != part[f]:
                yield f, i
                part[part == part[i]] = part[f]


def _verified_links(df: DataFrame, loose: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """loose: (grp, node, content).  Returns (a, b): links whose components are those of all pairs of one loose group
    with an exact similarity of ``similarity`` or more.  A large group is dealt out as pairs of chunks.

    Sets are made where the texts are, for the ids that a filter of at most 2**``FILTER_BITS`` bits lets through; only
    sets are shuffled.  The filter loses none; beyond its size it lets more through than needed.
    """
    spark = df.sparkSession
    bits = min(FILTER_BITS, max(15, (16 * loose.count()).bit_length()))
    place = F.pmod(F.xxhash64("node"), F.lit(1 << bits))
    found = loose.select(F.floor(place / 32768).cast("int").alias("k"), (place % 32768).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits"))
    held = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.collect():  # 4 KB for each 2**15 bits of the filter
        held[4096 * r["k"] : 4096 * (r["k"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    filter_ = spark.sparkContext.broadcast(held)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.asarray(batch.column(1))
        batch = batch.filter(pa.array(filter_.value[at >> 3] >> (at & 7) & 1).cast(pa.bool_()))
        texts = batch.column(2).to_pylist()
        shingles = pa.array([np.unique(shingle_hashes(t, width)).tobytes() for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_content, texts), pa.binary()), shingles], names=["id", "of", "shingles"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            if group.num_rows < 2:
                continue
            nodes = np.asarray(group.column("node"))
            made = _Sets([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], similarity)
            pairs = np.array([*_chunk_links(np.asarray(group.column("mine")), made)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["a", "b"])

    rows = id_and_text(df, id_col, text_col).where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("at"), "text")
    made = map_texts(rows, sets, "id long, of binary, shingles binary").where(F.octet_length("shingles") > 0)
    same = (F.col("id") == F.col("node")) & (F.col("of") == F.col("content"))  # other rows may repeat the id
    found = materialize(made.join(loose, same).select("grp", "node", "content", "shingles").dropDuplicates(["content"]), "shingle-sets")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_TEXTS, F.sum(F.octet_length("shingles")) / (8 * CHUNK_SHINGLES))).cast("int")
    sizes = found.groupBy("grp").agg(chunks.alias("chunks"))
    placed = found.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("content"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = placed.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "mine", "shingles")
    return pairs.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node").mapInArrow(links, "a long, b long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = COPY_WIDTH, similarity: float = SIMILARITY, hot_bucket: int = WIDE_BUCKET) -> DataFrame:
    """(doc_id, component_id): one row for each row of df.  Texts of equal words are one class; classes whose shingles'
    similarity is ``similarity`` or more are linked (99 % of such pairs share a block).  Null and empty texts are one
    class, linked with no other.  Very long texts count whole; a table without rows gives none; only the two named columns
    are read, so others may have any name; rows with a null id form no link and have a null component."""
    words = [f"f{i}" for i in range(CHECK_WORDS)]
    marked = materialize(sketches(df, block_shape(df.count(), similarity), id_col, text_col, width), "sketches")
    sketched = marked.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), *[F.first(w).alias(w) for w in words])
    keyed = sketched.where("node is not null").select(F.explode("keys").alias("key"), "node", *words)
    nodes = materialize(marked.groupBy("content").agg(F.min("doc_id").alias("node")), "classes")
    loose = connected_components(_contracted(_bucket_links(_in_chunks(keyed, hot_bucket), bits_for(similarity, deviations=DEVIATIONS))))
    loose = materialize(nodes.join(loose, "node").select(F.col("component").alias("grp"), "node", "content"), "loose-groups")
    links = _verified_links(df, loose, id_col, text_col, width, similarity)
    labels = nodes.join(connected_components(links), "node", "left").select("content", F.coalesce("component", "node").alias("component_id"))
    return marked.select("doc_id", "content").join(labels, "content").select("doc_id", "component_id")


def first_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = COPY_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df, all columns, whose id is the smallest of its group.  An id names one document: of rows that
    repeat it the one with the least text hash stays.  Rows without an id can't be named and stay as they are."""
    found = near_copies(df, id_col, text_col, width, similarity)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"))
    order = Window.partitionBy("id").orderBy("h")
    named = rows.where("id is not null").join(first, F.col("id") == F.col("first_id"), "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    return named.select("row").union(rows.where("id is null").select("row")).select("row.*")
