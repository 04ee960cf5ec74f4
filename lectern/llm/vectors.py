"""Near-duplicate vectors by NN-descent.

1. Vectors that are null, zero or hold null or non-finite components link with nothing, nor do those with a null label
   or id.  Equal vectors of a label are one class (its smallest id, its number of rows).
2. The first neighbour graph comes from ``TREES`` sorted orders of random-hyperplane codes: runs of ``LEAF`` classes are
   compared in full, each class keeps its ``NEIGHBOURS`` best.
3. NN-descent: a class's neighbours and reverse neighbours are brought together with their vectors and compared with
   one another; each proposes its best to the others; lists keep the best; until few lists change.  Reverse
   neighbours are sampled as the method does; a list is a means of search and no bound on results: every comparison
   of 2 and 3 also gives its links, as a spanning forest.
4. These links form components.  A list full of links is saturated: it is enlarged to its whole component, in which
   all pairs are compared, in blocks of at most ``BLOCK`` classes; of ``SMALL_BLOCK`` or more in components of up to
   ``SPREAD`` blocks, so that one large component is many tasks.  No task holds more than two blocks, of whose cosines
   ``TILE`` rows at once, and only counts leave a task.  A component of m classes sends m * m / ``BLOCK`` vectors.
5. Audit: the links of classes chosen by a hash of the id are found by comparing them with every class of their label.
   More classes are asked until ``EVIDENCE`` groups of links were met, all classes or ``AUDIT_MOST`` were asked.  Recall
   is weighed by link, by class and by group, where a class of n links counts as a share 1 / (n + 1) of one; the least
   of them counts.  While it is below ``LEAST_RECALL``, or the evidence is too little to tell, more orders and rounds
   follow; after ``MAX_AUDITS`` a lower recall is an error, and too little evidence a warning.

Cosines are computed in double precision from the given components; no link is below the threshold.  The search may
miss links between components; inside a component counts are exact.  Labels are told apart by a 64-bit hash.

Repeated rows are vectors of their own; equal vectors of a label are compared once, however many they are.  Rows that
repeat an id with other vectors are vectors of their own too.  Of equally near neighbours any may stand in a list: lists
are a means of search, and links don't depend on them.  An empty table gives an empty result.  Only the three named
columns are read, so others may have any name; vectors may have any length, and only those of one length are compared.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize, runs
from lectern.llm.components import connected_components

THRESHOLD = 0.93
TREES = 4
CODE_BITS = 24
LEAF = 128
NEIGHBOURS = 8
REVERSE = 12
#: Best partners that a member of a local join proposes for each of its lists.
PROPOSALS = 3
MAX_ROUNDS = 4
#: The descent ends when fewer than this share of list entries are new.
SETTLED = 0.03
BLOCK = 4096
SMALL_BLOCK = 128
SPREAD = 8
#: Rows of a block whose cosines with another block are held at once.
TILE = 512
#: Classes asked at once, first and then, and in all.
AUDIT = 2000
AUDIT_NEXT = 8000
AUDIT_MOST = 42_000
EVIDENCE = 100
LEAST_RECALL = 0.97
MAX_AUDITS = 12
#: Cosines held at once by a task of the audit.
AUDIT_CELLS = 1 << 21


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Unit rows in double precision."""
    rows = column.to_pylist()
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def _usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> Column:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    return F.coalesce(df[id_col].isNotNull() & df[label_col].isNotNull() & df[vector_col].isNotNull() & finite, F.lit(False))


def classes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame, str]:
    """(usable rows: vec_id, grp, vec; classes: id, grp, vec, n; the components' numpy type).  grp numbers the pair of
    label and length."""
    kind = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    usable = df.where(_usable(df, id_col, vector_col, label_col))
    usable = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = np.asarray(column.flatten()).astype(kind).tobytes()
            size = np.dtype(kind).itemsize
            edges = (np.asarray(column.offsets) - column.offsets[0].as_py()) * size
            packed = pa.array([flat[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["vec_id", "grp", "vec"])

    grp = F.xxhash64("label", F.size("v"))
    packed = materialize(usable.select("vec_id", grp.alias("grp"), "v").mapInArrow(pack, "vec_id long, grp long, vec binary"), "vectors")
    found = packed.groupBy("grp", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    return packed, materialize(found.select("id", "grp", "vec", "n"), "vector-classes"), kind


def _codes(kind: str, seed: int):
    """Adds a code for each tree: the signs of the products with random hyperplanes, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = [np.frombuffer(v, kind) for v in batch.column(2).to_pylist()]
            out = np.zeros((len(rows), TREES), np.int64)
            for length in {len(r) for r in rows}:
                if length not in planes:
                    planes[length] = np.random.default_rng((seed, length)).normal(size=(length, TREES * CODE_BITS))
                at = [i for i, r in enumerate(rows) if len(r) == length]
                signs = (np.stack([rows[i] for i in at]).astype(np.float64) @ planes[length] > 0).reshape(len(at), TREES, CODE_BITS)
                out[at] = signs @ (1 << np.arange(CODE_BITS)[::-1])
            codes = pa.ListArray.from_arrays(np.arange(0, out.size + 1, TREES, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], codes], names=["id", "grp", "vec", "codes"])

    return run


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, similarity): each row's k best others."""
    k = min(k, len(ids) - 1)
    to = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    return ids[rows], ids[to.ravel()], sims[rows, to.ravel()]


def _spanning(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``near`` connects: each row leaves the rest when it is first reached."""
    u, v = [], []
    rest = near.any(axis=1)
    while rest.any():
        front = [int(np.argmax(rest))]
        rest[front[0]] = False
        while front:
            at = front.pop()
            reached = np.flatnonzero(near[at] & rest)
            rest[reached] = False
            u.append(np.full(len(reached), ids[at]))
            v.append(ids[reached])
            front.extend(reached.tolist())
    return np.concatenate(u), np.concatenate(v)


def _compared(ids: np.ndarray, x: np.ndarray, k: int, threshold: float, old: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """What a full comparison of a small group gives: each member's k best others, and the links as a spanning forest,
    which no list's length bounds.  old: members whose pairs were compared in an earlier round."""
    sims = _cosines(x, x)
    if old is not None:
        sims[np.ix_(old, old)] = -2.0
    np.fill_diagonal(sims, -2.0)
    if (near := sims >= threshold).any():
        u, v = _spanning(ids, near)
        yield u, v, np.ones(len(u)), np.ones(len(u), bool)
    u, v, s = _best(ids, sims, k)
    u, v, s = u[s > -2], v[s > -2], s[s > -2]
    yield u, v, s, np.zeros(len(u), bool)


def _emit(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)


_FOUND = "u long, v long, sim double, link boolean"


def _batched(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for part in found:
        parts.append(part)
        rows += len(part[0])
        if rows > 1 << 15:
            yield _emit(parts, names)
            parts, rows = [], 0
    if parts:
        yield _emit(parts, names)


def _leaves(kind: str, threshold: float):
    def found(batches: Iterator[pa.RecordBatch]):
        for leaf in runs(batches, 2, LEAF):  # sorted by tree, group, code
            if leaf.num_rows > 1:
                yield from _compared(np.asarray(leaf.column("id")), _matrix(leaf.column("vec"), kind), NEIGHBOURS, threshold)

    return lambda batches: _batched(found(batches), ["u", "v", "sim", "link"])


def _joins(kind: str, threshold: float):
    def found(batches: Iterator[pa.RecordBatch]):
        for group in runs(batches):  # sorted by centre
            fresh = np.asarray(group.column("fresh"))
            if group.num_rows > 1 and fresh.any():
                yield from _compared(np.asarray(group.column("a")), _matrix(group.column("vec"), kind), PROPOSALS, threshold, ~fresh)

    return lambda batches: _batched(found(batches), ["u", "v", "sim", "link"])


def _lists(proposals: DataFrame) -> DataFrame:
    """The best ``NEIGHBOURS`` of each list; fresh if every proposal of the entry is."""
    once = proposals.where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS).select("u", "v", "sim", "fresh")


def first_pairs(points: DataFrame, kind: str, threshold: float, seed: int) -> DataFrame:
    """Best others and links in runs of the sorted orders."""
    coded = points.select("id", "grp", "vec").mapInArrow(_codes(kind, seed), "id long, grp long, vec binary, codes array<long>")
    orders = coded.select(F.posexplode("codes").alias("tree", "code"), "grp", "id", "vec")
    keys = ["tree", "grp", "code", F.xxhash64("id")]  # the last splits a code that many share
    parts = max(points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = orders.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("tree", "grp", "id", "vec")
    return dealt.mapInArrow(_leaves(kind, threshold), _FOUND)


def neighbour_pairs(points: DataFrame, graph: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Best others and links among neighbours of neighbours."""
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("a"), "fresh")
    sample = Window.partitionBy("w").orderBy(F.xxhash64("w", "a"))
    back = back.withColumn("rank", F.row_number().over(sample)).where(F.col("rank") <= REVERSE).drop("rank")
    both = graph.select(F.col("u").alias("w"), F.col("v").alias("a"), "fresh").union(back).groupBy("w", "a").agg(F.max("fresh").alias("fresh"))
    members = both.join(points.select(F.col("id").alias("a"), "vec"), "a").select("w", "a", "fresh", "vec")
    return members.repartition("w").sortWithinPartitions("w").mapInArrow(_joins(kind, threshold), _FOUND)


def _asked(located: DataFrame, asked: list[tuple[int, int, bytes, int]], kind: str, threshold: float) -> list[tuple[int, int]]:
    """(true links, those inside the components) of each asked class that has links."""
    groups: dict[int, list[int]] = {}
    for i, (_, grp, _, _) in enumerate(asked):
        groups.setdefault(grp, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {}
        for grp, at in groups.items():
            x = _matrix(pa.chunked_array([pa.array([asked[i][2] for i in at], pa.binary())]), kind)
            queries[grp] = np.array(at), x, np.array([asked[i][0] for i in at]), np.array([asked[i][3] for i in at])
        true, caught = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for batch in batches:
            ids, labels, parts = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            for grp in np.unique(labels).tolist():
                if grp not in queries:
                    continue
                mine, q, mine_ids, mine_parts = queries[grp]
                rows = np.flatnonzero(labels == grp)
                step = max(1, AUDIT_CELLS // len(mine))
                for at in (rows[k : k + step] for k in range(0, len(rows), step)):
                    near = _cosines(q, _matrix(batch.column(2).take(pa.array(at)), kind)) >= threshold
                    near &= mine_ids[:, None] != ids[at]
                    true[mine] += near.sum(axis=1)
                    caught[mine] += (near & (mine_parts[:, None] == parts[at])).sum(axis=1)
        some = np.flatnonzero(true)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(true[some]), pa.array(caught[some])], names=["i", "links", "caught"])

    found = located.mapInArrow(run, "i long, links long, caught long").groupBy("i").agg(F.sum("links").alias("links"), F.sum("caught").alias("caught"))
    return [(r["links"], r["caught"]) for r in found.collect()]


def _audit(points: DataFrame, named: DataFrame, kind: str, threshold: float) -> float | None:
    """The share of true links whose ends are in one component, by the weight that gives the least; None if the asked
    classes show too few links to tell.  At most ``AUDIT_NEXT`` classes are held at once."""
    located = points.join(named, points["id"] == named["node"], "left").select("id", "grp", "vec", F.coalesce("component", "id").alias("component"))
    located = materialize(located.withColumn("h", F.xxhash64("id")), "located")
    last, asked, found = None, 0, []
    while True:
        limit = AUDIT_NEXT if asked else AUDIT
        left = located if last is None else located.where(F.struct("h", "id") > F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).alias("id")))
        sample = left.orderBy("h", "id").limit(limit).collect()
        if sample:
            found += _asked(located.drop("h"), [(r["id"], r["grp"], bytes(r["vec"]), r["component"]) for r in sample], kind, threshold)
            last = sample[-1]["h"], sample[-1]["id"]
        asked += len(sample)
        whole = len(sample) < limit
        links, caught = np.array(found, float).reshape(-1, 2).T
        share = 1 / (links + 1)
        enough = 2 * share.sum() >= EVIDENCE  # a pair has two classes
        if enough or whole or asked >= AUDIT_MOST:
            break
    if not (enough or whole):
        return None
    if not len(links):
        return 1.0  # all classes were asked
    recall = caught / links
    return float(min(caught.sum() / links.sum(), recall.mean(), (share * recall).sum() / share.sum()))


def _counts(kind: str, threshold: float):
    """Links of each class inside one pair of blocks, weighed by the partners' numbers of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for group in runs(batches, 3):  # sorted by component and the two blocks
            side, ids, n = np.asarray(group.column("side")), np.asarray(group.column("id")), np.asarray(group.column("n"))
            x = _matrix(group.column("vec"), kind)
            one = np.flatnonzero(side == group.column("i")[0].as_py())
            two = np.flatnonzero(side == group.column("j")[0].as_py())
            apart, theirs = group.column("i")[0].as_py() != group.column("j")[0].as_py(), np.zeros(len(two), np.int64)
            for at in (one[k : k + TILE] for k in range(0, len(one), TILE)):
                near = _cosines(x[at], x[two]) >= threshold
                near &= ids[at][:, None] != ids[two]
                parts.append((ids[at], near @ n[two]))
                if apart:
                    theirs += n[at] @ near
            if apart:
                parts.append((ids[two], theirs))
            if sum(len(p[0]) for p in parts) > 1 << 15:
                yield _emit(parts, ["id", "links"])
                parts = []
        if parts:
            yield _emit(parts, ["id", "links"])

    return run


def count_links(points: DataFrame, named: DataFrame, kind: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links): exact inside each component; a component of m classes is (m / block)**2 / 2 bounded tasks or more."""
    needed, spread = F.ceil(F.count("*") / block), F.least(F.lit(SPREAD), F.ceil(F.count("*") / SMALL_BLOCK))
    sizes = named.groupBy("component").agg(F.greatest(needed, spread).cast("int").alias("blocks"))
    placed = points.join(named, points["id"] == named["node"]).join(sizes, "component").select("component", "blocks", "id", "vec", "n", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("side"))
    other = placed.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "side", "id", "vec", "n")
    pairs = other.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "vec", "n")
    dealt = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(_counts(kind, threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of df."""
    packed, points, kind = classes(df, id_col, vector_col, label_col)
    total = points.count()
    graph, links = None, []

    def take(pairs: DataFrame) -> DataFrame:
        """The new graph; the links among the pairs are kept aside."""
        pairs = materialize(pairs, "compared")
        links.append(pairs.where("link").select(F.col("u").alias("a"), F.col("v").alias("b")))
        fresh = pairs.where("not link").select("u", "v", "sim", F.lit(True).alias("fresh"))
        return materialize(_lists(fresh if graph is None else fresh.union(graph.withColumn("fresh", F.lit(False)))), "graph")

    for audit in range(MAX_AUDITS):
        graph = take(first_pairs(points, kind, threshold, seed=audit))
        for _ in range(MAX_ROUNDS):
            graph = take(neighbour_pairs(points, graph, kind, threshold))
            if graph.where("fresh").count() <= SETTLED * NEIGHBOURS * total:
                break
        named = materialize(connected_components(reduce(DataFrame.union, links)), "vector-components")
        recall = _audit(points, named, kind, threshold)
        if recall is not None and recall >= LEAST_RECALL:
            break
    else:
        if recall is not None:
            raise RuntimeError(f"the search found {recall:.3f} of the audited links after {MAX_AUDITS} audits")
        warnings.warn(f"too few links among {AUDIT_MOST} classes to tell the recall of the search", stacklevel=2)
    counted = count_links(points, named, kind, threshold)
    done = points.join(named, points["id"] == named["node"], "left").join(counted, "id", "left")
    done = done.select("grp", "vec", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    usable = packed.join(done, ["grp", "vec"]).select("vec_id", "n_links", "component_id")
    alone = df.where(~_usable(df, id_col, vector_col, label_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    out = usable.union(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
