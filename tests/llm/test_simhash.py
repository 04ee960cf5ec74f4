import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, fp string, key string"


def plain_fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def plain_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = plain_components(ids, links)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in ids}


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 20])
def test_dense_groups_keep_every_component(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3)
    fps = {int(b) for b in base}
    for b in base:  # chains that drift away from three centres
        x = int(b)
        for _ in range(60):
            for bit in rng.choice(63, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)}
    nodes = list(enumerate(sorted(fps)))
    links = [(i, j) for i, a in nodes for j, b in nodes if i < j and (a ^ b).bit_count() <= 3]
    found = simhash.near_links(spark.createDataFrame([(f, i) for i, f in nodes], "fp long, node long"), hot_bucket=hot)
    got = {r.node: r.component for r in connected_components(found).collect()}
    want = plain_components([i for i, _ in nodes], links)
    assert {i: got.get(i, i) for i, _ in nodes} == want


def test_large_group_is_split_without_loss():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 2**16, 9000).astype(np.uint64) << np.uint64(20))
    nodes = np.arange(len(fps))
    links = [p for a, b in simhash._link_group(fps, nodes, 3) for p in zip(a.tolist(), b.tolist(), strict=True)]
    plain = [p for a, b in simhash._walk(fps[:, None], nodes, 3) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert plain_components(nodes.tolist(), links) == plain_components(nodes.tolist(), plain)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, None, "x", "k"), (2, "", "en", "x", "k"), (2, "", "en", "x", "k"), (None, "a b c", None, None, None), (3, "A b  c", "en", "x", "k"), (4, " \t\n", "", "", "")]
    got = sorted(((r.doc_id, r.fp == 0, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, True, 1), (2, True, 1), (2, True, 1), (None, False, 3), (3, False, 3), (4, True, 1)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprint_is_sparks_hash(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64
    assert simhash.fingerprint(simhash.shingle_hashes("A b\tc")) == h


def jaccard(a, b, width=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted_copies(n=150, seed=4):
    """(id, text): texts, copies of each with some words changed, and texts that share only a passage."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows, pairs = [], []
    passage = " ".join(word() for _ in range(60))
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(80, 400)))]
        other = list(words)
        for at in rng.choice(len(words), max(1, len(words) // int(rng.integers(45, 200))), replace=False):
            other[at] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other).title())]
        pairs.append((2 * i, 2 * i + 1))
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(140))) for i in range(40)]
    return rows, pairs


@pytest.mark.parametrize("hot", [simhash.WIDE_BUCKET, 1])
def test_near_copies_are_caught_and_others_left_alone(spark, hot):
    rows, pairs = planted_copies(n=150 if hot > 1 else 20)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), hot_bucket=hot).collect()}
    text = dict(rows)
    close = [p for p in pairs if jaccard(text[p[0]], text[p[1]]) >= 0.8]
    assert len(close) > len(pairs) / 2
    assert sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    together = {}
    for i, c in got.items():
        together.setdefault(c, []).append(i)
    for group in together.values():
        assert all(jaccard(text[group[0]], text[i]) > 0.55 for i in group)


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    copies = {}
    for i, t in sorted(text.items()):
        copies.setdefault(" ".join(t.lower().split()), []).append(i)
    assert all(len({got[i] for i in group}) == 1 for group in copies.values())
    merged = [(i, c) for i, c in got.items() if i != c]
    assert all(max(jaccard(text[i], text[j]) for j in got if got[j] == c and j != i) > 0.55 for i, c in merged)


def test_near_copy_recall_on_the_table(spark):
    """Of all pairs of different wording at 0.8 or more, by brute force, 99 % or nearly are in one group; none of less is
    linked alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        sets.setdefault(simhash._content(r.text or ""), (r.doc_id, frozenset(simhash.shingle_hashes(r.text or "", 5).tolist())))
    members = {}
    for i, x in sets.values():
        for h in x:
            members.setdefault(h, []).append(i)
    common = {}
    for ids in members.values():
        for a in range(len(ids)):
            for b in range(a):
                key = min(ids[a], ids[b]), max(ids[a], ids[b])
                common[key] = common.get(key, 0) + 1
    size = {i: len(x) for i, x in sets.values()}
    share = {(a, b): n / (size[a] + size[b] - n) for (a, b), n in common.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    close = [p for p, s in share.items() if s >= 0.8]
    assert len(close) >= 5
    assert sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    linked = {i for p in close for i in p}
    assert all(got[i] == i or i in linked for i in size)


def test_contracted_links_have_the_same_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(m, x) for m in range(1000, 1020) for x in range(2000, 2100) if (m + x) % 3]
    got = [tuple(r) for r in simhash._contracted(spark.createDataFrame(links, "a long, b long")).collect()]
    nodes = {i for pair in links for i in pair}
    assert plain_components(sorted(nodes), got) == plain_components(sorted(nodes), links)
    assert len(got) < len(links) / 2


def test_block_shape():
    assert simhash.block_shape(0) == simhash.block_shape(250_000) == (96, 18)
    agree = 1 - np.arccos(1.6 / 1.8) / np.pi
    for n in (10**6, 10**9, 3 * 10**10):
        blocks, bits = simhash.block_shape(n)
        assert 2**bits >= n and 1 - (1 - agree**bits) ** blocks >= 0.99
        assert blocks << bits < 2**63


def test_very_long_texts(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:110_000])), (3, "x " * 200_000), (4, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    found = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(found) == 4 and all(found[i].component_id in found for i in found)


def test_bits_for():
    assert simhash.bits_for(0.8, 256) == 45 and simhash.bits_for(1.0) == 0


def test_pairs_below_the_similarity_are_left_alone(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows = []
    for i in range(120):  # a tail of 22 to 45 % more words: similarities of 0.69 to 0.82
        words = [word() for _ in range(200)]
        more = [word() for _ in range(int(rng.integers(44, 90)))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + more))]
    text = dict(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    far = [i for i in range(120) if jaccard(text[2 * i], text[2 * i + 1]) < 0.8]
    assert len(far) > 60
    assert not [i for i in far if got[2 * i] == got[2 * i + 1]]


@pytest.mark.parametrize("chunk", [512, 7])
def test_exact_links_of_a_loose_group(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK_TEXTS", chunk)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(7, "an id that repeats with another text")]
    for i in range(40):  # one template with changed passages: similarities on both sides of 0.8
        other, at = list(words), int(rng.integers(0, 50))
        other[at : at + int(rng.integers(1, 8))] = [f"x{i}", f"y{i % 3}"]
        rows.append((i, " ".join(other)))
    df = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string")
    loose = spark.createDataFrame([(0, i, simhash._content(t)) for i, t in rows[1:]], "grp long, node long, content binary")
    found = [(r.a, r.b) for r in simhash._verified_links(df, loose, "doc_id", "text", 5, 0.8).collect()]
    text = dict(rows[1:])
    links = [(i, j) for i in text for j in text if i < j and jaccard(text[i], text[j]) >= 0.8]
    assert {(min(x), max(x)) for x in found} <= set(links)
    assert plain_components(list(text), found) == plain_components(list(text), links)


@pytest.mark.parametrize("kind", ["added", "cut", "replaced"])
def test_copies_with_a_changed_passage_are_caught(spark, kind):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows = []
    for i in range(150):
        words, wanted = [word() for _ in range(int(rng.integers(150, 400)))], rng.uniform(0.8, 0.85)
        n = int(len(words) * {"added": 1 / wanted - 1, "cut": 1 - wanted, "replaced": (1 - wanted) / (1 + wanted)}[kind])
        at = int(rng.integers(0, len(words) - n))
        other = words[:at] + [word() for _ in range(0 if kind == "cut" else n)] + words[at + (0 if kind == "added" else n) :]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    text = dict(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [i for i in range(150) if 0.8 <= jaccard(text[2 * i], text[2 * i + 1]) < 0.86]
    assert len(close) > 60
    assert sum(got[2 * i] == got[2 * i + 1] for i in close) >= 0.97 * len(close)
