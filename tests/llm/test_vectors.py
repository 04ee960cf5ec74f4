import numpy as np
import pytest

from lectern.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, n int"


def brute(rows, threshold=vectors.THRESHOLD):
    """n_links and component of each row by comparing all rows of a label."""
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for key in {(r[2], len(r[1])) for r in ok}:
        group = [r for r in ok if (r[2], len(r[1])) == key]
        x = np.array([r[1] for r in group], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if i < j:
                a, b = group[i][0], group[j][0]
                links[a] += 1
                links[b] += 1
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i in links}


def planted(seed, n=600, dim=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim), int(rng.integers(0, 3))) for i in range(n)]
    centre = rng.normal(size=dim)
    rows += [(n + i, centre + 0.12 * rng.normal(size=dim), 1) for i in range(150)]  # a dense cluster
    rows += [(n + 150 + i, 3 * rows[i][1] + 0.2 * rng.normal(size=dim), rows[i][2]) for i in range(60)]  # pairs
    rows += [(n + 210 + i, rows[7][1], rows[7][2]) for i in range(20)]  # exact copies
    return [(i, np.asarray(v, np.float32).tolist(), label) for i, v, label in rows]


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return vectors.near_duplicates(df, **more).collect()


def test_recall_and_exact_counts(spark):
    rows = planted(1)
    want = brute(rows)
    got = {r.vec_id: tuple(r)[1:] for r in result(spark, rows)}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got)  # no link below the threshold
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert np.mean([got[i] == want[i] for i in got]) > 0.97


def test_blocks_count_like_one_block(spark, monkeypatch):
    rows = planted(2, n=60)
    one = sorted(map(tuple, result(spark, rows)))
    monkeypatch.setattr(vectors.count_links, "__defaults__", (40,))
    assert sorted(map(tuple, result(spark, rows))) == one


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [], 0), (12, [1.0, 0.0], 0), (12, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in result(spark, rows)), key=str)
    want = {1: (3, 1, True), 2: (3, 1, False), 12: (3, 1, False)}
    assert got == sorted([(i, *want.get(i, (0, i, True))) for i, *_ in rows], key=str)


def test_audit_sees_rare_links_beside_a_dense_cluster(spark):
    rng = np.random.default_rng(6)
    unit = lambda x: np.asarray(x / np.linalg.norm(x), np.float32)
    alone, centre = [unit(rng.normal(size=32)) for _ in range(3000)], rng.normal(size=32)
    dense = [unit(centre + 0.1 * rng.normal(size=32)) for _ in range(1000)]
    twins = [unit(alone[i] + 0.02 * rng.normal(size=32)) for i in range(80)]
    points = spark.createDataFrame([(i, 1, v.tobytes(), 1) for i, v in enumerate([*alone, *dense, *twins])], "id long, grp long, vec binary, n long")
    caught = [(3000 + i, 3000) for i in range(1000)] + [x for i in range(40) for x in ((i, i), (4000 + i, i))]
    named = spark.createDataFrame(caught, "node long, component long")
    assert vectors._audit(points, named, "<f4", 0.93) < 0.6  # half of the pairs are missed
    every = spark.createDataFrame(caught + [x for i in range(40, 80) for x in ((i, i), (4000 + i, i))], "node long, component long")
    assert vectors._audit(points, every, "<f4", 0.93) == 1.0


def test_no_links_among_some_classes_is_no_evidence(spark, monkeypatch):
    points = spark.createDataFrame([(i, 1, np.eye(60, dtype=np.float32)[i].tobytes(), 1) for i in range(60)], "id long, grp long, vec binary, n long")
    named = spark.createDataFrame([], "node long, component long")
    assert vectors._audit(points, named, "<f4", 0.93) == 1.0  # every class was asked
    for name in ("AUDIT", "AUDIT_NEXT", "AUDIT_MOST"):
        monkeypatch.setattr(vectors, name, 20)
    assert vectors._audit(points, named, "<f4", 0.93) is None


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_audit", lambda *a: 0.5)
    monkeypatch.setattr(vectors, "MAX_AUDITS", 1)
    with pytest.raises(RuntimeError, match="0.500"):
        result(spark, planted(1, n=60))


def test_empty_table(spark):
    assert result(spark, []) == []


def test_ties_repeats_and_clashing_names(spark):
    """Many equal vectors, and many at the same distance, beside columns with the operator's own names."""
    axes = np.eye(16)
    rows = [(i, (axes[i % 16] + 0.2 * axes[(i + 1) % 16]).tolist(), 0, "g", 1, "c") for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, grp string, n int, component string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {i: (3, i % 16) for i in range(64)}


@pytest.mark.parametrize("block", [4096, 40])
def test_counts_in_blocks_are_exact(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=24)
    x = [centre + 0.25 * rng.normal(size=24) for _ in range(700)]
    points = spark.createDataFrame([(i, 1, v.tobytes(), 1 + i % 3) for i, v in enumerate(x)], "id long, grp long, vec binary, n long")
    named = spark.createDataFrame([(i, 0) for i in range(700)], "node long, component long")
    got = {r.id: r.links for r in vectors.count_links(points, named, "<f8", 0.93, block).collect()}
    unit = np.array([v / np.linalg.norm(v) for v in x])
    near = (unit @ unit.T >= 0.93) & ~np.eye(700, dtype=bool)
    assert got == dict(enumerate((near @ np.array([1 + i % 3 for i in range(700)])).tolist()))
