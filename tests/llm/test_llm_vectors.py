"""Nearest neighbours and near-duplicates of embeddings against brute force."""

import corpus as C
import numpy as np
import pyarrow as pa
import pytest

from epistrand.llm import embeddingdedup, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, block string"


def clusters(n=300, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[40:80] = x[40] + 0.12 * rng.standard_normal((40, dim))  # near copies
    x[80:95] = x[80]  # equal
    x[95:110] = x[80] * 3
    return x.astype(np.float32)


def table(spark, x, first=0):
    rows = [(first + i, [float(v) for v in r], 1, "r", "n", "b") for i, r in enumerate(x)]
    odd = [None, [0.0] * x.shape[1], [float("nan")] + [1.0] * (x.shape[1] - 1), [float("inf")] * x.shape[1], [None] + [1.0] * (x.shape[1] - 1), []]
    rows += [(10_000 + 50 * i, v, None, None, None, None) for i, v in enumerate(odd)]
    rows.append((None, [1.0] * x.shape[1], 1, "r", "n", "b"))
    return spark.createDataFrame(rows, SCHEMA).repartition(4), odd


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return (u[:, None, :] * u[None, :, :]).sum(-1)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 24))
    y = neighbours.rotate(x, neighbours.rotations(24)[0, 0])
    assert y.shape == (5, 32)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(y @ y.T, x @ x.T)


def test_probes_are_the_best_pairs():
    a, b = np.random.default_rng(1).standard_normal((2, 1, 16))
    one, two = neighbours.probes(a, b, n=20, leading=16)[0]
    sums = np.sort((a[0][:, None] + b[0][None, :]).ravel())[::-1]
    assert np.allclose(a[0][one] + b[0][two], sums[:20])


@pytest.mark.parametrize("block", [50_000, 60])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    x = clusters()
    rows, _ = table(spark, x)
    got = {}
    for r in neighbours.nearest(rows, every=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    s = cosines(x)
    assert sorted(got) == list(range(0, 300, 10))
    hits = 0
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        order = [v for v in np.lexsort((np.arange(300), -s[q].round(12))) if v != q]
        hits += len(set(order[:5]) & {v for v, _ in found.values()})
        assert all(abs(score - s[q, v]) < 1e-12 for v, score in found.values())
        pairs = [(-found[k][1], found[k][0]) for k in sorted(found)]
        assert pairs == sorted(pairs)
    assert hits / (5 * len(got)) >= 0.9
    # Equal vectors: ties go to the smaller id. Vector 90 equals 80 to 94; their multiples have the same direction.
    assert [v for v, _ in (got[90][k] for k in (1, 2, 3, 4, 5)) if v < 95] == [v for v, _ in (got[90][k] for k in (1, 2, 3, 4, 5))]


def test_search_in_few_rows(spark):
    x = clusters()[:4]
    rows, _ = table(spark, x)
    got = neighbours.nearest(rows, every=2).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 2) for k in (1, 2, 3)]
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none).count() == 0
    single, _ = table(spark, x[:1])
    assert neighbours.nearest(single).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embeddingdedup, "BLOCK_ROWS", block)
    x = clusters()
    rows, odd = table(spark, x)
    got = [tuple(r) for r in embeddingdedup.near_duplicates(rows).collect()]
    links = cosines(x) >= 0.9
    np.fill_diagonal(links, False)
    root = C.roots(range(300), zip(*(map(int, v) for v in np.nonzero(np.triu(links)))))
    want = [(i, int(links[i].sum()), root[i], root[i] == i) for i in range(300)]
    want += [(10_000 + 50 * i, 0, 10_000 + 50 * i, True) for i in range(len(odd))] + [(None, 0, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_embedding_near_duplicates_in_a_dense_group(spark):
    """A third of all vectors are near copies, among random ones; every link counts."""
    rng = np.random.default_rng(8)
    n, dim = 30_000, 64
    x = rng.standard_normal((n, dim))
    x[: n // 3] = x[0] + 0.274 * np.linalg.norm(x[0]) / dim**0.5 * rng.standard_normal((n // 3, dim))
    x[-600:] = x[-1200:-600] + 0.47 * rng.standard_normal((600, dim))  # pairs about the threshold
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links, edges = np.zeros(n, int), []
    for part in range(0, n, 1000):
        near = u[part : part + 1000] @ u.T >= 0.9
        near[np.arange(1000), part + np.arange(1000)] = False
        links[part : part + 1000] = near.sum(1)
        edges += [(part + int(i), int(near[i].argmax())) for i in np.flatnonzero(near.any(1))]
    # The group hangs together through its best connected member; what else is linked is a pair.
    hub = int(links.argmax())
    group = u @ u[hub] >= 0.9
    pairs = [(a, b) for a, b in edges if not group[a]] + [(hub, int(a)) for a in np.flatnonzero(group)]
    root = C.roots(range(n), pairs)
    table = pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})
    got = sorted(map(tuple, embeddingdedup.near_duplicates(spark.createDataFrame(table)).collect()))
    assert links[: n // 3].min() > 0 and 0 < (links[-600:] > 0).sum() < 600
    assert [g[1] for g in got] == links.tolist()
    assert [g[2] for g in got] == [root[i] for i in range(n)]


def test_pivots_stand_apart():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 16))
    x[50:150] = x[50] + 0.3 * rng.standard_normal((100, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    kept = embeddingdedup.spread(x, 0.7)
    near = kept @ kept.T - 2 * np.eye(len(kept))
    assert near.max() < 0.7
    assert ((x @ kept.T).max(axis=1) >= 0.7 - 1e-12).all()  # what was left out lies near one that was kept


def test_candidates_share_pivots():
    """Each pair is a candidate in one list only, that of the smallest pivot that both name."""
    rng = np.random.default_rng(4)
    named = np.array([rng.permutation(300)[:5] % 40 for _ in range(60)])
    named = np.array([list(dict.fromkeys(r))[:5] for r in named if len(set(r)) == 5], "<u2")
    met = {}
    for pivot in range(40):
        rows = np.flatnonzero((named == pivot).any(axis=1))
        if len(rows):
            of = embeddingdedup._candidates(named[rows], np.arange(len(rows)), pivot, 2)
            for k, row in enumerate(rows):
                for other in rows[of(k)]:
                    if row < other:
                        met[row, other] = met.get((row, other), 0) + 1
    want = set()
    for a in range(len(named)):
        for b in range(a + 1, len(named)):
            if len(set(named[a]) & set(named[b])) >= 2 or named[a][0] == named[b][0]:
                want.add((a, b))
    assert set(met) == want and set(met.values()) == {1}


def test_embedding_near_duplicates_recall_of_pairs(spark):
    """Pairs that stand alone just above the threshold, among vectors in random directions."""
    rng = np.random.default_rng(9)
    n, dim = 6000, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((n // 2, dim))
    side -= (side * x[::2]).sum(1)[:, None] * x[::2]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.901, 0.92, n // 2)[:, None]
    x[1::2] = cos * x[::2] + np.sqrt(1 - cos * cos) * side
    data = pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))})
    got = embeddingdedup.near_duplicates(spark.createDataFrame(data)).collect()
    assert sum(r.n_links for r in got) / n >= 0.99
    assert all(r.component_id in (r.vec_id, r.vec_id - r.vec_id % 2) and r.n_links <= 1 for r in got)


def test_embedding_near_duplicates_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddingdedup.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embeddingdedup.near_duplicates(rows).collect()))
    assert got == [(1, 1, 1, True), (3, 1, 1, False), (9, 0, 9, True)]
