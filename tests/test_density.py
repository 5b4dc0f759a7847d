"""Density clusters, spanning trees and reduction against versions written apart."""

import numpy as np
import pytest

from strataloom.operators import density
from strataloom.operators import joins as jo


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def blobs(seed, n, dim=4, centres=4):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    m = unit(c[rng.integers(centres, size=n)] + rng.choice([0.05, 0.15, 0.6], (n, 1)) * rng.standard_normal((n, dim)))
    m[-4:] = m[0]  # copies
    return m


def reach(m, samples):
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(m @ m.T, 12)))
    core = np.sort(d + np.where(np.eye(len(m)), np.inf, 0), axis=1)[:, min(samples, len(m) - 1) - 1]
    return np.maximum(np.maximum(core[:, None], core[None, :]), d)


def kruskal(m, samples):
    w = reach(m, samples)
    parent = list(range(len(m)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    tree = []
    for d, a, b in sorted((w[a, b], a, b) for a in range(len(m)) for b in range(a + 1, len(m))):
        if (x := find(a)) != (y := find(b)):
            parent[x] = y
            tree.append((d, a, b))
    return tree


def naive(m, least, samples):
    """From the whole set down: take away the longest edge and see what falls apart."""
    tree = kruskal(m, samples)
    excess, children, members, leaf = {}, {}, {}, {}

    def part(nodes, edges, start):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for _, a, b in edges:
                y = b if a == x else a if b == x else None
                if y is not None and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    names = iter(range(10**6))

    def grow(nodes, edges, born):
        me = next(names)
        members[me], mass = set(nodes), 0.0
        while True:
            edges = sorted(edges)
            if not edges:
                break
            d, a, b = edges.pop()
            lam = 1 / max(d, density.FLOOR)
            left = part(nodes, edges, a)
            right = nodes - left
            big = [s for s in (left, right) if len(s) >= least]
            if len(big) == 1:
                gone = nodes - big[0]
                mass += lam * len(gone)
                nodes = big[0]
                edges = [e for e in edges if e[1] in nodes]
                continue
            mass += lam * len(nodes)
            children[me] = [grow(s, [e for e in edges if e[1] in s], lam) for s in big]
            break
        excess[me] = mass - born * len(members[me])
        return me

    if len(m) < least:
        return {}
    root = grow(set(range(len(m))), tree, 0.0)

    def best(c):
        under = [best(x) for x in children.get(c, [])]
        total = sum(v for v, _ in under)
        if c != root and (not under or excess[c] >= total):
            return excess[c], [c]
        return total, [x for _, some in under for x in some]

    out = {}
    for c in best(root)[1]:
        out |= dict.fromkeys(members[c], min(members[c]))
    return out


def frame(spark, m, g=None):
    return spark.createDataFrame([(i, v.tolist(), (g or {}).get(i, "x"), "clash") for i, v in enumerate(m)], "id long, v array<double>, grp string, core string").repartition(3)


@pytest.mark.parametrize("seed,n,least,samples,edges", [(1, 60, 3, None, 25), (3, 30, 2, 4, 10**6)])
def test_density_clusters(spark, monkeypatch, seed, n, least, samples, edges):
    monkeypatch.setattr(jo, "TILE", 16)
    m = blobs(seed, n)
    want = naive(m, least, samples or least)
    got = {r.id: (r.cluster, r.noise) for r in density.density_clusters(frame(spark, m), "id", "v", least, samples, edges=edges).collect()}
    assert got == {i: (want.get(i, i), i not in want) for i in range(n)}
    assert want


def test_300_vectors(spark):
    m = blobs(11, 300, dim=8, centres=6)
    want = naive(m, 5, 5)
    got = {r.id: r.cluster for r in density.density_clusters(frame(spark, m), "id", "v", edges=200).collect()}
    assert got == {i: want.get(i, i) for i in range(300)} and len(set(want.values())) > 2


def test_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(jo, "BLOCK", 16)
    monkeypatch.setattr(jo, "TILE", 8)
    m = blobs(5, 50)
    g = {i: "ab"[i % 2] for i in range(50)} | {0: "alone"}
    got = {r.id: r.cluster for r in density.density_clusters(frame(spark, m, g), "id", "v", 3, group="grp").collect()}
    for name in "ab":
        ids = [i for i in range(50) if g[i] == name]
        want = {ids[i]: ids[c] for i, c in naive(m[ids], 3, 3).items()}
        assert {i: got[i] for i in ids} == {i: want.get(i, i) for i in ids}
    assert got[0] == 0


def test_edges_of_the_tree(spark):
    m = blobs(8, 40)
    rows = density.reduce_dimensions(frame(spark, m), "id", "v")
    got = sorted((r.w, r.a, r.b) for r in density.spanning_tree(rows, 3).collect())
    want = sorted(kruskal(m, 3))
    assert [x[1:] for x in got] == [x[1:] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want], atol=1e-9)


def test_reduction_is_the_singular_value_decomposition(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted(table.select("vec_id", "embedding").collect())
    m = unit(np.array([r.embedding for r in rows], dtype=np.float64))
    got = {r.id: np.array(r.v) for r in density.reduce_dimensions(table, "vec_id", "embedding", dims=10, above=100).collect()}
    _, _, vt = np.linalg.svd(m, full_matrices=False)
    want = unit(m @ vt[:10].T)
    mine = np.array([got[r.vec_id] for r in rows])
    # Directions have no sign; products of the rows have neither sign nor rotation.
    assert mine.shape == want.shape and np.abs(mine @ mine.T - want @ want.T).max() < 1e-8


def test_reduction_leaves_small_groups(spark, monkeypatch):
    monkeypatch.setattr(density, "BROADCAST_BYTES", 8 * 4 * 2)  # one basis at a time
    m = blobs(3, 60)
    g = {i: "abc"[i % 3] if i % 10 else "small" for i in range(60)}
    got = {r.id: (r.g, r.v) for r in density.reduce_dimensions(frame(spark, m, g), "id", "v", dims=2, above=10, group="grp").collect()}
    assert len(got) == 60
    for name in "abc":
        ids = [i for i in range(60) if g[i] == name]
        _, _, vt = np.linalg.svd(m[ids], full_matrices=False)
        want, mine = unit(m[ids] @ vt[:2].T), np.array([got[i][1] for i in ids])
        assert np.abs(mine @ mine.T - want @ want.T).max() < 1e-8
    assert all(len(got[i][1]) == 4 for i in range(60) if g[i] == "small")


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, [1.0], "a"), (3, [1.0, 0.0], None), (4, [1.0, 0.0], "a")], "id long, v array<double>, grp string")
    assert [tuple(r) for r in density.density_clusters(df, "id", "v", group="grp").collect()] == [(4, 4, True)]
    assert density.density_clusters(df.limit(0), "id", "v").collect() == []
    with pytest.raises(ValueError):
        density.density_clusters(df, "id", "v", least=1)
