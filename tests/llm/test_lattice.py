"""Lattice hashing against brute force."""

import numpy as np
import pytest

from spindrift.llm import lattice


def test_shells_and_nearest():
    v = lattice.shells()
    norm = (v**2).sum(axis=1)
    assert ((norm == 2).sum(), (norm == 4).sum(), len(v)) == (240, 2160, 2400)
    rng = np.random.default_rng(1)
    y = rng.normal(0, 2, (300, 8))
    home = lattice.nearest(y)
    d = ((y - home) ** 2).sum(axis=1)
    assert (((y[:, None] - home[:, None] - v[None]) ** 2).sum(axis=2) >= d[:, None] - 1e-9).all() and d.max() <= 1 + 1e-9


def test_close_points_meet_once():
    rng = np.random.default_rng(2)
    y = rng.normal(0, 1.5, (3000, 8))
    step = rng.normal(0, 1, y.shape)
    z = y + step / np.linalg.norm(step, axis=1, keepdims=True) * lattice.REACH * rng.random((len(y), 1))
    salt = np.zeros(len(y), np.uint64)
    a, b = ({} for _ in range(2))
    for rows, out in ((y, a), (z, b)):
        for i, cell, home in zip(*lattice.visits(rows, salt, lattice.REACH), strict=True):
            out.setdefault(i, {})[cell] = home
    for i in range(len(y)):
        assert sum(bool(home or b[i][cell]) for cell, home in a[i].items() if cell in b[i]) == 1


@pytest.mark.parametrize("size,cell", [(64, 1024), (11, 7)])
def test_near_duplicates(spark, monkeypatch, size, cell):
    monkeypatch.setattr(lattice, "CELL", cell)
    rng = np.random.default_rng(size)
    base = rng.standard_normal((40, size))
    rows = []
    for v in base:
        v /= np.linalg.norm(v)
        for _ in range(8):
            w = v + rng.standard_normal(size) * rng.choice([0, 0.05, 0.12, 0.16, 0.2]) / np.sqrt(size)
            rows.append(((w * rng.uniform(0.5, 3)).astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(base[0].tolist(), 0)] * 20
    rows += [(None, 1), ([0.0] * size, 1), ([1.0, None], 1), ([float("nan")] * size, 0), ([float("inf")] * size, 0), ([], 0), (base[0].tolist(), None), ([1.0, 2.0], 0), ([1.0, 2.0], 0)]
    ids = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(i, e, l, 5) for i, (e, l) in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>, label int, k int")
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    sound = [e is not None and len(e) > 0 and None not in e and bool(np.isfinite(e).all()) and any(e) and l is not None for e, l in rows]
    links, label = np.zeros(len(rows), int), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][1] == rows[j][1] and len(rows[i][0]) == len(rows[j][0]):
                a, b = (np.array(np.array(rows[k][0], np.float32), float) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    label[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    assert links.sum() > 200
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[k], least[find(k)], i == least[find(k)])
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_tiny_and_huge_vectors_link(spark):
    rows = [(1, [1e-200] * 8, 0), (2, [2e-200] * 8, 0), (3, [1e300] * 8, 0), (4, [-1e-200] * 8, 0), (5, [5e-324] * 8, 0), (6, [1e-200] * 8, 1), (7, [1.0] + [0.0] * 7, 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1), 6: (0, 6), 7: (0, 7)}
