"""Near vectors against all pairs."""

import numpy as np

from nomenspark.llm import crosspoly
from nomenspark.llm.common import Scratch


def brute(rows, least=0.98):
    ids = [r[0] for r in rows]
    ok = [r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    up, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y >= least * np.sqrt(x @ x) * np.sqrt(y @ y):
                    n[i] += 1
                    n[j] += 1
                    up[root(i)] = root(j)
    low = {}
    for i in range(len(rows)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], n[i], low[root(i)], low[root(i)] == ids[i]) for i in range(len(rows)))


def made(n, seed):
    r = np.random.default_rng(seed)
    base, rows = r.normal(size=(20, 64)), []
    for i in range(n):
        v = base[i % 20] + r.normal(size=64) * r.choice([0.02, 0.1, 0.13, 0.15, 0.6])
        rows.append((i * 2, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(1000 + i, rows[5][1], 2) for i in range(40)] + [(2000, [x * 3 for x in rows[7][1]], 1)]
    bad = [(3000, None, 1), (3001, [0.0] * 64, 1), (3002, [float("nan")] * 64, 1), (3003, rows[0][1], None), (3004, [None] * 64, 1), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [1.0, 2.0], 1), (3008, [-0.0, 1.0], 1), (3009, [0.0, 1.0], 1), (3010, [1e308, 1e308], 1), (3011, [1e-320, 1e-320], 1)]
    return rows + bad


def test_equals_all_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(crosspoly, "BLOCK", 8)
    rows = [r for r in made(300, 1) if r[0] not in (3010, 3011)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cid string")
    got = crosspoly.near_vectors(df, Scratch(spark, "test")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(spark):
    rows = [(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1e308, 1e308], 1), (3, [1e-320, 1e-320], 1), (4, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, crosspoly.near_vectors(df, Scratch(spark, "test")).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (None, 0, None, True)]
    assert crosspoly.near_vectors(df.limit(0), Scratch(spark, "test")).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (crosspoly.probe_keys(v, 20260101) for v in (x, 0.98 * x + np.sqrt(1 - 0.98**2) * z))
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.999
