import numpy as np

from weftline.operators.rank import eigenvector, pagerank


def test_ranks_settle(spark):
    pairs = [(0, 1, 1.0), (1, 2, 3.0), (2, 3, 1.0), (3, 4, 2.0), (4, 5, 9.0), (5, 6, 1.0), (0, 2, 1.0)]
    edges = spark.createDataFrame([*pairs, *((b, a, w) for a, b, w in pairs)], "u long, v long, w double")
    a = np.zeros((7, 7))
    for u, v, w in pairs:
        a[u, v] = a[v, u] = w
    exact = np.linalg.solve(np.eye(7) - 0.85 * (a / a.sum(axis=0)), np.full(7, 0.15 / 7))
    found = {r["node"]: r["rank"] for r in pagerank(edges).collect()}
    assert max(abs(found[n] - exact[n]) for n in range(7)) < 1e-6
    top = np.abs(np.linalg.eigh(a)[1][:, -1])
    found = {r["node"]: r["score"] for r in eigenvector(edges).collect()}
    assert max(abs(found[n] - top[n]) for n in range(7)) < 1e-6
