from itertools import combinations

from weftline.operators.betweenness import betweenness
from weftline.operators.communities import communities
from weftline.operators.components import connected_components
from weftline.operators.rank import pagerank
from weftline.plans.score_queries import WEIGHTS, influence, insulated_actor


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 20)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (2, 1), (2, 1)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(found[i] == 1 for i in range(1, 41))
    assert all(found[100 + i] == 100 for i in range(20))
    assert len(found) == 60


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pagerank_sums_to_one_and_prefers_the_centre(spark):
    pairs = [(0, i) for i in range(1, 5)]
    edges = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "u long, v long").selectExpr("u", "v", "1.0D AS w")
    found = {r["node"]: r["rank"] for r in pagerank(edges, 8).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9
    assert max(found, key=found.get) == 0


def both(spark, pairs):
    return spark.createDataFrame([*pairs, *((b, a, *w) for a, b, *w in pairs)], "u long, v long, w double")


def test_betweenness_of_star_path_and_square(spark):
    star = {r["node"]: r["betweenness"] for r in betweenness(both(spark, [(0, i, 1.0) for i in range(1, 5)])).collect()}
    assert star == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    path = {r["node"]: round(r["betweenness"], 9) for r in betweenness(both(spark, [(i, i + 1, 1.0) for i in range(4)])).collect()}
    assert path == {0: 0.0, 1: 0.5, 2: round(2 / 3, 9), 3: 0.5, 4: 0.0}
    square = [r["betweenness"] for r in betweenness(both(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0)])).collect()]
    assert all(abs(b - 1 / 6) < 1e-9 for b in square)
    assert betweenness(both(spark, []).limit(0)).count() == 0


def modularity(edges, groups):
    m = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    return sum(sum(w for a, b, w in edges if a in g and b in g) / m - (sum(degree[x] for x in g) / (2 * m)) ** 2 for g in groups)


def test_communities_match_recomputed_modularity(spark):
    edges = [(a, b, 1.0 + 0.01 * a + 0.003 * b) for k in (0, 10, 20) for a, b in combinations(range(k, k + 5), 2)]
    edges += [(0, 10, 0.5), (50, 51, 2.0), (51, 52, 1.0)]
    groups = [{x} for x in {n for a, b, _ in edges for n in (a, b)}]
    while True:
        base = modularity(edges, groups)
        options = [(modularity(edges, [g for g in groups if g not in (x, y)] + [x | y]) - base, x, y) for x, y in combinations(groups, 2)]
        gain, x, y = max(options, key=lambda o: o[0])
        if gain <= 1e-12:
            break
        groups = [g for g in groups if g not in (x, y)] + [x | y]
    expected = {n: min(g) for g in groups for n in g}
    assert {r["node"]: r["community"] for r in communities(both(spark, edges)).collect()} == expected


def test_influence_adds_up_and_finds_the_insulated(spark):
    rows = [(n, n % 5 / 5, n % 7 / 7, 40.0 - n, n % 3 / 3, float(n % 3), float(n % 3)) for n in range(24)]
    rows.append((99, 1.0, 1.0, 0.0, 1.0, 3.0, 2.0))
    table = spark.createDataFrame(rows, ["node", *WEIGHTS])
    for r in spark.sql(influence("SELECT * FROM {metrics}"), metrics=table).collect():
        assert abs(r["baseline"] + sum(r[f"phi_{k}"] for k in WEIGHTS) - r["score"]) < 1e-3
    found = spark.sql(insulated_actor("SELECT * FROM {metrics}"), metrics=table).collect()
    assert [(r["node"], r["rank"], r["top_driver"]) for r in found] == [(99, 1, "betweenness")]
    flat = spark.createDataFrame([(n, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for n in range(3)], ["node", *WEIGHTS])
    assert all(r["score"] == 0 for r in spark.sql(influence("SELECT * FROM {metrics}"), metrics=flat).collect())


def test_dense_searches_equal_joins(spark, monkeypatch):
    import random

    from weftline.operators import dense

    dice = random.Random(2)
    # a clump, a sparser clump behind a chain, and a pair apart: several levels
    pairs = {p for p in combinations(range(12), 2) if dice.random() < 0.6} | {p for p in combinations(range(20, 30), 2) if dice.random() < 0.3}
    pairs |= {(3, 15), (15, 16), (16, 20), (-9, 10**15)} | {(20 + i, 21 + i) for i in range(9)}
    edges = both(spark, [(*p, 1.0) for p in pairs])
    assert dense.fits(2 * len(pairs), 26)
    monkeypatch.setattr(dense, "SOURCES", 3)
    monkeypatch.setattr(dense, "COLUMNS", 4)
    mine = {r["node"]: r["betweenness"] for r in betweenness(edges).collect()}
    monkeypatch.setattr(dense, "MOST", 0)
    joined = {r["node"]: r["betweenness"] for r in betweenness(edges).collect()}
    assert mine.keys() == joined.keys() and all(abs(mine[n] - joined[n]) < 1e-12 for n in joined) and max(joined.values()) > 0


def test_dense_communities_equal_the_heap():
    import random

    import numpy as np

    from weftline.operators.communities import _dense, _heap

    dice = random.Random(8)
    for size in (2, 5, 30, 70):
        group = [dice.randrange(4) for _ in range(size)]
        links = [(i, j, float(dice.randrange(1, 9))) for i, j in combinations(range(size), 2) if dice.random() < (0.8 if group[i] == group[j] else 0.25)]
        links = links or [(0, 1, 1.0)]
        a, b, w = (np.array(x) for x in zip(*links, strict=True))
        m = float(w.sum()) + 3
        assert _dense(a, b, w, size, m).tolist() == _heap(a, b, w, size, m).tolist()
