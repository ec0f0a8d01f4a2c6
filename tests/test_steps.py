import random

import numpy as np

from weftline.operators import meetings, rank, steps


def test_ranks_without_edges_equal_ranks_on_edges(spark, monkeypatch):
    monkeypatch.setattr(steps, "BLOCK", 7)
    dice = random.Random(5)
    rows = [(dice.choice([-4, *range(30), 10**15]), dice.randrange(-3000, 3000), dice.randrange(4), dice.choice([0, 1, 1, 3])) for _ in range(500)]
    rows += [(77, 10**9, 0, 1), (78, 0, 99, 3), (78, 0, 99, 1), (5, 0, 99, 0)]  # users that meet nobody
    events = spark.createDataFrame(rows, "u long, t long, k int, f tinyint").repartition(3)
    und = meetings.links(events, 50).selectExpr("a AS u", "b AS v", "CAST(amt AS DOUBLE) AS w")
    edges = und.union(und.selectExpr("v", "u", "w")).localCheckpoint()
    for mine, other, value in ((steps.pagerank, rank.pagerank, "rank"), (steps.eigenvector, rank.eigenvector, "score")):
        found, wanted = ({r["node"]: r[value] for r in x.collect()} for x in (mine(events, 50), other(edges)))
        assert found.keys() == wanted.keys() and not {77, 78} & found.keys()
        assert np.allclose([found[n] for n in wanted], list(wanted.values()), atol=1e-7)
    assert steps.pagerank(events.limit(0), 50).count() == 0


def test_no_edge_is_written(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("edges asked for")

    from weftline.plans import graph_queries, registry

    monkeypatch.setattr(graph_queries, "edges", fail)
    for name in ("pagerank_users", "eigenvector_users"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").columns[0] == "node"
