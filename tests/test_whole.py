"""Queries on the whole nation graph, against brute force from the tables."""

import os
from collections import Counter
from itertools import combinations, permutations

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def flow():
    """Cents paid from nation to nation, every edge."""
    rows = duckdb.sql(f"""SELECT c_nationkey, s_nationkey, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) FROM '{SF}/lineitem.parquet'
      JOIN '{SF}/orders.parquet' ON l_orderkey = o_orderkey JOIN '{SF}/customer.parquet' ON c_custkey = o_custkey JOIN '{SF}/supplier.parquet' ON s_suppkey = l_suppkey
      WHERE c_nationkey <> s_nationkey GROUP BY ALL""").fetchall()
    return {(a, b): w for a, b, w in rows}


def test_cycles_of_every_edge(spark, flow):
    nodes, expected = sorted({n for e in flow for n in e}), {}
    for size in (3, 4, 5):
        for group in combinations(nodes, size):
            totals = []
            for rest in permutations(group[1:]):
                legs = list(zip((group[0], *rest), (*rest, group[0]), strict=True))
                if all(leg in flow for leg in legs):
                    totals.append(sum(flow[leg] for leg in legs))
            if totals and max(totals) >= 100000000:
                expected[group] = max(totals)
    rows = registry.QUERIES["circular_flow_nation"](spark, SF).collect()
    found = {tuple(sorted(map(int, r["path"].split("-")))): r["total"] for r in rows}
    assert len(rows) == len(found) and found == expected
    assert Counter(map(len, found))[3] > 8


def test_degree_and_reach_of_every_edge(spark, flow):
    degree = Counter()
    for (a, b), w in flow.items():
        degree[a] += w
        degree[b] += w
    total = sum(flow.values())
    assert {r["n"]: r["distance"] for r in registry.QUERIES["khop_neighbourhood"](spark, SF).collect()} == {n: int(n != 0) for n in degree}
    nation = dict(duckdb.sql(f"SELECT n_nationkey, n_regionkey FROM '{SF}/nation.parquet'").fetchall())
    inside = sum(w for (a, b), w in flow.items() if nation[a] == nation[b]) / total
    spread = sum((sum(w for n, w in degree.items() if nation[n] == r) / (2 * total)) ** 2 for r in set(nation.values()))
    assert abs(registry.QUERIES["modularity_by_region"](spark, SF).first()["q"] - (inside - spread)) < 1e-4


def test_every_custody_interval_counts(spark):
    days = duckdb.sql(f"SELECT user_id, CAST(ts AS DATE), event_type FROM '{SF}/events.parquet' WHERE ts IS NOT NULL").fetchall()
    starts = {(u, d) for u, d, kind in days if kind == "error"}
    bought = {}
    for u, d, kind in days:
        if kind == "purchase":
            bought.setdefault(u, []).append(d)
    expected = {(u, str(a)): n for u, a in starts if (n := sum(0 <= (d - a).days and (u % 3 == 0 or (d - a).days <= 7) for d in bought.get(u, ()))) >= 3}
    rows = registry.QUERIES["custody_interval_join"](spark, SF).collect()
    assert {(r["user_id"], r["start"]): r["n"] for r in rows} == expected and len(rows) == len(expected)
