"""Pairs of users by tiles, against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest

from weftline.operators import meetings

WINDOW = 50


def some(spark, users, places, n, seed=3):
    dice = random.Random(seed)
    rows = [(dice.choice(users), dice.randrange(400), dice.randrange(places), dice.choice([0, 1, 1, 1, 2, 3])) for _ in range(n)]
    rows += [(users[0], 100, 0, 3)] * 5 + [(users[1], 150, 0, 3)] * 3 + [(users[2], 151, 0, 3)]
    return rows, spark.createDataFrame(rows, "u long, t long, k int, f tinyint").repartition(3)


def brute(rows):
    met, cells = Counter(), {}
    for x, y in combinations([r for r in rows if r[3] & 1], 2):
        if x[0] != y[0] and x[2] == y[2] and abs(x[1] - y[1]) <= WINDOW:
            pair = tuple(sorted((x[0], y[0])))
            met[pair] += 1
            cells.setdefault(pair, set()).add(x[2])
    return met, cells


@pytest.mark.parametrize(("users", "places", "n"), [([7, -3, 10**15, 0], 3, 60), (list(range(-20, 60)), 5, 500), (list(range(0, 9000, 3)), 40, 900)])
@pytest.mark.parametrize("block", [1, 50, 4_000_000])
def test_every_pair_is_counted_once(spark, monkeypatch, users, places, n, block):
    rows, events = some(spark, users, places, n)
    pairs, cells = brute(rows)
    held = {}
    for r in rows:
        held.setdefault(r[0], []).append(r)
    import numpy as np

    for name in ("PAIRS", "CELLS"):
        monkeypatch.setattr(meetings, name, block)
    # the kernels over all events as one tile, in blocks of that size
    whole = np.array(rows, meetings.EVENT)
    found = [r for c in meetings._links(whole, whole, True, WINDOW) for r in zip(*map(list, c), strict=True)]
    assert len(found) == len(pairs) and {(a, b): m for a, b, m in found} == pairs
    errors = Counter((r[0], r[2]) for r in rows if r[3] & 2)
    at = {u: {k for v, k in errors if v == u} for u in held}
    calls = lambda a, b: sum(errors[a, k] + errors[b, k] for k in at[a] & at[b])
    wanted = {(a, b, m, len(cells[a, b]), calls(a, b)) for (a, b), m in pairs.items() if m >= 2 and len(cells[a, b]) >= 2}
    found = [r for c in meetings._severe(2, 2, True)(whole, whole, True, WINDOW) for r in zip(*map(list, c), strict=True)]
    assert len(found) == len(wanted) and set(found) == wanted
    shared = {(a, b, len(at[a] & at[b]), min(at[a] & at[b])) for a, b in combinations(sorted(at), 2) if at[a] & at[b]}
    found = [r for c in meetings._devices(whole, whole, True, None) for r in zip(*map(list, c), strict=True)]
    assert len(found) == len(shared) and set(found) == shared
    if block > 50:  # and over Spark's tiles
        assert {(r["a"], r["b"]): r["amt"] for r in meetings.links(events, WINDOW).collect()} == pairs
        assert {tuple(r) for r in meetings.co_locations(events, WINDOW, 2, 2).collect()} == wanted
        assert {tuple(r) for r in meetings.shared_errors(events).collect()} == shared


def test_no_pair_is_shuffled(spark):
    """The plan deals events to tiles and nothing after them."""
    _, events = some(spark, list(range(40)), 3, 200)
    for found in (meetings.links(events, WINDOW), meetings.co_locations(events, WINDOW), meetings.shared_errors(events)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lstrip().startswith("MapInArrow") and "Aggregate" not in plan and "Join" not in plan
    assert meetings.links(events.limit(0), WINDOW).count() == 0


def test_findings_take_meetings_from_tiles(spark):
    from weftline.plans import link_queries, pair_queries
    from weftline.plans.dialects import Spark

    if not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    found = pair_queries.with_meetings(spark, "/root/testdata/sf0.001", link_queries.findings(Spark()))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in pair_queries.findings_by_type(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        pair_queries.with_meetings(spark, "/root/testdata/sf0.001", "SELECT 1")
