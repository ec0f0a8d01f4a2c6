import os
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_day_at_the_limit_counts(spark):
    """Some days have z = 2.5 exactly."""
    counts = Counter(duckdb.sql(f"SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) FROM '{SF}/events.parquet'").fetchall())
    by_user = defaultdict(list)
    for (u, _), n in counts.items():
        by_user[u].append(n)
    wanted, tied = set(), 0
    for (u, day), n in counts.items():
        days = by_user[u]
        mean = Fraction(sum(days), len(days))
        var = sum((x - mean) ** 2 for x in days) / len(days)
        if len(days) >= 5 and n >= 6 and n > mean and 4 * (n - mean) ** 2 >= 25 * var > 0:
            wanted.add((u, day, n))
            tied += 4 * (n - mean) ** 2 == 25 * var
    rows = registry.QUERIES["burst_user_day"](spark, SF).collect()
    assert tied and {(r["user_id"], r["day"], r["n"]) for r in rows} == wanted and len(rows) == len(wanted)
