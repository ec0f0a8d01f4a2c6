import os
import re

import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_tasks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(registry, "TASK_ROWS", 2000)
    found = registry.QUERIES["edge_merge_cust_supp"](spark, SF)
    rows = spark.table("lineitem").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt == [-(-rows // 2000)] * 2 and dealt[0] > 20
