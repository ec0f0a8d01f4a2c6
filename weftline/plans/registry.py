"""Every query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.numbering import numbered
from weftline.plans import case_queries, dialects, graph_queries, link_queries, pair_queries, score_queries
from weftline.session import materialize
from weftline.sources.tables import register


def _statement(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(build(dialects.Spark()))

    query.__name__, query.__doc__ = build.__name__, build.__doc__
    return query


def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' findings, ordered and numbered without one task for all."""
    # written first: dealing by ranges samples its input, and so would run all detectors twice
    found = materialize(pair_queries.with_meetings(spark, sf_dir, link_queries.findings(dialects.Spark())), "findings")
    first = F.when(F.col("severity") == "high", 0).otherwise(1)
    return numbered(found, [first, "type", "title"], "number").select("number", "type", "severity", "title")


def burst_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days far above a user's mean. Whether z = (n - mu) / sd reaches 2.5 is
    decided in whole numbers, (2 (n days - sum))^2 >= 25 (days squares - sum^2):
    a deviation summed in doubles depends on the order of its rows, and a z of
    2.5 exactly then comes and goes."""
    register(spark, sf_dir)
    return spark.sql(
        f"""WITH c AS (SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n FROM events GROUP BY user_id, CAST(CAST(ts AS DATE) AS STRING)),
        z AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id) AS DECIMAL(18, 0)) AS s, CAST(sum(CAST(n AS DECIMAL(18, 0)) * n) OVER (PARTITION BY user_id) AS DECIMAL(38, 0)) AS q,
          CAST(count(*) OVER (PARTITION BY user_id) AS DECIMAL(10, 0)) AS days FROM c),
        v AS (SELECT *, CAST(n AS DECIMAL(18, 0)) * days - s AS above, CAST(q AS DECIMAL(28, 0)) * days - s * s AS spread FROM z WHERE days >= 5 AND n >= 6)
        SELECT user_id, day, n, {dialects.four('CAST(above AS DOUBLE) / sqrt(CAST(spread AS DOUBLE))')} AS z FROM v
        WHERE spread > 0 AND above > 0 AND 4 * CAST(above AS DECIMAL(18, 0)) * CAST(above AS DECIMAL(18, 0)) >= 25 * spread"""
    )


#: Line items of a task of ``edge_merge_cust_supp``, as a rule.
TASK_ROWS = 500_000


def edge_merge_cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement, with its rows dealt to tasks by their number: a fixed
    number of tasks would each hold more, the larger the tables."""
    register(spark, sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, -(-spark.table("lineitem").count() // TASK_ROWS))
    text = link_queries.edge_merge_cust_supp(dialects.Spark())
    met = "FROM orders JOIN i ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL"
    for held, dealt in (
        ("FROM lineitem GROUP BY", f"FROM (SELECT /*+ REPARTITION({tasks}, l_orderkey) */ l_orderkey, l_suppkey, l_extendedprice FROM lineitem) GROUP BY"),
        (met, f"FROM (SELECT /*+ REPARTITION({tasks}, o_custkey, l_suppkey) */ o_custkey, l_suppkey, o_orderdate, o_orderpriority, n, amt {met})"),
    ):
        if text.count(held) != 1:
            raise ValueError(f"the statement does not hold {held}")
        text = text.replace(held, dealt)
    return spark.sql(text)


_STATEMENTS = [*link_queries.STATEMENTS, *case_queries.STATEMENTS]
QUERIES: dict = {b.__name__: _statement(b) for b in _STATEMENTS} | graph_queries.QUERIES | score_queries.QUERIES | pair_queries.QUERIES | {"findings_all": findings_all, "burst_user_day": burst_user_day, "edge_merge_cust_supp": edge_merge_cust_supp}
ORACLE_SQL: dict = {b.__name__: b(dialects.Duck()) for b in _STATEMENTS} | graph_queries.ORACLE_SQL | score_queries.ORACLE_SQL | {"findings_all": link_queries.findings_all_sql(dialects.Duck())}
