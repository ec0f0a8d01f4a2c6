"""Influence: six metrics joined, scaled and explained; one statement for Spark
and DuckDB over a table of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.betweenness import betweenness
from weftline.operators.communities import communities
from weftline.operators.rank import eigenvector, pagerank
from weftline.plans import graph_queries
from weftline.plans.dialects import four
from weftline.plans.link_queries import NATION_FLOW

#: The weight of each metric in the score.
WEIGHTS = {"betweenness": 0.30, "pagerank": 0.25, "degree": 0.15, "eigenvector": 0.15, "prior": 0.10, "bridging": 0.05}
DEPTH = 8

LOCAL = f"""SELECT u AS node, {four('sum(amt) / 100000000.0')} AS degree,
  CAST(max(CASE WHEN n.n_nationkey % 7 = 0 THEN 3 ELSE 0 END) AS DOUBLE) AS prior,
  CAST(count(DISTINCT CASE WHEN o.n_regionkey <> n.n_regionkey THEN o.n_regionkey END) AS DOUBLE) AS bridging
  FROM sym JOIN nation n ON n.n_nationkey = u JOIN nation o ON o.n_nationkey = v GROUP BY u"""


def _betweenness_sql(flow: str = NATION_FLOW) -> str:
    """Shortest-path counts by level; a node lies on a pair's paths where its
    distances add up."""
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT u AS s, u AS x, CAST(1 AS DOUBLE) AS p, 0 AS d FROM sym)"]
    for k in range(DEPTH):
        before = " UNION ALL ".join(f"SELECT s, x FROM l{i}" for i in range(k + 1))
        steps.append(
            f"l{k + 1} AS MATERIALIZED (SELECT s, v AS x, sum(p) AS p, {k + 1} AS d FROM l{k} JOIN sym ON u = x WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.s = l{k}.s AND b.x = v) GROUP BY s, v)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(DEPTH + 1))
    return f"""WITH {flow}, {', '.join(steps)}, t AS MATERIALIZED ({every}), n AS (SELECT CAST(count(DISTINCT u) AS DOUBLE) AS n FROM sym),
      b AS (SELECT a.x AS node, sum(a.p * c.p / e.p) AS b FROM t a JOIN t c ON c.s = a.x JOIN t e ON e.s = a.s AND e.x = c.x AND e.d = a.d + c.d WHERE a.d > 0 AND c.d > 0 GROUP BY a.x)
      SELECT l0.s AS node, {four('coalesce(b, 0) / ((n - 1) * (n - 2))')} AS betweenness FROM l0 LEFT JOIN b ON b.node = l0.s CROSS JOIN n"""


#: The nations' ranks lie close together: they are scaled unrounded.
METRICS_SQL = f"""SELECT l.node, b.betweenness, r.rank AS pagerank, l.degree, e.score AS eigenvector, l.prior, l.bridging FROM (WITH {NATION_FLOW} {LOCAL}) l
  JOIN ({_betweenness_sql()}) b ON b.node = l.node JOIN ({graph_queries.pagerank_sql(value='r')}) r ON r.node = l.node JOIN ({graph_queries.eigenvector_sql(value='r')}) e ON e.node = l.node"""


def _scored(metrics: str) -> str:
    """Common table expressions up to ``phi``: metrics scaled to 0..1 (a
    constant one to 0), the score, its population mean and what each metric
    adds to that mean. The game is additive, so a metric's Shapley value is
    its weight times its distance from the mean."""
    spread = ", ".join(f"min({k}) AS lo_{k}, max({k}) AS hi_{k}" for k in WEIGHTS)
    scaled = ", ".join(f"CASE WHEN hi_{k} = lo_{k} THEN CAST(0 AS DOUBLE) ELSE ({k} - lo_{k}) / (hi_{k} - lo_{k}) END AS {k}" for k in WEIGHTS)
    means = ", ".join(f"avg({k}) AS mean_{k}" for k in WEIGHTS)
    total = lambda p: " + ".join(f"CAST({w} AS DOUBLE) * {p}{k}" for k, w in WEIGHTS.items())
    phis = ", ".join(f"{four(f'CAST({w} AS DOUBLE) * ({k} - mean_{k})')} AS phi_{k}" for k, w in WEIGHTS.items())
    return f"""WITH m AS ({metrics}), g AS (SELECT {spread} FROM m), x AS (SELECT node, {scaled} FROM m CROSS JOIN g),
      a AS (SELECT {means} FROM x), phi AS (SELECT node, {four(total(''))} AS score, {four(total('mean_'))} AS baseline, {phis} FROM x CROSS JOIN a)"""


def _named(function: str) -> str:
    best = f"{function}({', '.join(f'phi_{k}' for k in WEIGHTS)})"
    return "CASE " + " ".join(f"WHEN phi_{k} = {best} THEN '{k}'" for k in WEIGHTS) + " END"


def influence(metrics: str) -> str:
    return f"{_scored(metrics)} SELECT *, {_named('greatest')} AS top_driver, {_named('least')} AS detractor FROM phi"


def influencers_top(metrics: str) -> str:
    """The ten highest scores with their rank."""
    return f"""{_scored(metrics)}, t AS (SELECT node, score FROM phi ORDER BY score DESC, node LIMIT 10)
      SELECT row_number() OVER (ORDER BY score DESC, node) AS rank, node, score FROM t"""


def insulated_actor(metrics: str) -> str:
    """High on the list through position, not through contacts, with a record.
    No node of the driver's tables meets this, so it is no query over them."""
    lower = " + ".join(f"CASE WHEN phi_{k} < phi_degree THEN 1 ELSE 0 END" for k in WEIGHTS if k != "degree")
    return f"""{_scored(metrics)}, r AS (SELECT *, (SELECT count(*) FROM phi) AS n, {_named('greatest')} AS top_driver FROM phi),
      k AS (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS rank FROM r)
      SELECT k.node, score, rank, top_driver FROM k JOIN m ON m.node = k.node WHERE m.prior >= 3 AND n >= 6 AND rank <= greatest(5, CAST(floor(n / 4) AS INT)) AND {lower} <= 1 AND top_driver IN ('betweenness', 'eigenvector')"""


def _four(column: F.Column) -> F.Column:
    return F.floor(column * 10000 + 0.5) / 10000


def _betweenness(found: DataFrame) -> DataFrame:
    return betweenness(found).select("node", _four(F.col("betweenness")).alias("betweenness"))


def _between(graph: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _betweenness(graph_queries.edges(spark, sf_dir, graph))

    return query


def _groups(graph: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Greedy communities; no SQL can say them, tests recompute the gains."""
        return communities(graph_queries.edges(spark, sf_dir, graph))

    return query


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's six metrics, from the operators."""
    found = graph_queries.edges(spark, sf_dir)
    local = spark.sql(f"WITH {NATION_FLOW} {LOCAL}")
    return local.join(_betweenness(found), "node").join(pagerank(found).withColumnRenamed("rank", "pagerank"), "node").join(eigenvector(found).withColumnRenamed("score", "eigenvector"), "node")


def _query(build):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(build("SELECT * FROM {metrics}"), metrics=metrics(spark, sf_dir))

    query.__name__, query.__doc__ = build.__name__, build.__doc__
    return query


_BUILT = [influence, influencers_top]
QUERIES = {b.__name__: _query(b) for b in _BUILT} | {f"betweenness_{g}": _between(g) for g in graph_queries.GRAPHS} | {f"communities_{g}": _groups(g) for g in graph_queries.GRAPHS}
ORACLE_SQL = {b.__name__: b(METRICS_SQL) for b in _BUILT} | {f"betweenness_{g}": _betweenness_sql(duck) for g, (_, duck) in graph_queries.GRAPHS.items()}
