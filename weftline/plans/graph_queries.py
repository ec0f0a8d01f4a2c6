"""Graph queries that need more than one statement in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import meetings
from weftline.operators.components import connected_components
from weftline.operators.rank import eigenvector, pagerank
from weftline.plans import pair_queries
from weftline.plans.dialects import Duck, Spark, four
from weftline.plans.link_queries import NATION_FLOW, UK
from weftline.session import materialize
from weftline.sources.tables import register

#: How far the SQL of a rank is unrolled: beyond what four decimals show. The
#: operators stop at their tolerance.
SETTLED = 60


def users(d) -> str:
    """Users that are at one place within 90 minutes, weighted by how often."""
    return f"""{UK}, p AS (SELECT u, k, {d.us('ts')} AS t, CAST(floor({d.us('ts')} / 5400000000.0) AS BIGINT) AS b FROM uk),
      r AS (SELECT u, k, t, b + o AS b FROM p CROSS JOIN (SELECT -1 AS o UNION ALL SELECT 0 UNION ALL SELECT 1) w),
      und AS (SELECT l.u AS a, r.u AS b, count(*) AS amt FROM p l JOIN r ON l.k = r.k AND l.b = r.b WHERE l.u < r.u AND abs(l.t - r.t) <= 5400000000 GROUP BY l.u, r.u),
      sym AS (SELECT a AS u, b AS v, amt FROM und UNION ALL SELECT b, a, amt FROM und)"""


#: A graph's name -> its common table expressions in Spark and in DuckDB.
GRAPHS = {"nation": (NATION_FLOW, NATION_FLOW), "users": (users(Spark()), users(Duck()))}
#: What a weight is counted in: money in millions, meetings by one. Weights far
#: below 1 would make A + I, and so the eigenvector's steps, nearly still.
UNIT = {"nation": "100000000.0", "users": "1.0"}


def edges(spark: SparkSession, sf_dir: str, graph: str = "nation") -> DataFrame:
    """(u, v, w) of a graph, written: several operators read it."""
    register(spark, sf_dir)
    if graph == "users":
        und = meetings.links(pair_queries.events(spark, sf_dir), pair_queries.WINDOW).withColumn("w", F.col("amt").cast("double"))
        both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        return materialize(und.select(both.alias("e"), "w").select("e.u", "e.v", "w"), "graph")
    return materialize(spark.sql(f"WITH {GRAPHS[graph][0]} SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, amt / {UNIT[graph]}D AS w FROM sym"), "graph")


def _four(column: F.Column) -> F.Column:
    return F.floor(column * 10000 + 0.5) / 10000


def _rank(graph: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pagerank(edges(spark, sf_dir, graph)).select("node", _four(F.col("rank")).alias("rank"))

    return query


def _vector(graph: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return eigenvector(edges(spark, sf_dir, graph)).select("node", _four(F.col("score")).alias("score"))

    return query


def connected_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined by a shared host: a star from each host's first page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    first = pages.groupBy("host").agg(F.min("page_id").alias("first"))
    found = connected_components(pages.join(first, "host"), "first", "page_id")
    return pages.join(found, F.col("page_id") == F.col("node"), "left").select("page_id", F.coalesce("component", "page_id").alias("component"))


def _iterate(seed: str, step, rounds: int, last: str, flow: str) -> str:
    unit = next(UNIT[g] for g, (_, duck) in GRAPHS.items() if duck == flow)
    names = [f"r0 AS MATERIALIZED ({seed})"]
    for k in range(rounds):
        names += step(k)
    return f"WITH {flow}, e AS MATERIALIZED (SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, amt / {unit} AS w FROM sym), {', '.join(names)} {last}"


def pagerank_sql(rounds: int = SETTLED, flow: str = NATION_FLOW, value: str = four("r")) -> str:
    return _iterate(
        "SELECT u AS node, 1.0 / (SELECT count(DISTINCT u) FROM e) AS r FROM e GROUP BY u",
        lambda k: [
            f"r{k + 1} AS MATERIALIZED (SELECT v AS node, 0.15 / (SELECT count(DISTINCT u) FROM e) + 0.85 * sum(r * w / total) AS r FROM e "
            f"JOIN (SELECT u AS t, sum(w) AS total FROM e GROUP BY u) o ON o.t = e.u JOIN r{k} ON node = u GROUP BY v)"
        ],
        rounds,
        f"SELECT node, {value} AS rank FROM r{rounds}",
        flow,
    )


def eigenvector_sql(rounds: int = SETTLED, flow: str = NATION_FLOW, value: str = four("r")) -> str:
    return _iterate(
        "SELECT u AS node, 1.0 AS r FROM e GROUP BY u",
        lambda k: [
            f"g{k + 1} AS MATERIALIZED (SELECT a.node, a.r + coalesce(s, 0) AS r FROM r{k} a LEFT JOIN (SELECT u, sum(w * b.r) AS s FROM e JOIN r{k} b ON b.node = v GROUP BY u) x ON x.u = a.node)",
            f"r{k + 1} AS MATERIALIZED (SELECT node, r / (SELECT sqrt(sum(r * r)) FROM g{k + 1}) AS r FROM g{k + 1})",
        ],
        rounds,
        f"SELECT node, {value} AS score FROM r{rounds}",
        flow,
    )


HOSTS_SQL = "SELECT page_id, min(page_id) OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1)) AS component FROM pages"

QUERIES = {"connected_hosts": connected_hosts} | {f"pagerank_{g}": _rank(g) for g in GRAPHS} | {f"eigenvector_{g}": _vector(g) for g in GRAPHS}
ORACLE_SQL = {"connected_hosts": HOSTS_SQL} | {f"pagerank_{g}": pagerank_sql(flow=duck) for g, (_, duck) in GRAPHS.items()} | {f"eigenvector_{g}": eigenvector_sql(flow=duck) for g, (_, duck) in GRAPHS.items()}
