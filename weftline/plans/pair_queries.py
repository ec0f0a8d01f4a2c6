"""Queries on pairs of users, in Spark by tiles (``operators.meetings``): their
SQL joins a place's users with each other and deals the pairs, which are the
square of the users, over the disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import meetings, steps
from weftline.plans import case_queries, link_queries
from weftline.plans.dialects import Spark
from weftline.sources.tables import register

#: How far apart two events may be to be a meeting, in microseconds.
WINDOW = 5_400_000_000


def four(column: F.Column) -> F.Column:
    return F.floor(column * 10000 + 0.5) / 10000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, t, k, f): user, time, place; f is 1 with a time, 2 more for an error."""
    register(spark, sf_dir)
    return spark.sql(
        f"""WITH {link_queries.UK} SELECT CAST(u AS BIGINT) AS u, coalesce({Spark().us('ts')}, 0) AS t, k,
        CAST(CASE WHEN ts IS NULL THEN 0 ELSE 1 END + CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS TINYINT) AS f FROM uk WHERE u IS NOT NULL AND k IS NOT NULL"""
    )


def co_location_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users at one place within 90 minutes."""
    return meetings.co_locations(events(spark, sf_dir), WINDOW, errors=False).select("a", "b", "n", "cells")


def co_location_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six meetings of users: severe first, then by number."""
    met = meetings.co_locations(events(spark, sf_dir), WINDOW)
    expected = F.col("calls") >= 10
    named = met.withColumn("severity", F.when(expected, "medium").otherwise("high"))
    return named.orderBy(F.when(expected, 1).otherwise(0), F.desc("n"), "a", "b").limit(6)


def shared_device_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that report errors from one place: pairs, with the places."""
    return meetings.shared_errors(events(spark, sf_dir))


def with_meetings(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement that holds ``co_location_severity``, which comes from tiles."""
    name = f"co_location_severity_{uuid.uuid4().hex[:12]}"
    held = link_queries.co_location_severity(Spark())
    if held not in statement:
        raise ValueError("the statement does not hold co_location_severity")
    co_location_severity(spark, sf_dir).createOrReplaceTempView(name)
    try:
        return spark.sql(statement.replace(held, f"SELECT * FROM {name}"))
    finally:
        spark.catalog.dropTempView(name)


def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of a type, and how many of them are severe."""
    return with_meetings(spark, sf_dir, case_queries.findings_by_type(Spark()))


def pagerank_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.pagerank(events(spark, sf_dir), WINDOW).select("node", four(F.col("rank")).alias("rank"))


def eigenvector_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.eigenvector(events(spark, sf_dir), WINDOW).select("node", four(F.col("score")).alias("score"))


QUERIES = {q.__name__: q for q in (co_location_pairs, co_location_severity, shared_device_links, findings_by_type, pagerank_users, eigenvector_users)}
