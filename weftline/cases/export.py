"""A graph on its way out: statements, JSON, digests, a live store."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.cases.graph import CaseGraph


def literal(c: Column, kind: T.DataType) -> Column:
    """A value as a literal of the statement language; nested ones as JSON."""
    if isinstance(kind, T.BooleanType | T.NumericType):
        text = c.cast("string")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType | T.NumericType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: literal(x, kind.elementType)), ", "), F.lit("]"))
    else:
        plain = c.cast("string") if not isinstance(kind, T.StructType | T.MapType | T.ArrayType) else F.to_json(c)
        text = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\\", r"\\\\"), "'", r"\\'"), "\n", " "), F.lit("'"))
    return F.coalesce(text, F.lit("null"))


def properties(rows: DataFrame, names: list[str]) -> Column:
    kinds = {f.name: f.dataType for f in rows.schema}
    parts = [F.concat(F.lit(f"{n}: "), literal(F.col(n), kinds[n])) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def edge_view(edges: DataFrame) -> DataFrame:
    """Edges as they leave: four decimals, sources without repeats, the first
    three pieces of evidence on one line."""
    kinds = lambda field: F.array_sort(F.array_distinct(F.transform("sources", lambda s: s[field])))
    said = F.array_join(F.transform(F.slice("sources", 1, 3), lambda s: F.coalesce(s["evidence"], F.lit(""))), " | ")
    return edges.select("a", "b", "types", F.round("weight", 4).alias("weight"), "confidence", "observations", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), kinds("source_type").alias("independent_sources"), kinds("source_id").alias("source_ids"), said.alias("evidence"))


def node_view(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("entity_type", F.col("type")).withColumn("label_type", F.initcap("type")).drop("type")


def node_statements(nodes: DataFrame) -> DataFrame:
    rows = node_view(nodes)
    names = [c for c in rows.columns if c != "label_type"]
    return rows.select(F.concat(F.lit("MERGE (n:"), "label_type", F.lit(" {id: "), literal(F.col("id"), T.StringType()), F.lit("}) SET n += "), properties(rows, names), F.lit(";")).alias("statement"))


def edge_statements(edges: DataFrame) -> DataFrame:
    rows = edge_view(edges)
    quoted = lambda c: literal(F.col(c), T.StringType())
    kind = F.coalesce(F.try_element_at("types", F.lit(1)), F.lit("RELATED_TO"))
    return rows.select(F.concat(F.lit("MATCH (a {id: "), quoted("a"), F.lit("}), (b {id: "), quoted("b"), F.lit("}) MERGE (a)-[r:"), kind, F.lit("]-(b) SET r += "), properties(rows, rows.columns[2:]), F.lit(";")).alias("statement"))


def write_statements(g: CaseGraph, path: str) -> None:
    """Folders of statements, nodes to be loaded before edges."""
    node_statements(g.nodes).write.mode("overwrite").text(f"{path}/1-nodes")
    edge_statements(g.edges).write.mode("overwrite").text(f"{path}/2-edges")


def write_json(g: CaseGraph, path: str) -> None:
    node_view(g.nodes).write.mode("overwrite").json(f"{path}/nodes")
    edge_view(g.edges).write.mode("overwrite").json(f"{path}/edges")


def live_available() -> bool:
    return importlib.util.find_spec("neo4j") is not None


def write_live(rows: DataFrame, run: Callable[[Iterator[Row]], None]) -> None:
    """Every partition's statements to ``run``, which opens its own connection
    on the executor; statements are idempotent, so a task may run again."""
    rows.foreachPartition(run)


def digest(title: str, body: str) -> str:
    import hashlib

    return hashlib.sha256((title + body).encode()).hexdigest()


def digests(reports: DataFrame) -> DataFrame:
    """(title, body) rows with the digest that a printed copy is held against."""
    return reports.withColumn("sha256", F.sha2(F.concat(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), 256))


def clean(properties: dict) -> dict:
    """Scalars and lists of scalars as they are, mappings as JSON, the rest not."""
    out = {}
    for name, value in properties.items():
        if value is None or isinstance(value, str | int | float | bool):
            out[name] = value
        elif isinstance(value, dict):
            out[name] = json.dumps(value, ensure_ascii=False)
        elif isinstance(value, list | tuple):
            kept = [x for x in value if x is None or isinstance(x, str | int | float | bool)]
            if kept:
                out[name] = kept
    return out
