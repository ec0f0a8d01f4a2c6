"""Consecutive numbers over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize


def numbered(rows: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in ``order``. Rows are dealt by ranges
    of the order; each range is numbered by itself and moved by the size of
    those before it, of which there is one number a range. Rows equal in
    ``order`` are numbered in any order among themselves."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = rows.select("*", *(k.alias(f"__k{i}") for i, k in enumerate(keys)))
    cols = [F.col(f"__k{i}").asc_nulls_first() for i in range(len(keys))]
    dealt = named.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id())
    held = materialize(dealt, "numbering")
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__part").orderBy(*cols)
    out = held.withColumn("__r", F.row_number().over(inner)).join(F.broadcast(base), F.col("__part") == F.col("__p"))
    return out.withColumn(name, (F.col("__base") + F.col("__r") + (start - 1)).cast("long")).select(*rows.columns, name)
