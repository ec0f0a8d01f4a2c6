"""Session helpers: one place for the settings the library relies on, and for
the shared scratch folder that iterative plans cut their lineage into."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "weftline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings
    its own session; nothing else in the library sets cluster-level options."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as spark.checkpoint.dir names it.

    Only where that setting is missing and the master is local (tests, a
    laptop) is a temporary folder made, which a single machine does share with
    itself; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local($|\[)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(context, "_weftline_scratch", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context._weftline_scratch = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of its file system, so
    that a task that opens it by itself finds the same place. It is
    remembered until ``remove_path`` or ``cleanup``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}")
    path = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    _held(spark).add(path)
    return path


def _held(spark: SparkSession) -> set[str]:
    context = spark.sparkContext
    if not hasattr(context, "_weftline_paths"):
        context._weftline_paths = set()
    return context._weftline_paths


def cleanup(spark: SparkSession) -> None:
    """Remove what the library still holds in the shared folder. Results are
    lazy and may read it: call this when they are written or no longer needed."""
    for path in list(_held(spark)):
        remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _held(spark).discard(path)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage beyond the files, so an executor that is lost
    later costs a re-read, not a recomputation, and no block lives on one
    machine only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def release(df: DataFrame) -> None:
    """Drop the files behind a frame that ``materialize`` returned."""
    path = getattr(df, "_weftline_path", None)
    if path:
        remove_path(df.sparkSession, path)


def reclaim(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done. Spark drops them
    when the driver collects the objects behind them, which a driver with a
    large heap may not do for hours; a long chain of steps asks for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
