"""The files of a case as tables, and the checks at intake.

A kind is a schema, an identifier (its first column) and a format. Scans are
``spark.read`` with that schema, so columns are pruned and filters pushed into
the scan; values are cast once, there. Every function takes a folder that any
Hadoop file system may hold.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import materialize, release


@dataclass(frozen=True)
class Kind:
    """``text`` and ``ts`` name the columns that extraction reads."""

    name: str
    form: str
    columns: str
    text: str | None = None
    ts: str | None = None
    prefix: str = ""
    source_type: str = ""

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.columns)

    @property
    def key(self) -> str:
        return self.schema.names[0]


#: The columns of each kind, in file order.
KINDS = {
    k.name: k
    for k in (
        Kind("fir", "json", "fir_id string, narrative string, registered_on timestamp_ntz, station string, sections string, district string, language string", "narrative", "registered_on", "FIR", "fir"),
        Kind("surveillance", "json", "report_id string, observation string, observed_on timestamp_ntz, location string, lat double, lon double, unit string", "observation", "observed_on", "SUR", "surveillance"),
        Kind("social", "json", "post_id string, text string, posted_on timestamp_ntz, platform string, handle string, geo_hint string, reliability string", "text", "posted_on", "SM", "social_media"),
        Kind("cdr", "csv", "call_id string, caller string, callee string, start_time timestamp_ntz, duration_sec int, call_type string, cell_tower string, lat double, lon double, imei string"),
        Kind("transactions", "csv", "txn_id string, from_account string, from_name string, to_account string, to_name string, amount_inr long, mode string, timestamp timestamp_ntz, narration string"),
        Kind("criminal_records", "csv", "record_id string, name string, phone string, prior_cases int, offence_categories string, active_period string, police_district string"),
    )
}
#: Defaults of a record that is filed by hand.
DEFAULTS = {
    "fir": {"station": "Unspecified Station", "sections": "", "district": "", "language": "en-IN"},
    "surveillance": {"location": "", "unit": "Field Unit"},
    "social": {"platform": "X", "handle": "@unknown", "geo_hint": "", "reliability": "unverified"},
}


class IntakeError(ValueError):
    """A file or field that is not of its kind."""


def kind_of(name: str) -> Kind:
    if name not in KINDS:
        raise IntakeError(f"no kind {name!r}; one of {sorted(KINDS)}")
    return KINDS[name]


def read_file(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One file, checked: a CSV needs its header (a byte-order mark is no part
    of it), a JSON array the identifier in every record."""
    kind = kind_of(name)
    if kind.form == "csv":
        head = spark.read.option("header", False).csv(path).limit(1).collect()
        found = [c.lstrip("﻿").strip() for c in (head[0] if head else ()) if c is not None]
        if not found:
            raise IntakeError("no header row")
        missing = [c for c in kind.schema.names if c not in found]
        if missing:
            raise IntakeError(f"missing columns {missing}")
        known = {f.name: f.dataType for f in kind.schema}
        given = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in found])
        return spark.read.option("header", True).option("enforceSchema", True).schema(given).csv(path).select(*kind.schema.names)
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").schema(f"{kind.columns}, _broken string").json(path)
    rows = rows.withColumn("_broken", F.col("_broken"))
    bad = materialize(rows, "intake")
    if not bad.where(F.col("_broken").isNotNull()).isEmpty():
        release(bad)
        raise IntakeError("not a JSON array of records")
    if not bad.where(F.col(kind.key).isNull()).isEmpty():
        release(bad)
        raise IntakeError(f"every record needs {kind.key}")
    return bad.drop("_broken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The held records of a kind; empty where nothing was filed yet."""
    kind = kind_of(name)
    path = f"{folder}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], kind.schema)
    return spark.read.schema(kind.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, system = _file_system(spark, path)
    return system.exists(target)


def _replace(rows: DataFrame, folder: str, name: str) -> None:
    """Written beside, then put in place: a reader never meets half a table."""
    spark = rows.sparkSession
    fresh, path = f"{folder}/.{name}-{uuid.uuid4().hex[:8]}", f"{folder}/{name}"
    rows.write.parquet(fresh)
    new, system = _file_system(spark, fresh)
    old, _ = _file_system(spark, path)
    system.delete(old, True)
    system.rename(new, old)


def bulk_upload(spark: SparkSession, folder: str, name: str, path: str, mode: str = "append") -> dict:
    """Adds a file's records: those held win, then the first of the file.
    ``mode`` replace drops the held ones first; repeats in the file still go."""
    if mode not in ("append", "replace"):
        raise IntakeError("mode is append or replace")
    kind = kind_of(name)
    incoming = read_file(spark, name, path).withColumn("_at", F.monotonically_increasing_id())
    first = Window.partitionBy(kind.key).orderBy("_at")
    fresh = incoming.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_at")
    held = table(spark, folder, name) if mode == "append" else spark.createDataFrame([], kind.schema)
    added = materialize(fresh.join(held.select(kind.key), kind.key, "left_anti").select(*kind.schema.names), "added")
    before, more = held.count(), added.count()
    _replace(held.unionByName(added), folder, name)
    release(added)
    return {"kind": name, "mode": mode, "records_in_file": before + more, "records_added": more}


def next_id(rows: DataFrame, key: str, prefix: str, year: str = "2026") -> str:
    """One more than the largest number at the end of an identifier, in the
    form of the smallest identifier that is held."""
    tail = F.regexp_extract(key, r"(\d+)$", 1)
    found = rows.agg(F.max(F.when(tail != "", tail.cast("long"))).alias("n"), F.min(key).alias("form")).first()
    number, form = (found["n"] or 0) + 1, found["form"] or f"{prefix}/{year}/0001"
    if "/" not in form:
        return f"{prefix}{number:04d}"
    head, last = form.rsplit("/", 1)
    return f"{head}/{str(number).zfill(len(last))}"


def quick_add(spark: SparkSession, folder: str, name: str, now: str, **fields) -> dict:
    """One document with defaults; its text must say something."""
    kind = kind_of(name)
    if not kind.text:
        raise IntakeError(f"{name} comes as a file; documents are {sorted(DEFAULTS)}")
    words = (fields.get(kind.text) or "").strip()
    if not words:
        raise IntakeError(f"{kind.text} is empty")
    held = table(spark, folder, name)
    record = {**DEFAULTS[name], **{k: v for k, v in fields.items() if v not in (None, "")}, kind.text: words}
    record[kind.ts] = record.get(kind.ts) or now
    record[kind.key] = next_id(held, kind.key, kind.prefix)
    row = spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "j string").select(F.from_json("j", kind.schema).alias("r")).select("r.*")
    row.write.mode("append").parquet(f"{folder}/{name}")
    return record


def clear_all(spark: SparkSession, folder: str) -> list[str]:
    """Every kind empty, with its schema; the names."""
    for kind in KINDS.values():
        _replace(spark.createDataFrame([], kind.schema), folder, kind.name)
    return sorted(KINDS)


def safe_name(filename: str) -> str:
    """A scan's file name without anything but word letters, dots and dashes."""
    return re.sub(r"[^\w.\-]", "_", filename) or "scan.png"


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, source_type, text, ts, record) of all documents."""
    out = None
    for kind in KINDS.values():
        if kind.text:
            rows = table(spark, folder, kind.name)
            part = rows.select(F.col(kind.key).alias("source_id"), F.lit(kind.source_type).alias("source_type"), F.col(kind.text).alias("text"), F.col(kind.ts).alias("ts"), F.to_json(F.struct("*")).alias("record"))
            out = part if out is None else out.unionByName(part)
    return out
