"""Read-only sources outside the case, and pages read by OCR.

An adapter reads nothing without the reference of an authorisation. What it
reads is a JSON array, in a folder or from a service; fields are renamed by one
``select``, and arguments are filters that Spark may push down.
"""

from __future__ import annotations

import difflib
import importlib.util
import shutil
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Adapter:
    """``fields``: theirs -> (ours, type); ``equal`` and ``part``: arguments
    that compare a whole field or look for a part of it in any case."""

    key: str
    record_type: str
    fields: dict[str, tuple[str, str]]
    equal: tuple[str, ...] = ()
    part: tuple[str, ...] = ()
    path: str | None = None
    url: str | None = None
    settings: dict = field(default_factory=dict)

    def status(self) -> dict:
        return {"adapter": self.key, "record_type": self.record_type, "mode": "live" if self.url else "file" if self.path else "unconfigured", "access": "read-only", "fields": {k: v[0] for k, v in self.fields.items()}}

    def fetch(self, spark: SparkSession, authorisation: str = "", **query: str) -> DataFrame:
        """Records under our names; refuses without an authorisation."""
        if not authorisation:
            raise PermissionError(f"{self.key}: no authorisation given, no record is read")
        unknown = set(query) - {*self.equal, *self.part}
        if unknown:
            raise ValueError(f"{self.key}: no argument {sorted(unknown)}")
        if self.url:
            raise NotImplementedError("a live service needs its own reader; export it to a folder and give the path")
        schema = ", ".join(f"`{k}` {kind}" for k, (_, kind) in self.fields.items())
        rows = spark.read.schema(schema).option("multiLine", True).json(self.path)
        rows = rows.select(*(F.col(k).alias(ours) for k, (ours, _) in self.fields.items()))
        for name, value in query.items():
            if value:
                rows = rows.where(F.col(name) == value if name in self.equal else F.lower(F.col(name)).contains(value.lower()))
        return rows


#: The fields of the two services.
CASES = {
    "firNumber": ("fir_id", "string"), "policeStation": ("station", "string"), "actsAndSections": ("sections", "string"), "dateOfRegistration": ("registered_on", "string"),
    "district": ("district", "string"), "briefFacts": ("narrative", "string"), "language": ("language", "string"), "accusedPersons": ("accused", "array<struct<name:string,mobile:string>>"),
}
JUSTICE = {
    "personId": ("external_person_id", "string"), "personName": ("name", "string"), "caseNumber": ("case_id", "string"), "courtName": ("court", "string"), "stage": ("stage", "string"),
    "custodyStatus": ("custody_status", "string"), "custodyFrom": ("custody_from", "date"), "custodyTo": ("custody_to", "date"), "lastHearing": ("last_hearing", "date"),
}


def adapters(cases_path: str | None = None, justice_path: str | None = None) -> dict[str, Adapter]:
    return {"cctns": Adapter("cctns", "fir", CASES, equal=("district",), path=cases_path), "icjs": Adapter("icjs", "case_status", JUSTICE, part=("name",), path=justice_path)}


# --- pages read by OCR

IMAGES = r"(?i)\.(png|jpe?g|tiff?)$"
MIN_CHARS, MIN_SIDE = 60, 1200


def ocr_capabilities() -> dict:
    found = {"tesseract": bool(shutil.which("tesseract")), **{m: importlib.util.find_spec(m) is not None for m in ("pytesseract", "PIL")}}
    return found | {"available": all(found.values())}


def read_pages(spark: SparkSession, folder: str, languages: str = "eng") -> DataFrame:
    """(path, text, mean_confidence, ok, error) of every image in ``folder``.
    Without an OCR engine every row says so."""
    able = ocr_capabilities()["available"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if not able:
                    rows.append((path, "", 0.0, False, "no OCR engine on this machine"))
                    continue
                import io

                import pytesseract
                from PIL import Image

                try:
                    page = Image.open(io.BytesIO(content)).convert("L")
                    if min(page.size) < MIN_SIDE:
                        page = page.resize((page.width * 2, page.height * 2), Image.LANCZOS)
                    data = pytesseract.image_to_data(page, lang=languages, output_type=pytesseract.Output.DICT)
                    sure = [float(c) for c in data["conf"] if float(c) >= 0]
                    rows.append((path, pytesseract.image_to_string(page, lang=languages).strip(), round(sum(sure) / len(sure) / 100, 3) if sure else 0.0, True, None))
                except Exception as e:  # one bad page is a row, not a failed job
                    rows.append((path, "", 0.0, False, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "mean_confidence", "ok", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.col("path").rlike(IMAGES)).select("path", "content").mapInPandas(run, "path string, text string, mean_confidence double, ok boolean, error string")


def admit(pages: DataFrame, held: DataFrame) -> DataFrame:
    """Every page with its identifier (the file's name, _ as /) and its status:
    admitted, too little text, or already held as digital text (``held``:
    source_id)."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    named = pages.withColumn("source_id", F.translate(name, "_", "/"))
    known = held.select(F.col("source_id").alias("_held")).distinct()
    short = ~F.col("ok") | (F.length("text") < MIN_CHARS)
    status = F.when(short, F.coalesce("error", F.lit("too little text recovered"))).when(F.col("_held").isNotNull(), "already held as digital text").otherwise("admitted")
    return named.join(known, F.col("source_id") == F.col("_held"), "left").withColumn("status", status).drop("_held")


@F.pandas_udf(T.DoubleType())
def recovered_share(read: pd.Series, truth: pd.Series) -> pd.Series:
    """How much of the true text an OCR text has, in matching blocks, to three
    places; blanks and case aside."""

    def share(a: str | None, b: str | None) -> float:
        want, got = (" ".join((t or "").split()).lower() for t in (b, a))
        blocks = difflib.SequenceMatcher(None, want, got).get_matching_blocks()
        return round(sum(m.size for m in blocks) / max(len(want), 1), 3)

    return pd.Series([share(a, b) for a, b in zip(read, truth, strict=True)], dtype=float)
