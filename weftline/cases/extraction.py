"""Mentions in documents, with their places, and what the words around say.

Whole texts go through one pass of a Python worker: fixed-form identifiers by
pattern, known names by one automaton over all of them, unknown names by their
form. Overlaps are settled by a sweep. Offsets count code points of the text
as it came; Devanagari digits become ASCII one for one, so they hold for both.

Defined cases: a null text has no mention; repeated documents each give their
own; an empty gazetteer finds no known name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import DIGITS, context, romanized
from weftline.operators.names import skeleton

#: Identifiers of a fixed form.
PATTERNS = {
    "PHONE": r"\b([6-9]\d{9})\b",
    "VEHICLE": r"\b(MH\s?\d{2}\s?[A-Z]{1,2}\s?\d{3,4})\b",
    "ACCOUNT": r"\b(AC[A-Z]{3}\d{4})\b",
    "MONEY": r"(?i)(?:Rs\.?|INR|₹)\s?([\d,]+(?:\.\d+)?)\s*(crore|lakh|cr|l)?",
    "DATE": r"\b(\d{2}/\d{2}/\d{4})\b",
    "IMEI": r"\b(\d{15})\b",
}
#: The confidence of a mention by how it was found.
SURE = {"pattern": 0.97, "ORG": 0.95, "PERSON": 0.93, "DEVA_LOCATION": 0.92, "LOCATION": 0.90, "form": 0.72, "deva_form": 0.70}
#: Where kinds of different rank overlap, the higher one stands.
RANK = {"ORG": 3, "LOCATION": 2, "PERSON": 1}
NAME_FORM = re.compile(r"\b((?:[A-Z]\.[ \t]?|[A-Z][a-z]{2,}[ \t]){1,2}[A-Z][a-z]{2,})\b")
DEVA_FORM = re.compile(r"([ऀ-ॿ]{2,}(?:[ \t][ऀ-ॿ]{2,}){1,2})")
#: Capitalised words that begin no name.
NO_NAMES = frozenset(
    "The On During Two Both Complainant Accused Subject Recovered Further Notice Documents Cash Mobile Contact Static Container Meeting Sources Names Funds Police "
    "Station Act Arms Sole Registrar Companies Anti Narcotics Cell Exited Met Seen Director".split()
)
#: A gazetteer travels with the code to every task.
MOST_FORMS = 200_000

MENTION = "source_id string, source_type string, ts timestamp_ntz, text string, type string, start int, end int, confidence double, script string, normalized string"


@dataclass
class Gazetteer:
    """Known names. ``places`` maps a spelling to the label that it stands for;
    ``name_words`` are words of names, Latin and lower case, that make an
    unknown run of capitalised words a person; ``deva_stops`` words that no
    Devanagari name has."""

    people: frozenset[str] = frozenset()
    orgs: frozenset[str] = frozenset()
    places: dict[str, str] = field(default_factory=dict)
    name_words: frozenset[str] = frozenset()
    deva_stops: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if len(self.people) + len(self.orgs) + len(self.places) + len(self.name_words) > MOST_FORMS:
            raise ValueError(f"more than {MOST_FORMS} forms: join them instead")


def _deva(text: str) -> bool:
    return any("ऀ" <= c <= "ॿ" for c in text)


Found = tuple[int, int, str, float, str, str, str]  # start, end, type, confidence, text, script, normalized


class Extractor:
    """The default strategy; ``more`` may add mentions of a text, as
    (start, end, type, confidence), from a model of the caller's."""

    def __init__(self, book: Gazetteer, more: Callable[[str], list[tuple[int, int, str, float]]] | None = None):
        import ahocorasick

        self.book, self.more = book, more
        self.patterns = [(kind, re.compile(p)) for kind, p in PATTERNS.items()]
        self.keys = {skeleton(w) for w in book.name_words}
        self.known = ahocorasick.Automaton()
        forms: dict[str, list] = {}
        for kind, names in (("ORG", {n: n for n in book.orgs}), ("LOCATION", book.places), ("PERSON", {n: n for n in book.people})):
            for name, label in names.items():
                if name:
                    forms.setdefault(name, []).append((kind, name, label))
        for name, kinds in forms.items():
            self.known.add_word(name, kinds)
        if forms:
            self.known.make_automaton()
        self.any = bool(forms)

    def _gazetteer(self, text: str) -> Iterator[Found]:
        ended: dict[str, int] = {}
        for last, kinds in self.known.iter(text) if self.any else ():
            for kind, name, label in kinds:
                start, end = last + 1 - len(name), last + 1
                if start < ended.get(name, 0):
                    continue  # a form never overlaps itself
                ended[name] = end
                deva = _deva(name)
                sure = SURE["DEVA_LOCATION" if deva and kind == "LOCATION" else kind]
                shown = label if kind == "LOCATION" else romanized(name).title() if deva else name
                yield start, end, kind, sure, name, "devanagari" if deva else "latin", shown

    def _forms(self, text: str) -> Iterator[Found]:
        for m in NAME_FORM.finditer(text):
            words = m[1].split()
            if words[0].rstrip(".") not in NO_NAMES and not self.book.name_words.isdisjoint(w.lower().strip(".") for w in words):
                yield m.start(1), m.end(1), "PERSON", SURE["form"], m[1], "latin", m[1]
        for m in DEVA_FORM.finditer(text):
            words = m[1].split()
            if self.book.deva_stops.isdisjoint(words) and any(skeleton(w) in self.keys for w in romanized(m[1]).split()):
                yield m.start(1), m.end(1), "PERSON", SURE["deva_form"], m[1], "devanagari", romanized(m[1]).title()

    def __call__(self, text: str) -> list[Found]:
        plain = text.translate(_ASCII)
        found: list[Found] = [(m.start(1), m.end(1), kind, SURE["pattern"], " ".join(m[1].split()), "latin", " ".join(m[1].split())) for kind, p in self.patterns for m in p.finditer(plain)]
        found += self._gazetteer(text)
        found += self._forms(text)
        for start, end, kind, sure in self.more(text) if self.more else ():
            words = " ".join(text[start:end].split())
            found.append((start, end, kind, sure, words, "latin", words))
        return settle(found)


_ASCII = str.maketrans(DIGITS, "0123456789")


def settle(found: list[Found]) -> list[Found]:
    """Of overlapping mentions of a type the first stays: by start, then
    longest, then surest. Of overlapping ORG, LOCATION and PERSON the highest
    in that order stays; other types stand beside anything."""
    kept: list[Found] = []
    reach = 0  # from here on in kept, something may still overlap
    for m in sorted(found, key=lambda m: (m[0], m[0] - m[1], -m[3])):
        while reach < len(kept) and kept[reach][1] <= m[0]:
            reach += 1
        rank, stands, beaten = RANK.get(m[2], 0), True, []
        for k in kept[reach:]:
            if k[1] <= m[0] or k[0] >= m[1]:
                continue
            if k[2] == m[2] or (rank and rank <= RANK.get(k[2], 0)):
                stands = False
                break
            if rank and RANK.get(k[2], 0):
                beaten.append(k)
        if beaten:
            kept = kept[:reach] + [k for k in kept[reach:] if not any(k is b for b in beaten)]
        if stands:
            kept.append(m)
    return kept


def extract(texts: DataFrame, book: Gazetteer, more: Callable | None = None) -> DataFrame:
    """``MENTION`` rows of (source_id, source_type, text, ts), with context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Extractor(book, more)
        for batch in batches:
            rows = []
            for source, kind, text, ts in zip(batch["source_id"], batch["source_type"], batch["text"], batch["ts"], strict=True):
                for start, end, what, sure, words, written, shown in reader(text or ""):
                    rows.append((source, kind, ts, words, what, start, end, sure, written, shown))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MENTION.split(", ")])

    return texts.select("source_id", "source_type", "text", "ts").mapInPandas(run, MENTION)


def with_context(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Mentions with the words around them."""
    whole = texts.select("source_id", "source_type", F.col("text").alias("_text"))
    return mentions.join(whole, ["source_id", "source_type"]).withColumn("context", context(F.col("_text"), F.col("start"), F.col("end"))).drop("_text")


# --- cues

DEVA = "[ऀ-ॿ]+(?:\\s[ऀ-ॿ]+){0,2}"
#: Words that say whose number it is: pattern, group of the name
#: (0: the first person of the document), group of the number, confidence.
OWNERS = (
    (rf"({DEVA})\s*\(मो\.?\s*(\d{{10}})\)", 1, 2, 0.95),
    (r"मोबाइल नंबर\s+(\d{10})\s+से किए गए", 0, 1, 0.85),
    (r"आरोपी मोबाइल\s+(\d{10})", 0, 1, 0.85),
    (r"([A-Z][\w.\s']{2,30}?)\s*\(mob\.?\s*(\d{10})\)", 1, 2, 0.95),
    (r"issued to\s+([A-Z][\w.\s']{2,30}?)\s+at mobile\s+(\d{10})", 1, 2, 0.93),
    (r"Contact number of accused\s+([A-Z][\w.\s']{2,30}?)\s+is\s+(\d{10})", 1, 2, 0.93),
    (r"Mobile number\s+(\d{10})\s+was used to make threatening calls", 0, 1, 0.85),
    (r"[Aa]ccused was using mobile\s+(\d{10})", 0, 1, 0.85),
    (r"number established as\s+(\d{10})", 0, 1, 0.88),
    (r"known number\s+(\d{10})", 0, 1, 0.90),
)
#: Words that say how two are related: pattern, type, confidence.
RELATIONS = (
    (r"on instructions of (?:one )?([A-Z][\w.\s]{3,30}?)(?:,|\s+who|\s+is|\.)", "INSTRUCTED_BY", 0.80),
    (r"(?:is )?(?:reportedly )?working under ([A-Z][\w.\s]{3,30}?)(?:\.|,)", "REPORTS_TO", 0.80),
    (r"handed over to him by ([A-Z][\w.\s]{3,30}?)(?: at|\.|,)", "SUPPLIED_BY", 0.78),
    (r"procuring the material from ([A-Z][\w.\s]{3,30}?)(?:\.|,)", "SUPPLIED_BY", 0.78),
    (r"involvement of ([A-Z][\w.\s]{3,30}?) in", "ASSOCIATE_OF", 0.65),
    (r"director of ([A-Z][\w.\s&-]{3,40}?) is recorded as ([A-Z][\w.\s]{3,30}?)(?:,|\.)", "DIRECTOR_OF", 0.90),
    (rf"({DEVA})\s+के कहने पर", "INSTRUCTED_BY", 0.80),
    (rf"({DEVA})\s+के लिए काम करता है", "REPORTS_TO", 0.80),
    (rf"({DEVA})\s+से माल लिया", "SUPPLIED_BY", 0.78),
)
#: Characters between a vehicle and the person before it, and
#: between a person and a place or organisation.
NEAR_VEHICLE, NEAR_PERSON = 140, 200

RELATION = "a string, b string, a_kind string, b_kind string, type string, source_id string, source_type string, ts timestamp_ntz, confidence double, evidence string"
OBSERVATION = "name string, source_id string, source_type string, phones array<string>, accounts array<string>, vehicles array<string>"


def snap(candidate: str, names: list[str]) -> str:
    """A cue's words as the first person of the document that they hold."""
    words = candidate.strip().strip(".,")
    if words in names:
        return words
    return next((n for n in names if n in words), candidate.strip())


class Cues:
    """What a document says about its persons."""

    def __init__(self) -> None:
        self.owners = [(re.compile(p), *rest) for p, *rest in OWNERS]
        self.relations = [(re.compile(p), *rest) for p, *rest in RELATIONS]

    def owned(self, text: str, persons: list[str]) -> list[tuple[str, str, float, str]]:
        """(phone, owner, confidence, evidence): only where words say so."""
        out = []
        for pattern, name, number, sure in self.owners:
            for m in pattern.finditer(text):
                owner = m[name].strip() if name else persons[0] if persons else ""
                if owner:
                    out.append((m[number], snap(owner, persons), sure, text[max(0, m.start() - 50) : m.end() + 50].replace("\n", " ")))
        return out

    def related(self, text: str, names: list[str]) -> list[tuple[str, str, str, str, float, str]]:
        """(a, b, kind of b, type, confidence, evidence); ``names`` sorted: the
        first is who a cue without a subject speaks of."""
        out = []
        for pattern, kind, sure in self.relations:
            for m in pattern.finditer(text):
                said = text[max(0, m.start() - 60) : m.end() + 60].replace("\n", " ")
                if kind == "DIRECTOR_OF":
                    out.append((m[2], m[1], "ORG", kind, sure, said))
                elif names:
                    out.append((names[0], m[1], "PERSON", kind, sure, said))
        return [r for r in out if r[0].strip().lower() != r[1].strip().lower()]


def speak(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row a document: ``owned`` (phone, owner, confidence, evidence) and
    ``related`` (a, b, b_kind, type, confidence, evidence) by its cues."""
    persons = mentions.where("type = 'PERSON'").groupBy("source_id", "source_type").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("persons"))
    joined = texts.select("source_id", "source_type", "ts", "text").join(persons, ["source_id", "source_type"], "left")
    owned = "array<struct<phone:string,owner:string,confidence:double,evidence:string>>"
    related = "array<struct<a:string,b:string,b_kind:string,type:string,confidence:double,evidence:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cues = Cues()
        for batch in batches:
            rows = []
            for source, kind, ts, text, found in zip(*(batch[c] for c in ("source_id", "source_type", "ts", "text", "persons")), strict=True):
                names = [p["text"] for p in found] if found is not None else []
                plain = (text or "").translate(_ASCII)
                own = [dict(zip(("phone", "owner", "confidence", "evidence"), r, strict=True)) for r in cues.owned(plain, names)]
                rel = [dict(zip(("a", "b", "b_kind", "type", "confidence", "evidence"), r, strict=True)) for r in cues.related(plain, sorted(set(names)))]
                rows.append((source, kind, ts, own, rel))
            yield pd.DataFrame(rows, columns=["source_id", "source_type", "ts", "owned", "related"])

    return joined.mapInPandas(run, f"source_id string, source_type string, ts timestamp_ntz, owned {owned}, related {related}")


def vehicles_of(mentions: DataFrame) -> DataFrame:
    """Every vehicle with the closest person who ends before it within
    ``NEAR_VEHICLE`` characters of the same document."""
    side = lambda kind, name: mentions.where(F.col("type") == kind).select("source_id", "source_type", "ts", F.col("text").alias(name), F.col("start").alias(f"{name}_at"), F.col("end").alias(f"{name}_end"))
    gap = F.col("vehicle_at") - F.col("person_end")
    pairs = side("VEHICLE", "vehicle").join(side("PERSON", "person").drop("ts"), ["source_id", "source_type"]).where((gap >= 0) & (gap < NEAR_VEHICLE))
    return pairs.groupBy("source_id", "source_type", "ts", "vehicle", "vehicle_at").agg(F.min_by("person", F.struct(gap, F.col("person_at"))).alias("person"))


def relations(mentions: DataFrame, spoken: DataFrame) -> DataFrame:
    """All ``RELATION`` rows of the documents: cues, vehicles, persons named
    together, and persons near a place or an organisation."""
    key = ["source_id", "source_type"]
    said = spoken.select(*key, "ts", F.explode("related").alias("r")).select("r.a", "r.b", F.lit("PERSON").alias("a_kind"), "r.b_kind", "r.type", *key, "ts", "r.confidence", "r.evidence")
    row = lambda a, b, kind, what, sure, why: [F.col(a).alias("a"), F.col(b).alias("b"), F.lit("PERSON").alias("a_kind"), F.lit(kind).alias("b_kind"), F.lit(what).alias("type"), *key, "ts", sure.alias("confidence"), why.alias("evidence")]
    used = vehicles_of(mentions).select(*row("person", "vehicle", "VEHICLE", "USED_VEHICLE", F.lit(0.55), F.format_string("%s associated with %s in %s", "person", "vehicle", "source_id")))
    persons = mentions.where("type = 'PERSON'")
    names = persons.select(*key, "ts", F.col("text").alias("x")).distinct()
    both = names.join(names.select(*key, F.col("x").alias("y")), key).where((F.col("x") < F.col("y")) & (F.lower("x") != F.lower("y")))
    weak = F.when(F.col("source_type") == "social_media", 0.55).otherwise(0.70)
    together = both.select(*row("x", "y", "PERSON", "CO_NAMED_IN", weak, F.concat(F.lit("Both named in "), "source_id")))
    left = persons.select(*key, "ts", F.col("text").alias("x"), F.col("start").alias("xs"))
    right = mentions.where("type IN ('LOCATION', 'ORG')").select(*key, F.col("text").alias("y"), F.col("start").alias("ys"), "type", F.col("normalized").alias("shown"))
    near = left.join(right, key).where(F.abs(F.col("xs") - F.col("ys")) < NEAR_PERSON)
    place = near.where("type = 'LOCATION'").select(*row("x", "shown", "LOCATION", "SEEN_AT", F.lit(0.60), F.format_string("%s and %s co-occur in %s", "x", "y", "source_id")))
    org = near.where("type = 'ORG'").select(*row("x", "y", "ORG", "LINKED_TO_ORG", F.lit(0.65), F.format_string("%s linked to %s in %s", "x", "y", "source_id")))
    return said.unionByName(used).unionByName(together).unionByName(place).unionByName(org)


def observations(mentions: DataFrame, spoken: DataFrame) -> DataFrame:
    """``OBSERVATION`` rows: every person's mention with the numbers that the
    document says are theirs and the vehicles near them."""
    key = ["source_id", "source_type", "name"]
    phones = spoken.select("source_id", "source_type", F.explode("owned").alias("o")).groupBy("source_id", "source_type", F.col("o.owner").alias("name")).agg(F.sort_array(F.collect_set("o.phone")).alias("phones"))
    cars = vehicles_of(mentions).groupBy("source_id", "source_type", F.col("person").alias("name")).agg(F.sort_array(F.collect_set("vehicle")).alias("vehicles"))
    people = mentions.where("type = 'PERSON'").select(F.col("text").alias("name"), "source_id", "source_type")
    out = people.join(phones, key, "left").join(cars, key, "left")
    none = F.array().cast("array<string>")
    return out.select("name", "source_id", "source_type", F.coalesce("phones", none).alias("phones"), none.alias("accounts"), F.coalesce("vehicles", none).alias("vehicles"))
