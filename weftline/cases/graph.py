"""The case graph: one union of dated, sourced links, merged by pair.

Nodes are people (P0001), organisations (O-hash), places (L-name), vehicles
(V-plate) and documents (F-id). Links are collected as rows, each with the
record that says so, and merged by one aggregation on the unordered pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.cases import entities as people
from weftline.cases import extraction, sources
from weftline.functions.text import has_devanagari, name_key
from weftline.session import materialize

#: What one observation of a type weighs; others weigh 0.5.
WEIGHTS = {
    "CALLED": 1.0, "TRANSACTED_WITH": 1.0, "SHARES_HANDSET": 1.4, "INSTRUCTED_BY": 1.3, "REPORTS_TO": 1.3, "SUPPLIED_BY": 1.2, "DIRECTOR_OF": 1.2,
    "CO_NAMED_IN": 0.6, "ASSOCIATE_OF": 0.7, "SEEN_AT": 0.4, "LINKED_TO_ORG": 0.8, "USED_VEHICLE": 0.4, "CONTROLS_AREA": 0.5,
}
LINK = ["a", "b", "type", "source_id", "source_type", "ts", "confidence", "evidence", "weight", "call_count"]


def weight_of(kind: Column) -> Column:
    out = F.lit(0.5)
    for name, value in WEIGHTS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def org_id(name: Column) -> Column:
    return F.concat(F.lit("O-"), F.substring(F.sha1(name.cast("binary")), 1, 8))


@dataclass
class CaseGraph:
    nodes: DataFrame  # id, label, type, aliases, phones, accounts, sources, merge_evidence, prior_cases, lat, lon ...
    edges: DataFrame  # a, b, types, weight, confidence, observations, first_seen, last_seen, sources, call_count
    people: DataFrame
    orgs: DataFrame
    calls: DataFrame
    transactions: DataFrame
    documents: DataFrame
    mentions: DataFrame
    decisions: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


# --- looking names and numbers up


def phone_index(entities: DataFrame) -> DataFrame:
    """(phone, owner); a number of two people goes to the later one."""
    return entities.select(F.explode("phones").alias("phone"), "id").groupBy("phone").agg(F.max("id").alias("owner"))


def account_index(entities: DataFrame, orgs: DataFrame) -> DataFrame:
    """(account, owner); organisations before people, the later before the earlier."""
    held = entities.select(F.explode("accounts").alias("account"), "id", F.lit(0).alias("rank")).unionByName(orgs.where("account IS NOT NULL").select("account", "id", F.lit(1).alias("rank")))
    return held.groupBy("account").agg(F.max_by("id", F.struct("rank", "id")).alias("owner"))


def alias_index(entities: DataFrame, orgs: DataFrame) -> DataFrame:
    """(form, owner) of every spelling, lower case."""
    forms = entities.select(F.explode(F.concat(F.array("label"), "aliases")).alias("form"), "id", F.lit(0).alias("rank")).unionByName(orgs.select(F.col("label").alias("form"), "id", F.lit(1).alias("rank")))
    return forms.groupBy(F.lower(F.trim("form")).alias("form")).agg(F.max_by("id", F.struct("rank", "id")).alias("owner"))


def resolve_names(rows: DataFrame, column: str, forms: DataFrame, out: str) -> DataFrame:
    """``rows`` with the owner of a name: by its exact spelling, else by its
    phonetic key where that belongs to one owner only."""
    keyed = forms.select(F.to_json(name_key(F.col("form"))).alias("_key"), "owner")
    unique = keyed.groupBy("_key").agg(F.min("owner").alias("_near"), F.max("owner").alias("_far")).where("_near = _far").select("_key", "_near")
    exact = forms.select(F.col("form").alias("_form"), F.col("owner").alias("_exact"))
    names = rows.select(F.col(column).alias("_name")).distinct().where("_name IS NOT NULL")
    found = names.join(exact, F.lower(F.trim("_name")) == F.col("_form"), "left").withColumn("_key", F.to_json(name_key(F.col("_name")))).join(unique, "_key", "left")
    found = found.select("_name", F.coalesce("_exact", "_near").alias(out))
    return rows.join(found, F.col(column) == F.col("_name"), "left").drop("_name")


# --- links


def call_pairs(calls: DataFrame) -> DataFrame:
    """(p, q, n, seconds, first, last, cells) of every unordered pair of numbers."""
    return calls.groupBy(F.least("caller", "callee").alias("p"), F.greatest("caller", "callee").alias("q")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("seconds"), F.min("start_time").alias("first"), F.max("start_time").alias("last"), F.array_sort(F.collect_set("cell_tower")).alias("cells")
    )


def _link(rows: DataFrame, kind: str, source: str, source_type: str, ts, confidence: float, evidence, weight=None, calls=None) -> DataFrame:
    w = weight if weight is not None else F.lit(WEIGHTS.get(kind, 0.5))
    return rows.select("a", "b", F.lit(kind).alias("type"), F.lit(source).alias("source_id"), F.lit(source_type).alias("source_type"), ts.alias("ts"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"), w.cast("double").alias("weight"), (calls if calls is not None else F.lit(None)).cast("long").alias("call_count"))


def place_id(name: Column) -> Column:
    return F.concat(F.lit("L-"), F.translate(name, " ", "_"))


def call_links(calls: DataFrame, phones: DataFrame) -> DataFrame:
    own = lambda n, o: phones.select(F.col("phone").alias(n), F.col("owner").alias(o))
    pairs = call_pairs(calls).join(own("p", "a"), "p").join(own("q", "b"), "q")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    said = F.format_string("%d contacts between %s and %s between %s and %s, cell sites: %s", "n", "p", "q", day("first"), day("last"), F.array_join("cells", ", "))
    called = _link(pairs, "CALLED", "CDR", "cdr", F.col("last"), 0.92, said, 1 + F.col("n") / 25, F.col("n"))
    cells = pairs.select(F.explode(F.array("a", "b")).alias("a"), "last", "cells").select("a", "last", F.explode("cells").alias("cell"))
    seen = _link(cells.withColumn("b", place_id(F.col("cell"))), "SEEN_AT", "CDR", "cdr", F.col("last"), 0.7, F.format_string("Handset active on %s cell site", "cell"))
    return called.unionByName(seen)


def handset_links(calls: DataFrame, phones: DataFrame) -> DataFrame:
    """Owners of numbers that called from one device; a device's owners are few."""
    used = calls.where("imei IS NOT NULL AND imei <> ''").select("imei", F.col("caller").alias("phone")).distinct()
    many = used.groupBy("imei").agg(F.array_sort(F.collect_list("phone")).alias("numbers")).where(F.size("numbers") > 1)
    owner = used.join(phones, "phone").select("imei", "owner").distinct()
    pairs = owner.select("imei", F.col("owner").alias("a")).join(owner.select("imei", F.col("owner").alias("b")), "imei").where("a < b").join(many, "imei")
    return _link(pairs, "SHARES_HANDSET", "CDR", "cdr", F.lit(None).cast("timestamp_ntz"), 0.95, F.format_string("Numbers %s seen on one handset (IMEI %s)", F.array_join("numbers", ", "), "imei"))


def attributed(transactions: DataFrame, accounts: DataFrame, forms: DataFrame) -> DataFrame:
    """Transactions with ``payer`` and ``payee``: by account, else by name."""
    out = transactions
    for side, who in (("from", "payer"), ("to", "payee")):
        index = accounts.select(F.col("account").alias("_acc"), F.col("owner").alias("_by_account"))
        out = resolve_names(out, f"{side}_name", forms, "_by_name").join(index, F.col(f"{side}_account") == F.col("_acc"), "left")
        out = out.withColumn(who, F.coalesce("_by_account", "_by_name")).drop("_acc", "_by_account", "_by_name")
    return out


def payment_links(paid: DataFrame) -> DataFrame:
    pairs = paid.where("payer IS NOT NULL AND payee IS NOT NULL AND payer <> payee").groupBy(F.least("payer", "payee").alias("a"), F.greatest("payer", "payee").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_inr").alias("amt"), F.array_sort(F.collect_set("mode")).alias("modes"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    said = F.format_string("%d transactions totalling Rs %,d (%s) between %s and %s", "n", "amt", F.array_join("modes", ", "), F.date_format("first", "yyyy-MM-dd"), F.date_format("last", "yyyy-MM-dd"))
    return _link(pairs, "TRANSACTED_WITH", "TXN", "transaction", F.col("last"), 0.95, said, 1 + F.least(F.col("amt") / 5_000_000, F.lit(3.0)))


def text_links(relations: DataFrame, forms: DataFrame) -> DataFrame:
    rows = resolve_names(relations.withColumnsRenamed({"a": "an", "b": "bn"}), "an", forms, "ao")
    rows = resolve_names(rows, "bn", forms, "bo")
    b = F.when(F.col("b_kind") == "LOCATION", place_id(F.col("bn"))).when(F.col("b_kind") == "VEHICLE", F.concat(F.lit("V-"), F.translate("bn", " ", ""))).otherwise(F.col("bo"))
    rows = rows.withColumn("a", F.col("ao")).withColumn("b", b)
    shape = lambda r, kind, sure, said, w: r.select("a", "b", kind.alias("type"), "source_id", "source_type", "ts", sure.alias("confidence"), said.alias("evidence"), w.alias("weight"), F.lit(None).cast("long").alias("call_count"))
    said = shape(rows, F.col("type"), F.col("confidence"), F.col("evidence"), weight_of(F.col("type")))
    named = rows.where("source_type = 'fir'").select(F.explode(F.array("ao", "bo")).alias("a"), "source_id", "source_type", "ts")
    named = named.withColumn("b", F.concat(F.lit("F-"), "source_id"))
    return said.unionByName(shape(named, F.lit("NAMED_IN"), F.lit(0.85), F.concat(F.lit("Named in "), "source_id"), F.lit(0.5)))


def merge(links: DataFrame) -> DataFrame:
    """One edge a pair: types, summed weight, highest confidence, first and
    last date (of those that have one), the number of observations and all of
    them, by date and source. Links of a node with itself, or with nobody, go."""
    source = F.struct("ts", "source_id", "source_type", "type", "evidence", "confidence")
    return links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("observations"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("call_count").alias("call_count"), F.sort_array(F.collect_list(source)).alias("sources"),
    )


def build(spark: SparkSession, folder: str, book: extraction.Gazetteer, places: dict[str, tuple[float, float]] | None = None, pages: DataFrame | None = None) -> CaseGraph:
    """The graph of a case's files. ``book`` knows names, ``places`` their
    coordinates; ``pages``: admitted scans as (source_id, text)."""
    calls, paid, records = (sources.table(spark, folder, k) for k in ("cdr", "transactions", "criminal_records"))
    documents = sources.texts(spark, folder)
    if pages is not None:
        documents = documents.unionByName(pages.select("source_id", F.lit("fir_scan").alias("source_type"), "text", F.lit(None).cast("timestamp_ntz").alias("ts"), F.to_json(F.struct("source_id", "text")).alias("record")))
    forms = records.select("name").where("name IS NOT NULL").distinct().limit(extraction.MOST_FORMS + 1).toPandas()["name"]
    known = extraction.Gazetteer(frozenset(book.people | set(forms)), book.orgs, book.places, book.name_words, book.deva_stops)
    mentions = materialize(extraction.extract(documents, known), "mentions")
    spoken = materialize(extraction.speak(documents, mentions), "cues")
    relations = extraction.relations(mentions, spoken)

    directory = spark.createDataFrame([(n,) for n in sorted(book.orgs)], "label string")
    sides = [paid.select(F.col(f"{s}_name").alias("name"), F.col(f"{s}_account").alias("account"), F.col("txn_id").alias("source_id")) for s in ("from", "to")]
    parties = sides[0].unionByName(sides[1])
    accounts = parties.join(directory, F.col("name") == F.col("label")).groupBy("label").agg(F.max("account").alias("account"))
    orgs = directory.join(accounts, "label", "left").select(org_id(F.col("label")).alias("id"), "label", "account")

    none = F.array().cast("array<string>")
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", none).otherwise(F.array(c))
    from_records = records.select("name", F.col("record_id").alias("source_id"), F.lit("criminal_record").alias("source_type"), one("phone").alias("phones"), none.alias("accounts"), none.alias("vehicles"))
    from_paid = parties.join(directory, F.col("name") == F.col("label"), "left_anti").select("name", "source_id", F.lit("transaction").alias("source_type"), none.alias("phones"), one("account").alias("accounts"), none.alias("vehicles"))
    observed = people.with_ids(from_records.unionByName(extraction.observations(mentions, spoken)).unionByName(from_paid))
    decided = materialize(people.decisions(observed), "decisions")
    persons = materialize(people.entities(observed, decided, records.withColumnRenamed("record_id", "source_id")), "entities")

    phones, index = phone_index(persons), materialize(alias_index(persons, orgs), "aliases")
    paid = materialize(attributed(paid, account_index(persons, orgs), index), "paid")
    links = call_links(calls, phones).unionByName(handset_links(calls, phones)).unionByName(payment_links(paid)).unionByName(text_links(relations, index))
    edges = materialize(merge(links), "edges")

    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    spots = spark.createDataFrame([(k, *v) for k, v in (places or {}).items()], "label string, lat double, lon double")
    person_nodes = persons.withColumn("type", F.lit("PERSON")).withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")).drop("entity")
    org_nodes = orgs.join(ends, "id", "left_semi").select("id", "label", F.lit("ORG").alias("type"), F.when(F.col("account").isNull(), none).otherwise(F.array("account")).alias("accounts"))
    other = ends.where(F.col("id").rlike("^[LVF]-")).withColumn("type", F.when(F.col("id").startswith("L-"), "LOCATION").when(F.col("id").startswith("V-"), "VEHICLE").otherwise("CASE"))
    other = other.withColumn("label", F.when(F.col("type") == "LOCATION", F.translate(F.substring("id", 3, 1 << 20), "_", " ")).otherwise(F.substring("id", 3, 1 << 20))).join(spots, "label", "left")
    filed = documents.where("source_type = 'fir'").select(F.concat(F.lit("F-"), "source_id").alias("id"), F.col("source_id").alias("label"), F.lit("CASE").alias("type"))
    nodes = person_nodes.unionByName(org_nodes, allowMissingColumns=True).unionByName(other.where("type <> 'CASE'"), allowMissingColumns=True).unionByName(filed, allowMissingColumns=True)
    for c in ("aliases", "phones", "accounts", "vehicles", "sources", "merge_evidence"):
        nodes = nodes.withColumn(c, F.coalesce(c, none))
    return CaseGraph(materialize(nodes, "nodes"), edges, persons, orgs, calls.join(phones.toDF("caller", "caller_owner"), "caller", "left").join(phones.toDF("callee", "callee_owner"), "callee", "left"), paid, documents.withColumn("script", F.when(has_devanagari(F.col("text")), "devanagari").otherwise("latin")), mentions, decided)


# --- views


def person_edges(g: CaseGraph) -> DataFrame:
    """Edges between people and organisations: the induced subgraph."""
    keep = g.nodes.where("type IN ('PERSON', 'ORG')").select("id")
    return g.edges.join(keep, F.col("a") == F.col("id"), "left_semi").join(keep, F.col("b") == F.col("id"), "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), F.col("weight").alias("w")))


def filtered(g: CaseGraph, min_confidence: float = 0.0, edge_types: list[str] | None = None, types: list[str] | None = None, redact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types and the edges between them that are sure enough and
    of some type wanted."""
    nodes = g.nodes.where(F.col("type").isin(types)) if types else g.nodes
    edges = g.edges.where(F.col("confidence") >= min_confidence)
    if edge_types:
        edges = edges.where(F.arrays_overlap("types", F.array(*map(F.lit, edge_types))))
    keep = nodes.select("id")
    edges = edges.join(keep, F.col("a") == F.col("id"), "left_semi").join(keep, F.col("b") == F.col("id"), "left_semi")
    if redact:
        nodes = nodes.withColumn("phones", F.transform("phones", lambda p: F.lit("[redacted]"))).withColumn("accounts", F.array().cast("array<string>"))
    return nodes.withColumn("record_checked", F.col("prior_cases").isNotNull()), edges


def evidence(g: CaseGraph, a: str, b: str) -> DataFrame:
    """The sources of one edge with their documents."""
    edge = g.edges.where((F.col("a") == min(a, b)) & (F.col("b") == max(a, b))).select(F.explode("sources").alias("s")).select("s.*")
    return edge.join(g.documents.select("source_id", "source_type", "record"), ["source_id", "source_type"], "left")


def corroboration(edges: DataFrame) -> DataFrame:
    """Edges with the source systems that stand behind them."""
    kinds = F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["source_type"])))
    return edges.withColumn("independent_sources", kinds).withColumn("level", F.size("independent_sources"))


def as_of(edges: DataFrame, when: str) -> DataFrame:
    """Edges that were known by a time; undated ones always are."""
    return edges.where(F.col("first_seen").isNull() | (F.col("first_seen") <= F.lit(when).cast("timestamp_ntz")))


def neighbourhood(edges: DataFrame, node: str, hops: int = 2) -> DataFrame:
    """(id, distance) of the nodes within some hops."""
    both = both_ways(edges).select("u", "v").distinct()
    seen = edges.sparkSession.createDataFrame([(node, 0)], "id string, distance int")
    edge = seen
    for k in range(1, hops + 1):
        edge = edge.join(both, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(k))
        edge = materialize(edge, "hop")
        seen = seen.unionByName(edge)
    return seen


def paths(edges: DataFrame, a: str, b: str, cutoff: int = 5, keep: int = 6) -> DataFrame:
    """The simple paths between two nodes of up to ``cutoff`` hops that are
    shortest, then surest: (path, hops, confidence, source_types). All are
    found before the best are kept; a hop that cannot reach ``b`` in the hops
    that are left is not taken."""
    step = corroboration(edges).select("a", "b", F.col("confidence").alias("c"), F.col("independent_sources").alias("s"))
    both = materialize(step.select(F.col("a").alias("u"), F.col("b").alias("v"), "c", "s").unionByName(step.select(F.col("b").alias("u"), F.col("a").alias("v"), "c", "s")), "steps")
    far = neighbourhood(edges, b, cutoff).select(F.col("id").alias("v"), F.col("distance").alias("left"))
    near = materialize(both.join(far, "v"), "steps")
    walk = edges.sparkSession.createDataFrame([([a], 1.0, [])], "path array<string>, confidence double, kinds array<string>")
    found = None
    for k in range(1, cutoff + 1):
        tip = F.element_at("path", -1)
        walk = walk.join(near, tip == F.col("u")).where(~F.array_contains("path", F.col("v")) & (F.col("left") <= cutoff - k) & (tip != b))
        walk = walk.select(F.concat("path", F.array("v")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence"), F.concat("kinds", "s").alias("kinds"))
        done = walk.where(F.element_at("path", -1) == b).select("path", F.lit(k).alias("hops"), F.round("confidence", 3).alias("confidence"), F.array_sort(F.array_distinct("kinds")).alias("source_types"))
        found = done if found is None else found.unionByName(done)
    return found.orderBy("hops", F.desc("confidence"), "path").limit(keep)


def stats(g: CaseGraph) -> dict:
    """Headline counts; every value is one aggregate row."""
    one = lambda df: df.agg(F.count(F.lit(1))).first()[0]
    when = g.edges.agg(F.min("first_seen").alias("a"), F.max("last_seen").alias("z"), F.count_if(F.col("first_seen").isNull()).alias("undated")).first()
    return {
        "nodes": one(g.nodes), "edges": one(g.edges), "nodes_by_type": {r[0]: r[1] for r in g.nodes.groupBy("type").count().collect()},
        "edges_by_type": {r[0]: r[1] for r in g.edges.select(F.explode("types").alias("t")).groupBy("t").count().collect()},
        "source_documents": one(g.documents), "mentions": one(g.mentions), "entities": one(g.people), "merge_decisions": one(g.decisions),
        "timeline": {"min": when["a"], "max": when["z"], "undated_edges": when["undated"]},
    }
