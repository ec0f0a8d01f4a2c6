"""The nine rules over a case graph, as plans that end in one finding schema.

A finding states its rule and the numbers behind it; it is a lead, not a
verdict. Thresholds are parameters with the fixed values as defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.cases.graph import CaseGraph, both_ways, person_edges, resolve_names
from weftline.operators.betweenness import betweenness
from weftline.operators.communities import communities
from weftline.operators.numbering import numbered
from weftline.operators.rank import eigenvector, pagerank
from weftline.plans.score_queries import WEIGHTS, influence
from weftline.session import materialize

FINDING = ["type", "severity", "title", "description", "entities", "entity_labels", "basis", "sources", "date"]
#: What a part of the score says about a person.
WHY = {
    "betweenness": "sits on the shortest routes between other members", "pagerank": "is repeatedly referenced by other significant members", "degree": "has an unusually broad set of direct contacts",
    "eigenvector": "is closely tied to other well-connected members", "prior": "has a documented prior criminal record", "bridging": "connects otherwise separate groups",
}


@dataclass
class Scores:
    influence: DataFrame  # node, label, type, score, rank, phi_*, top_driver, detractor, why, community
    communities: DataFrame  # node, community


def score(g: CaseGraph) -> Scores:
    """Communities and influence on people and organisations; a node without
    links is a community of its own and has no score of position."""
    edges = materialize(person_edges(g), "person-edges")
    both = both_ways(edges)
    nodes = g.nodes.where("type IN ('PERSON', 'ORG')").select(F.col("id").alias("node"), "label", "type", F.coalesce("prior_cases", F.lit(0)).cast("double").alias("prior"))
    found = materialize(communities(both), "communities")
    group = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
    near = both.join(group.toDF("u", "cu"), "u").join(group.toDF("v", "cv"), "v")
    local = near.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("degree"), F.count_distinct(F.when(F.col("cu") != F.col("cv"), F.col("cv"))).cast("double").alias("bridging"))
    metrics = nodes.select("node", "prior").join(local, "node", "left").join(betweenness(both), "node", "left").join(pagerank(both).withColumnRenamed("rank", "pagerank"), "node", "left").join(eigenvector(both).withColumnRenamed("score", "eigenvector"), "node", "left")
    metrics = materialize(metrics.na.fill(0.0), "metrics")
    scored = g.spark.sql(influence("SELECT * FROM {metrics}"), metrics=metrics).join(nodes, "node").join(group, "node")
    ranked = numbered(materialize(scored, "scored"), [-F.col("score"), "label", "node"], "rank")
    parts = F.sort_array(F.array(*(F.struct(F.col(f"phi_{k}").alias("v"), F.lit(k).alias("k")) for k in WEIGHTS)), asc=False)
    said = F.transform(F.filter(F.slice(parts, 1, 2), lambda p: p["v"] > 0.05), lambda p: _text_of(p["k"]))
    why = F.concat("label", F.lit(" "), F.when(F.size(said) > 0, F.array_join(said, " and ")).otherwise("has limited connectivity in the current data"), F.lit("."))
    return Scores(materialize(ranked.withColumn("why", why), "influence"), materialize(group, "groups"))


def _text_of(key: Column) -> Column:
    out = F.lit("")
    for name, text in WHY.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def _finding(rows: DataFrame, kind: str, severity, title, description, entities, labels, basis: dict, sources: list[str], date=None) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), title.alias("title"), description.alias("description"), entities.alias("entities"), labels.alias("entity_labels"),
        F.to_json(F.struct(*((F.lit(v) if isinstance(v, (str, int, float)) else v).alias(k) for k, v in basis.items()))).alias("basis"), F.array(*map(F.lit, sources)).alias("sources"), (date if date is not None else F.lit(None).cast("string")).alias("date"),
    )


def bursts(g: CaseGraph, z: float = 2.5, high: float = 3.5, least: int = 6, days: int = 5) -> DataFrame:
    """Days with far more attributed calls than the mean of the observed days,
    their five busiest people and the busiest place."""
    calls = g.calls.where("caller_owner IS NOT NULL AND callee_owner IS NOT NULL").withColumn("day", F.date_format("start_time", "yyyy-MM-dd"))
    daily = calls.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    level = daily.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count(F.lit(1)).alias("days"))
    found = daily.crossJoin(F.broadcast(level)).where(F.col("days") >= days).withColumn("z", (F.col("n") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).where((F.col("z") >= z) & (F.col("n") >= least))
    busy = calls.join(found.select("day"), "day", "left_semi")
    ends = busy.select("day", F.explode(F.array("caller_owner", "callee_owner")).alias("id")).groupBy("day", "id").agg(F.count(F.lit(1)).alias("c"))
    top = ends.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("c"), "id"))).where("r <= 5").join(g.nodes.select("id", "label"), "id")
    top = top.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("r", "id", "label"))).alias("top"))
    cells = busy.groupBy("day", "cell_tower").agg(F.count(F.lit(1)).alias("c")).groupBy("day").agg(F.min_by("cell_tower", F.struct(-F.col("c"), F.col("cell_tower"))).alias("cell"))
    rows = found.join(top, "day").join(cells, "day", "left")
    said = F.format_string("%d attributed calls on %s against a daily mean of %.1f (z = %.1f). Dominant cell site: %s.", "n", "day", "mean", "z", "cell")
    return _finding(rows, "communication_burst", F.when(F.col("z") >= high, "high").otherwise("medium"), F.concat(F.lit("Abnormal call volume on "), "day"), said, F.col("top.id"), F.col("top.label"), {"rule": f"daily call count z-score >= {z}", "observed": F.col("n"), "mean": F.round("mean", 1), "z_score": F.round("z", 2)}, ["CDR"], F.col("day"))


def burners(g: CaseGraph, contacts: int = 3, days: int = 25, least: int = 3) -> DataFrame:
    """Owned numbers with few contacts, over all calls, and a short life."""
    ends = g.calls.select(F.explode(F.array(F.struct(F.col("caller").alias("phone"), F.col("callee").alias("other"), F.col("caller_owner").alias("id")), F.struct(F.col("callee").alias("phone"), F.col("caller").alias("other"), F.col("callee_owner").alias("id")))).alias("e"), "start_time").select("e.*", "start_time")
    used = ends.groupBy("phone").agg(F.max("id").alias("id"), F.count_distinct("other").alias("contacts"), F.count(F.lit(1)).alias("calls"), F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    used = used.withColumn("days", F.floor((F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 86_400_000_000))
    rows = used.where((F.col("contacts") <= contacts) & (F.col("days") <= days) & (F.col("calls") >= least)).join(g.nodes.select("id", "label", "phones"), "id")
    rows = rows.withColumn("more", F.array_except("phones", F.array("phone")))
    said = F.concat(F.format_string("%s contacted only %d number(s) over a %d-day window and then fell silent", "phone", "contacts", "days"), F.when(F.size("more") > 0, F.concat(F.lit(". The same subject also operates "), F.array_join("more", ", "))).otherwise(""), F.lit("."))
    return _finding(rows, "burner_handset", F.when(F.size("more") > 0, "high").otherwise("medium"), F.concat(F.lit("Probable burner handset "), "phone"), said, F.array("id"), F.array("label"), {"rule": f"<= {contacts} unique contacts and <= {days} active days", "unique_contacts": F.col("contacts"), "active_days": F.col("days"), "calls": F.col("calls")}, ["CDR"])


def payments(g: CaseGraph) -> DataFrame:
    """(src, dst, amount, txns) between attributed parties."""
    return g.transactions.where("payer IS NOT NULL AND payee IS NOT NULL AND payer <> payee").groupBy(F.col("payer").alias("src"), F.col("payee").alias("dst")).agg(F.sum("amount_inr").alias("amount"), F.array_sort(F.collect_list("txn_id")).alias("txns"))


def circular(g: CaseGraph, least: int = 1_000_000, longest: int = 5, keep: int = 3) -> DataFrame:
    """Money that returns through three to five parties, the largest loop of
    every set of parties; the largest sets are reported. A loop is met at its
    smallest party only."""
    legs = materialize(payments(g).select("src", "dst", "amount"), "legs")
    walk = legs.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("amount").alias("total"))
    found = None
    for k in range(2, longest + 1):
        tip = F.element_at("path", -1)
        step = walk.join(legs, tip == F.col("src"))
        if k > 2:
            closed = step.where(F.col("dst") == F.col("path")[0]).select("path", (F.col("total") + F.col("amount")).alias("total"))
            found = closed if found is None else found.unionByName(closed)
        if k < longest:
            walk = step.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), (F.col("total") + F.col("amount")).alias("total"))
    tip = F.element_at("path", -1)
    last = walk.join(legs, (tip == F.col("src")) & (F.col("dst") == F.col("path")[0])).select("path", (F.col("total") + F.col("amount")).alias("total"))
    loops = found.unionByName(last).where(F.col("total") >= least).dropDuplicates(["path"])
    best = loops.groupBy(F.array_sort("path").alias("members")).agg(F.max_by("path", F.struct("total", "path")).alias("path"), F.max("total").alias("total"))
    best = best.orderBy(F.desc("total"), "members").limit(keep)
    named = best.select("*", F.posexplode("path").alias("at", "id")).join(g.nodes.select("id", "label"), "id").groupBy("members", "path", "total").agg(F.sort_array(F.collect_list(F.struct("at", "label"))).alias("named"))
    said = F.format_string("Rs %,d moved through a closed loop of %d parties, returning to the originator.", "total", F.size("path"))
    return _finding(named, "circular_fund_flow", "high", F.lit("Funds returning to origin through intermediaries"), said, F.col("path"), F.col("named.label"), {"rule": f"directed cycle in the payment graph, total >= Rs {least:,}", "cycle_length": F.size("path"), "total_inr": F.col("total")}, ["TXN"])


def structuring(g: CaseGraph, threshold: int = 50_000, band: float = 0.85, least: int = 5) -> DataFrame:
    """Cash just under the threshold, again and again, by the names as written."""
    cash = g.transactions.where((F.col("mode") == "CASH") & (F.col("amount_inr") >= threshold * band) & (F.col("amount_inr") < threshold))
    rows = cash.groupBy("from_name", "to_name").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_inr").alias("total"), F.slice(F.array_sort(F.collect_list("txn_id")), 1, 20).alias("txns")).where(F.col("n") >= least)
    forms = _forms(g)
    rows = resolve_names(resolve_names(rows, "from_name", forms, "a"), "to_name", forms, "b")
    said = F.format_string(f"%d cash transactions from %s to %s totalling Rs %,d, every one of them between Rs {int(threshold * band):,} and Rs {threshold:,}.", "n", "from_name", "to_name", "total")
    return _finding(rows, "structuring", "high", F.lit("Cash deposits kept just below the reporting threshold"), said, F.array_compact(F.array("a", "b")), F.array("from_name", "to_name"), {"rule": f">= {least} cash transactions in [{int(threshold * band)}, {threshold})", "count": F.col("n"), "total_inr": F.col("total"), "txn_ids": F.col("txns")}, ["TXN"])


def _forms(g: CaseGraph) -> DataFrame:
    from weftline.cases.graph import alias_index

    return alias_index(g.people, g.orgs)


def insulated(g: CaseGraph, s: Scores, least: int = 6) -> DataFrame:
    """High on the list through position, with contacts among the two weakest
    parts of the score, and several handsets or a record."""
    people = s.influence.where("type = 'PERSON'")
    size = people.agg(F.count(F.lit(1)).alias("people"))
    lower = sum((F.when(F.col(f"phi_{k}") < F.col("phi_degree"), 1).otherwise(0) for k in WEIGHTS if k != "degree"), F.lit(0))
    rows = people.crossJoin(F.broadcast(size)).where((F.col("people") >= least) & (F.col("rank") <= F.greatest(F.lit(5), F.floor(F.col("people") / 4))) & F.col("top_driver").isin("betweenness", "eigenvector") & (lower <= 1))
    rows = rows.select("node", "rank", "phi_degree", "top_driver").join(g.nodes.select(F.col("id").alias("node"), "label", F.size("phones").alias("handsets"), F.coalesce("prior_cases", F.lit(0)).alias("priors")), "node").where("handsets >= 2 OR priors >= 3")
    said = F.format_string("%s ranks %d by influence through position between others; contacts add %.3f. %d handset(s), %d prior case(s).", "label", "rank", "phi_degree", "handsets", "priors")
    return _finding(rows, "insulated_actor", "high", F.concat("label", F.lit(" appears insulated behind intermediaries")), said, F.array("node"), F.array("label"), {"rule": "influence rank in the top quartile, driven by betweenness/eigenvector and held back by degree, plus multiple handsets or >= 3 prior cases", "influence_rank": F.col("rank"), "top_driver": F.col("top_driver"), "attributed_handsets": F.col("handsets"), "prior_cases": F.col("priors")}, ["CDR", "FIR", "SUR"])


def clean_skins(g: CaseGraph, flagged: int = 3, direct: int = 2, worst: int = 4) -> DataFrame:
    """Checked, nothing found, and within three hops of somebody flagged. A
    person who was never checked is not clean."""
    hop = both_ways(person_edges(g)).select("u", "v").distinct()
    person = g.nodes.where("type = 'PERSON'").select("id", "label", "prior_cases")
    start = person.where("prior_cases <= 0").select(F.col("id").alias("s"))
    reached = start.select("s", F.col("s").alias("v"), F.lit(0).alias("d"))
    for k in (1, 2, 3):
        wave = reached.where(F.col("d") == k - 1).select("s", F.col("v").alias("u")).join(hop, "u").select("s", "v").distinct()
        reached = materialize(reached.unionByName(wave.join(reached.select("s", "v"), ["s", "v"], "left_anti").withColumn("d", F.lit(k))), "reach")
    met = reached.join(person.select(F.col("id").alias("v"), F.col("label").alias("vl"), F.coalesce("prior_cases", F.lit(0)).alias("p")), "v")
    rows = met.groupBy("s").agg(F.array_sort(F.collect_set(F.when(F.col("p") >= flagged, F.col("vl")))).alias("far"), F.array_sort(F.collect_set(F.when((F.col("d") == 1) & (F.col("p") >= direct), F.col("vl")))).alias("near"), F.max("p").alias("worst")).where(F.size("far") > 0)
    rows = rows.join(person.select(F.col("id").alias("s"), "label"), "s")
    said = F.concat(F.format_string("%s carries no prior record. Within three hops they reach %s", "label", F.array_join("far", ", ")), F.when(F.size("near") > 0, F.concat(F.lit(", and are in direct contact with "), F.array_join("near", ", "))).otherwise(""), F.lit("."))
    return _finding(rows, "clean_skin_bridge", F.when((F.size("near") > 0) | (F.col("worst") >= worst), "high").otherwise("medium"), F.concat("label", F.lit(" has no record but is linked to flagged subjects")), said, F.array("s"), F.array("label"), {"rule": f"no prior record, but reaches a subject with >= {flagged} prior cases within 3 hops", "direct_flagged_contacts": F.col("near"), "reached_within_3_hops": F.col("far")}, ["CDR", "TXN", "SUR"])


def co_location(g: CaseGraph, minutes: int = 90, events: int = 3, cells: int = 2, talk: int = 10, keep: int = 6) -> DataFrame:
    """Two people on one cell within some minutes, again and again, at several
    places; expected, so less severe, where they often call each other. A band
    join: both sides of a pair meet in one bucket of that many minutes."""
    width = minutes * 60_000_000
    t = F.unix_micros(F.col("start_time").cast("timestamp"))
    seen = g.calls.select(t.alias("t"), "cell_tower", F.explode(F.array("caller_owner", "callee_owner")).alias("id")).where("id IS NOT NULL").withColumn("bucket", F.floor(F.col("t") / width))
    left = seen.toDF("t1", "cell", "a", "bucket")
    right = seen.select(F.col("t").alias("t2"), F.col("cell_tower").alias("cell"), F.col("id").alias("b"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    pairs = left.join(right, ["cell", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("t1") - F.col("t2")) <= width))
    rows = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("cell")).alias("cells")).where((F.col("n") >= events) & (F.size("cells") >= cells))
    rows = rows.join(g.edges.select("a", "b", F.col("call_count").alias("calls")), ["a", "b"], "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    name = lambda c: g.nodes.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    rows = rows.join(name("a"), "a").join(name("b"), "b").withColumn("sev", F.when(F.col("calls") >= talk, "medium").otherwise("high"))
    title = F.format_string("%s and %s repeatedly present together", "la", "lb")
    rows = rows.withColumn("title", title).orderBy(F.col("sev") != "high", F.desc("n"), "title").limit(keep)
    said = F.format_string(f"Handsets active on the same cell site within {minutes} minutes on %d occasions across %d different locations (%s).", "n", F.size("cells"), F.array_join("cells", ", "))
    return _finding(rows, "repeated_co_location", F.col("sev"), F.col("title"), said, F.array("a", "b"), F.array("la", "lb"), {"rule": f">= {events} same-cell events within {minutes} minutes, across >= {cells} cell sites", "events": F.col("n"), "cell_sites": F.col("cells"), "calls_between_them": F.col("calls")}, ["CDR"])


def custody(g: CaseGraph, held: DataFrame, least: int = 3) -> DataFrame:
    """A number in use while its owner is in custody; an interval may be open.
    ``held``: name, case_id, court, custody_status, custody_from, custody_to."""
    inside = held.where("custody_status = 'Judicial custody' AND custody_from IS NOT NULL")
    inside = resolve_names(inside, "name", _forms(g), "id").where("id IS NOT NULL").join(g.nodes.select("id", "label", "phones"), "id")
    number = inside.select("id", "label", "name", "case_id", "court", "custody_from", "custody_to", "phones", F.explode("phones").alias("phone"))
    ends = g.calls.select("call_id", "start_time", "cell_tower", F.explode(F.array("caller", "callee")).alias("phone"))
    day = F.to_date("start_time")
    used = number.join(ends, "phone").where((day >= F.col("custody_from")) & (F.col("custody_to").isNull() | (day <= F.col("custody_to"))))
    rows = used.dropDuplicates(["id", "case_id", "custody_from", "call_id"]).groupBy("id", "label", "case_id", "court", "custody_from", "custody_to").agg(F.count(F.lit(1)).alias("n"), F.max("start_time").alias("last"), F.array_sort(F.collect_set("cell_tower")).alias("cells")).where(F.col("n") >= least)
    said = F.format_string("%s is in judicial custody from %s in case %s (%s); the number shows %d call events up to %s, on cell sites %s.", "label", F.col("custody_from").cast("string"), "case_id", "court", "n", F.date_format("last", "yyyy-MM-dd"), F.array_join("cells", ", "))
    return _finding(rows, "custody_conflict", "high", F.concat("label", F.lit("'s handset was in use during judicial custody")), said, F.array("id"), F.array("label"), {"rule": "CDR activity on an attributed handset inside a period of judicial custody", "custody_from": F.col("custody_from"), "custody_to": F.col("custody_to"), "case": F.col("case_id"), "events_during_custody": F.col("n"), "cell_sites": F.col("cells")}, ["ICJS", "CDR"])


def brokers(g: CaseGraph, s: Scores, least: int = 2) -> DataFrame:
    """People whose neighbours belong to several other communities."""
    group = s.communities
    near = both_ways(person_edges(g)).join(group.toDF("u", "own"), "u").join(group.toDF("v", "other"), "v").where("own <> other")
    rows = near.groupBy(F.col("u").alias("id"), "own").agg(F.array_sort(F.collect_set("other")).alias("groups")).where(F.size("groups") >= least).join(g.nodes.where("type = 'PERSON'").select("id", "label"), "id")
    title = F.format_string("%s bridges %d separate groups", "label", F.size("groups") + 1)
    said = F.format_string("%s is the point of contact between %d otherwise weakly connected clusters.", "label", F.size("groups") + 1)
    return _finding(rows, "cross_community_broker", "medium", title, said, F.array("id"), F.array("label"), {"rule": f"neighbours span >= {least} foreign communities", "own_community": F.col("own"), "bridged_communities": F.col("groups")}, ["CDR", "TXN", "FIR"])


def run_all(g: CaseGraph, s: Scores, held: DataFrame | None = None) -> DataFrame:
    """Every finding, high before medium, then by type and title, numbered."""
    parts = [bursts(g), burners(g), circular(g), structuring(g), insulated(g, s), clean_skins(g), co_location(g), brokers(g, s)]
    if held is not None:
        parts.append(custody(g, held))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    ordered = numbered(materialize(out, "found"), [place, "type", "title", F.to_json("entities")], "_n")
    return materialize(ordered.withColumn("id", F.format_string("A%03d", "_n")).drop("_n"), "findings")
