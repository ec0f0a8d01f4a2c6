"""Reports and the dashboard: small aggregates, worded on the driver.

Every figure is a plan; what comes to the driver is a subject's links, a few
paths, or a row a kind.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.cases.detectors import Scores
from weftline.cases.graph import CaseGraph, corroboration, paths, stats

LIMITS = (
    "A missing link is no evidence that there is no relationship.",
    "People named in one document are associated by it, not shown to take part.",
    "Material from social media is unverified and weighs accordingly.",
    "This is an aid to investigation, not evidence; verify before acting.",
)
OPENERS = frozenset("The This They There It A An No Both Flagged Strongest Their He She In On At".split())


def links_of(g: CaseGraph, node: str) -> DataFrame:
    """A node's links, those with most source systems first, then the surest."""
    mine = corroboration(g.edges).where((F.col("a") == node) | (F.col("b") == node))
    other = F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a"))
    said = F.filter(F.transform(F.slice("sources", 1, 3), lambda s: s["evidence"]), lambda e: F.coalesce(e, F.lit("")) != "")
    rows = mine.select(other.alias("node"), "types", "confidence", "observations", "independent_sources", "first_seen", "last_seen", said.alias("evidence"))
    return rows.join(g.nodes.select(F.col("id").alias("node"), "label", "type"), "node").orderBy(F.desc(F.size("independent_sources")), F.desc("confidence"), "node")


def subject_report(g: CaseGraph, s: Scores, findings: DataFrame, node: str) -> dict:
    d = g.nodes.where(F.col("id") == node).first()
    if d is None:
        raise KeyError(node)
    me, n = s.influence.where(F.col("node") == node).first(), s.influence.count()
    links = links_of(g, node).collect()
    flagged = findings.where(F.array_contains("entities", node)).orderBy("id").collect()
    lines = [f"## Subject profile: {d['label']}", ""]
    for title, key in (("Recorded name variants", "aliases"), ("Attributed numbers", "phones"), ("Accounts", "accounts")):
        if d[key]:
            lines.append(f"**{title}:** {', '.join(d[key])}  ")
    checked = d["prior_cases"] is not None
    lines += [f"**Criminal history:** {d['prior_cases']} prior case(s)  " if checked else "**Criminal history:** no entry located: *not found*, not *cleared*.  ", ""]
    if me:
        lines += ["### Position in the network", f"Ranked **{me['rank']}** of {n} by influence (score {me['score']:.3f}). {me['why']}", ""]
    if d["merge_evidence"]:
        lines += ["### Identity resolution", *(f"- {m}" for m in d["merge_evidence"][:8]), ""]
    lines += ["### Established links", "", "| Linked to | Relationship | Sources | Confidence |", "|---|---|---|---|"]
    lines += [f"| {r['label']} ({r['type']}) | {', '.join(r['types'])} | {', '.join(r['independent_sources'])} | {r['confidence']:.2f} |" for r in links[:15]]
    if flagged:
        lines += ["", "### Flagged patterns involving this subject", *(f"- **{f['title']}** ({f['severity']}): {f['description']}" for f in flagged)]
    lines += ["", "### Limitations", *(f"- {x}" for x in LIMITS)]
    facts = {"label": d["label"], "source_count": len(d["sources"]), "aliases": d["aliases"], "prior_cases": d["prior_cases"], "rank": me["rank"] if me else None, "population": n, "top_driver": me["top_driver"] if me else None, "top_links": [r["label"] for r in links[:3]], "finding_titles": [f["title"] for f in flagged[:3]]}
    return {"node": node, "label": d["label"], "markdown": "\n".join(lines), "narrative": narrate_subject(facts), "links": links, "findings": flagged, "influence": me}


def link_report(g: CaseGraph, edges: DataFrame, a: str, b: str, cutoff: int = 5) -> dict:
    """``edges``: between people and organisations."""
    label = {r["id"]: r["label"] for r in g.nodes.where(F.col("id").isin(a, b)).select("id", "label").collect()}
    if len(label) < len({a, b}):
        raise KeyError(a if a not in label else b)
    found = paths(edges, a, b, cutoff).collect()
    lines = [f"## Connection analysis: {label[a]} and {label[b]}", ""]
    if not found:
        return {"markdown": "\n".join([*lines, f"No connection was found within {cutoff} hops in the records supplied."]), "paths": [], "narrative": ""}
    nodes = sorted({n for p in found for n in p["path"]})
    label = {r["id"]: r["label"] for r in g.nodes.where(F.col("id").isin(nodes)).select("id", "label").collect()}
    best = found[0]
    steps = list(zip(best["path"], best["path"][1:], strict=False))
    legs = {(r["a"], r["b"]): r for r in corroboration(edges).where(F.col("a").isin(best["path"]) & F.col("b").isin(best["path"])).collect()}
    lines += [f"The shortest connection has **{best['hops'] - 1} intermediaries** and rests on {', '.join(best['source_types'])} records.", "", "**" + " → ".join(label[n] for n in best["path"]) + "**", "", "### How each step is established"]
    for k, (x, y) in enumerate(steps, 1):
        leg = legs[min(x, y), max(x, y)]
        lines.append(f"{k}. **{label[x]} → {label[y]}** ({', '.join(leg['types'])}, confidence {leg['confidence']:.2f}, {leg['observations']} observation(s))")
        lines += [f"   - `{s['source_type']}:{s['source_id']}`: {s['evidence']}" for s in leg["sources"][:2] if s["evidence"]]
    if found[1:]:
        lines += ["", "### Alternative routes", *(f"- {' → '.join(label[n] for n in p['path'])} ({p['hops']} hops)" for p in found[1:4])]
    lines += ["", "### Reading this correctly", "A path shows how information or money *could* travel. It proves neither acquaintance nor a common purpose."]
    return {"markdown": "\n".join(lines), "paths": found, "narrative": narrate_path([label[n] for n in best["path"]], best["hops"], best["source_types"])}


def overview(g: CaseGraph, s: Scores, findings: DataFrame) -> dict:
    n, high = stats(g), findings.where("severity = 'high'").orderBy("id").collect()
    groups = s.communities.select("community").distinct().count()
    lines = ["# Network analysis summary", "", f"From {n['source_documents']} documents, {len(n['edges_by_type'])} relationship types.", ""]
    lines += [f"- **{n['entities']} individuals** from {n['mentions']} mentions ({n['merge_decisions']} merges).", f"- **{n['nodes']} entities**, **{n['edges']} relationships**.", f"- **{groups} sub-groups**.", f"- **{len(high)} high-severity patterns**.", "", "## Most influential", "", "| Rank | Name | Score | Group |", "|---|---|---|---|"]
    lines += [f"| {r['rank']} | {r['label']} | {r['score']:.3f} | {r['community']} |" for r in s.influence.orderBy("rank").limit(8).collect()]
    lines += ["", "## High-severity findings", *(f"### {f['title']}\n{f['description']}\n" for f in high), "## Caveats", "All findings are machine-made leads for human review."]
    return {"markdown": "\n".join(lines), "stats": n}


def dashboard(g: CaseGraph, s: Scores, findings: DataFrame) -> dict[str, DataFrame]:
    """The panels as plans."""
    week = lambda c: F.date_format(F.date_trunc("week", F.col(c).cast("timestamp")), "yyyy-MM-dd")
    calls = g.calls.where("caller_owner IS NOT NULL OR callee_owner IS NOT NULL").groupBy(week("start_time").alias("week")).agg(F.count(F.lit(1)).alias("calls"))
    paid = g.transactions.groupBy(week("timestamp").alias("week")).agg(F.count(F.lit(1)).alias("transactions"))
    backed = corroboration(g.edges)
    source = g.edges.select("a", "b", F.explode("sources").alias("s"))
    return {
        "severity": findings.groupBy("severity").agg(F.count(F.lit(1)).alias("count")),
        "findings_by_type": findings.groupBy("type").agg(F.count(F.lit(1)).alias("value"), F.count_if(F.col("severity") == "high").alias("high")).orderBy(F.desc("value"), "type"),
        "by_source": source.groupBy(F.col("s.source_type").alias("source_type")).agg(F.count_distinct("a", "b").alias("edges"), F.count(F.lit(1)).alias("observations")).orderBy(F.desc("edges"), "source_type"),
        "corroboration": backed.groupBy("level").agg(F.count(F.lit(1)).alias("edges")).orderBy("level"),
        "activity": calls.join(paid, "week", "full_outer").select("week", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("transactions", F.lit(0)).alias("transactions")).orderBy("week"),
        "top_subjects": s.influence.where("type = 'PERSON'").select("node", "label", "score", "rank", "community", "top_driver").orderBy("rank").limit(8),
        "community_risk": s.communities.join(g.nodes.select(F.col("id").alias("node"), F.coalesce("prior_cases", F.lit(0)).alias("p")), "node").groupBy("community").agg(F.sum("p").alias("prior_cases")),
        "highlights": g.edges.agg(F.count_if(F.col("first_seen").isNull()).alias("undated_edges")),
        "top_findings": findings.orderBy("id").limit(6),
    }


# --- narrative: worded from facts only


def narrate_subject(f: dict) -> str:
    out = f"{f['label']} appears in {f['source_count']} source record(s)" + (f", under {len(f['aliases']) + 1} different spellings." if f["aliases"] else ".")
    out += f" {f['prior_cases']} prior case(s) are on record." if f["prior_cases"] else " No prior case was found on a check." if f["prior_cases"] == 0 else " No criminal-history entry was located, which means not checked."
    if f["rank"]:
        out += f" The subject ranks {f['rank']} of {f['population']} by influence, driven mainly by {f['top_driver']}."
    for lead, key in ((" Strongest links: ", "top_links"), (" Flagged patterns: ", "finding_titles")):
        if f[key]:
            out += lead + ", ".join(f[key]) + "."
    return out


def narrate_path(labels: list[str], hops: int, kinds: list[str]) -> str:
    through = " then ".join(labels[1:-1])
    link = f"are linked through {through}, over {hops} steps" if through else "are directly linked"
    return f"{labels[0]} and {labels[-1]} {link}, on the strength of {', '.join(kinds)} material. This is a lead to verify, not a finding of association."


def strangers(text: str, facts: list[str]) -> list[str]:
    """Names in a draft that no fact has: a draft with any is not used."""
    known = {w for f in facts for w in re.findall(r"[A-Z][a-zA-Z]{2,}", f)} | OPENERS
    return sorted(set(re.findall(r"[A-Z][a-zA-Z]{2,}", text)) - known)
