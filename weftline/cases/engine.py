"""A case as one object: every question a user may ask, checked and logged."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.cases import adapters, detectors, export, extraction, graph, questions, reports, sources
from weftline.functions.text import decrypt, encrypt
from weftline.operators import audit
from weftline.session import materialize

_WORK = {"graph:read", "entity:read", "evidence:read", "query:run", "report:generate", "data:submit"}
#: What a role may do.
ROLES = {"investigator": frozenset(_WORK), "admin": frozenset(_WORK | {"audit:read", "analytics:tune", "data:ingest", "user:manage"})}


@dataclass(frozen=True)
class User:
    name: str
    role: str

    @property
    def permissions(self) -> frozenset[str]:
        return ROLES.get(self.role, frozenset())


class Denied(PermissionError):
    pass


class Engine:
    """Reads and writes one folder. Graph, scores and findings are built when
    first needed and dropped when records come in. Every answer is checked
    against the user's role and written to a hash-chained log, denials too;
    with ``key`` (16, 24 or 32 bytes) the log's payloads are encrypted, and the
    chain covers what is stored."""

    def __init__(self, spark: SparkSession, folder: str, book: extraction.Gazetteer | None = None, places: dict | None = None, outside: dict | None = None, pages: DataFrame | None = None, key: bytes | None = None):
        self.spark, self.folder, self.book, self.places = spark, folder, book or extraction.Gazetteer(), places
        self.outside, self.pages, self.key = outside or adapters.adapters(), pages, key

    # --- built on demand

    @cached_property
    def graph_(self) -> graph.CaseGraph:
        return graph.build(self.spark, self.folder, self.book, self.places, self.pages)

    @cached_property
    def scores(self) -> detectors.Scores:
        return detectors.score(self.graph_)

    @cached_property
    def findings_(self) -> DataFrame:
        justice = self.outside.get("icjs")
        held = justice.fetch(self.spark, "internal consistency check") if justice and justice.path else None
        return detectors.run_all(self.graph_, self.scores, held)

    @cached_property
    def names(self) -> questions.Names:
        return questions.Names(self.graph_.nodes)

    @cached_property
    def person_edges(self) -> DataFrame:
        return materialize(graph.person_edges(self.graph_), "person-edges")

    def reload(self) -> None:
        for name in ("graph_", "scores", "findings_", "names", "person_edges"):
            self.__dict__.pop(name, None)

    # --- permission and log

    def _log(self, user: User, action: str, **detail) -> None:
        path, payload = f"{self.folder}/audit", json.dumps(detail, ensure_ascii=False, sort_keys=True, default=str)
        log = self.audit_log()
        last = log.orderBy(F.desc("seq")).first() if log is not None else None
        if self.key:
            payload = self.spark.range(1).select(encrypt(F.lit(payload), self.key).alias("p")).first()["p"]
        entry = {"at": datetime.now(UTC).isoformat(timespec="seconds"), "who": user.name, "role": user.role, "action": action, "payload": payload}
        audit.append(self.spark, [entry], last).write.mode("append").parquet(path)

    def audit_log(self) -> DataFrame | None:
        path = f"{self.folder}/audit"
        return self.spark.read.schema(audit.SCHEMA).parquet(path) if sources._exists(self.spark, path) else None

    def _may(self, user: User, permission: str, action: str, **detail) -> None:
        if permission not in user.permissions:
            self._log(user, "ACCESS_DENIED", permission=permission)
            raise Denied(f"{user.role} may not {permission}")
        self._log(user, action, **detail)

    # --- answers

    def me(self, user: User) -> dict:
        return {"name": user.name, "role": user.role, "permissions": sorted(user.permissions)}

    def stats(self, user: User) -> dict:
        self._may(user, "graph:read", "VIEW_STATS")
        high = self.findings_.where("severity = 'high'").count()
        return graph.stats(self.graph_) | {"high_severity": high, "communities": self.scores.communities.select("community").distinct().count(), "ocr": adapters.ocr_capabilities(), "integrations": sorted(self.outside), "live_store": export.live_available()}

    def graph(self, user: User, min_confidence: float = 0.0, edge_types: list[str] | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        self._may(user, "graph:read", "VIEW_GRAPH", min_confidence=min_confidence, edge_types=edge_types, types=types)
        return graph.filtered(self.graph_, min_confidence, edge_types, types, redact="entity:read" not in user.permissions)

    def dashboard(self, user: User) -> dict[str, DataFrame]:
        self._may(user, "graph:read", "VIEW_DASHBOARD")
        return reports.dashboard(self.graph_, self.scores, self.findings_)

    def entities(self, user: User) -> DataFrame:
        self._may(user, "entity:read", "LIST_ENTITIES")
        return self.graph_.nodes.select("id", "label", "type", "aliases", "phones", "prior_cases")

    def entity(self, user: User, node: str) -> dict:
        self._may(user, "entity:read", "VIEW_ENTITY", node=node)
        return reports.subject_report(self.graph_, self.scores, self.findings_, node)

    def influencers(self, user: User, limit: int = 15) -> DataFrame:
        self._may(user, "graph:read", "VIEW_INFLUENCERS", limit=limit)
        return self.scores.influence.orderBy("rank").limit(limit)

    def communities(self, user: User) -> DataFrame:
        self._may(user, "graph:read", "VIEW_COMMUNITIES")
        return self._groups()

    def _groups(self) -> DataFrame:
        named = self.scores.communities.join(self.graph_.nodes.select(F.col("id").alias("node"), "label", "type"), "node")
        return named.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("node", "label", "type"))).alias("members")).orderBy("community")

    def path(self, user: User, a: str, b: str, cutoff: int = 5) -> dict:
        self._may(user, "evidence:read", "TRACE_PATH", a=a, b=b, cutoff=cutoff)
        return reports.link_report(self.graph_, self.person_edges, a, b, cutoff)

    def evidence(self, user: User, a: str, b: str) -> DataFrame:
        self._may(user, "evidence:read", "VIEW_EVIDENCE", a=a, b=b)
        return graph.evidence(self.graph_, a, b)

    def findings(self, user: User, severity: str | None = None) -> DataFrame:
        self._may(user, "graph:read", "VIEW_FINDINGS", severity=severity)
        return (self.findings_.where(F.col("severity") == severity) if severity else self.findings_).orderBy("id")

    def corroboration(self, user: User, min_level: int = 2) -> DataFrame:
        self._may(user, "graph:read", "VIEW_CORROBORATION")
        return graph.corroboration(self.graph_.edges).where(F.col("level") >= min_level).orderBy(F.desc("level"), F.desc("confidence"), "a", "b")

    def ask(self, user: User, text: str) -> tuple[questions.Question, object]:
        """The question as understood, and its answer."""
        found = questions.parse(text, self.names)
        self._may(user, "query:run", "NL_QUERY", question=text, intent=found.intent, interpretation=found.interpretation)
        p = found.params
        answers = {
            "path": lambda: reports.link_report(self.graph_, self.person_edges, p["a"], p["b"], p["cutoff"]),
            "neighbourhood": lambda: graph.neighbourhood(self.graph_.edges, p["node"], p["hops"]).join(self.graph_.nodes, "id"),
            "influencers": lambda: self.scores.influence.orderBy("rank").limit(p["limit"]),
            "anomalies": lambda: self.findings_.orderBy("id"),
            "transactions": lambda: self.transactions_of(p["min_amount"], p["node"]),
            "calls": lambda: self.calls_of(p["node"]),
            "communities": self._groups,
            "entity": lambda: reports.subject_report(self.graph_, self.scores, self.findings_, p["node"]),
            "unknown": lambda: None,
        }
        return found, answers[found.intent]()

    def transactions_of(self, least: int = 0, node: str | None = None, most: int = 100) -> DataFrame:
        """The largest transactions; of a node by any of its names or accounts
        on either side."""
        rows = self.graph_.transactions.where(F.col("amount_inr") >= least)
        if node:
            me = self.graph_.nodes.where(F.col("id") == node).select(F.concat(F.array("label"), "aliases").alias("forms"), F.col("accounts").alias("own"))
            hit = F.array_contains("forms", F.col("from_name")) | F.array_contains("forms", F.col("to_name")) | F.array_contains("own", F.col("from_account")) | F.array_contains("own", F.col("to_account"))
            rows = rows.crossJoin(F.broadcast(me)).where(F.coalesce(hit, F.lit(False))).drop("forms", "own")  # one row
        return rows.orderBy(F.desc("amount_inr"), "txn_id").limit(most)

    def calls_of(self, node: str | None = None) -> DataFrame:
        rows = graph.corroboration(self.graph_.edges).where(F.array_contains("types", "CALLED"))
        return rows.where((F.col("a") == node) | (F.col("b") == node)) if node else rows

    def overview(self, user: User) -> dict:
        self._may(user, "report:generate", "GENERATE_OVERVIEW_REPORT")
        out = reports.overview(self.graph_, self.scores, self.findings_)
        return out | {"sha256": export.digest("Case overview", out["markdown"])}

    def document(self, user: User, source_id: str) -> DataFrame:
        self._may(user, "evidence:read", "VIEW_DOCUMENT", source=source_id)
        return self.graph_.documents.where(F.col("source_id") == source_id)

    def pipeline(self, user: User, mentions: int = 400, decisions: int = 200) -> tuple[DataFrame, DataFrame]:
        """What extraction and linking did: the first rows of each."""
        self._may(user, "graph:read", "VIEW_PIPELINE")
        said = extraction.with_context(self.graph_.mentions, self.graph_.documents)
        return said.orderBy("source_type", "source_id", "start", "type").limit(mentions), self.graph_.decisions.orderBy("same", "a", "b", "reason").limit(decisions)

    def preview(self, user: User, key: str, authorisation: str = "", **query: str) -> DataFrame:
        self._may(user, "evidence:read", "PREVIEW_SOURCE", source=key, authorisation=authorisation)
        if key not in self.outside:
            raise KeyError(key)
        return self.outside[key].fetch(self.spark, authorisation, **query)

    def integrations(self, user: User) -> list[dict]:
        self._may(user, "graph:read", "VIEW_INTEGRATIONS")
        return [a.status() for a in self.outside.values()]

    def export(self, user: User, path: str, form: str = "cypher") -> None:
        self._may(user, "report:generate", "EXPORT_GRAPH", form=form)
        {"cypher": export.write_statements, "json": export.write_json}[form](self.graph_, path)

    # --- intake

    def quick_add(self, user: User, kind: str, **fields) -> dict:
        self._may(user, "data:submit", "QUICK_ADD", kind=kind)
        record = sources.quick_add(self.spark, self.folder, kind, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S"), **fields)
        self.reload()
        return record

    def upload(self, user: User, kind: str, path: str, mode: str = "append") -> dict:
        self._may(user, "data:ingest", "BULK_UPLOAD", kind=kind, mode=mode)
        out = sources.bulk_upload(self.spark, self.folder, kind, path, mode)
        self.reload()
        return out

    def new_case(self, user: User) -> list[str]:
        self._may(user, "data:ingest", "NEW_CASE")
        out = sources.clear_all(self.spark, self.folder)
        self.reload()
        return out

    # --- the log

    def read_audit(self, user: User, limit: int = 200) -> DataFrame:
        """The latest entries, newest first, payloads readable with the key."""
        self._may(user, "audit:read", "VIEW_AUDIT_LOG")
        rows = self.audit_log().orderBy(F.desc("seq")).limit(min(limit, 1000))
        return rows.withColumn("payload", decrypt(F.col("payload"), self.key)) if self.key else rows

    def verify_audit(self, user: User):
        self._may(user, "audit:read", "VERIFY_AUDIT")
        return audit.verify(self.audit_log()).first()
