"""A small made-up case, from its files to answers."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.cases import adapters, detectors, entities, export, extraction, graph, questions, reports, sources
from weftline.cases.engine import Denied, Engine, User
from weftline.functions import text as tx
from weftline.operators.communities import communities, spread
from weftline.operators.names import skeleton
from weftline.operators.numbering import numbered
from weftline.streaming import bursts as streaming

BOOK = extraction.Gazetteer(
    people=frozenset({"Tomas Varga", "Ilka Brandt", "तोमस वर्गा"}), orgs=frozenset({"Brandt Freight Ltd"}), places={"Harbour Gate": "Harbour Gate", "हार्बर": "Harbour Gate"},
    name_words=frozenset({"varga", "brandt", "okafor", "lindqvist"}), deva_stops=frozenset({"मोबाइल"}),
)


def test_text_functions(spark):
    assert tx.romanized("विक्रम") == "vikrama" and tx.romanized("नायर ok") == "nayara ok" and tx.romanized("क़ फ़ं") == "qa fan"
    assert tx.romanized(None) == "" and skeleton(tx.romanized("इमरान")) == skeleton("Imran")
    words = ["Phillip", "Sheikh", "qureshi", "", "x-y", "Aa", "बब"]
    row = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.skeleton(F.col("w")).alias("k")).collect()
    assert {r["w"]: r["k"] for r in row} == {w: skeleton(w) for w in words}
    rows = [("वर्गा तोमस", "९८७ Rs 2.5 lakh"), ("Tomas  Varga", "pay 1,500"), (None, None), ("", "5 crore and 7 k")]
    out = spark.createDataFrame(rows, "n string, t string").select(tx.name_key(F.col("n")).alias("k"), tx.ascii_digits(F.col("t")).alias("d"), tx.amount(F.col("t")).alias("a"), tx.script(F.col("n")).alias("s")).collect()
    assert out[0]["k"] == out[1]["k"] == ["tms", "vrg"] and out[2]["k"] == [] and out[0]["s"] == "devanagari"
    assert out[0]["d"].startswith("987") and [r["a"] for r in out[1:]] == [1500, None, 50_000_000]
    key = b"0123456789abcdef"
    sealed = spark.createDataFrame([("secret é",)], "t string").select(tx.encrypt(F.col("t"), key).alias("c"))
    assert sealed.select(tx.decrypt(F.col("c"), key), tx.decrypt(F.col("c"), b"x" * 16)).first()[:] == ("secret é", None)


def test_mentions_and_overlaps():
    read = extraction.Extractor(BOOK)
    text = "Tomas Varga of Brandt Freight Ltd met N. Okafor near Harbour Gate. Call ९८७६५४३२१० or MH 12 AB 1234, Rs. 2,50,000 on 01/02/2024"
    found = [(text[s:e], kind) for s, e, kind, *_ in read(text)]
    assert found == [("Tomas Varga", "PERSON"), ("Brandt Freight Ltd", "ORG"), ("N. Okafor", "PERSON"), ("Harbour Gate", "LOCATION"), ("९८७६५४३२१०", "PHONE"), ("MH 12 AB 1234", "VEHICLE"), ("2,50,000", "MONEY"), ("01/02/2024", "DATE")]
    deva = read("मोबाइल तोमस वर्गा हार्बर")
    assert [(m[2], m[5], m[6]) for m in deva] == [("PERSON", "devanagari", "Tomasa Varga"), ("LOCATION", "devanagari", "Harbour Gate")]
    assert read("") == [] and extraction.Extractor(extraction.Gazetteer())("Tomas Varga") == []
    more = extraction.Extractor(BOOK, lambda t: [(0, 5, "ORG", 0.85)])
    assert [m[2] for m in more("Tomas Varga")] == ["ORG"]


def plain_settle(found):
    """Every mention against all that stand: quadratic."""
    kept = []
    for m in sorted(found, key=lambda m: (m[0], m[0] - m[1], -m[3])):
        drop = False
        for k in list(kept):
            if m[1] <= k[0] or m[0] >= k[1]:
                continue
            a, b = extraction.RANK.get(k[2], 0), extraction.RANK.get(m[2], 0)
            if k[2] == m[2] or (a and b and b <= a):
                drop = True
                break
            if a and b:
                kept.remove(k)
        if not drop:
            kept.append(m)
    return kept


def test_overlaps_against_all_pairs():
    rng = random.Random(1)
    for _ in range(500):
        found = []
        for n in range(rng.randint(0, 12)):
            s = rng.randint(0, 30)
            found.append((s, s + rng.randint(1, 12), rng.choice(["ORG", "LOCATION", "PERSON", "PHONE"]), rng.random(), str(n), "latin", str(n)))
        assert extraction.settle(list(found)) == plain_settle(list(found))


def test_cues():
    cues = extraction.Cues()
    persons = ["Tomas Varga", "Ilka Brandt"]
    assert [(p, o) for p, o, *_ in cues.owned("A SIM was issued to Mr Ilka Brandt at mobile 9876543210. Contact 9000000000 maybe. known number 9111111111", persons)] == [("9876543210", "Ilka Brandt"), ("9111111111", "Tomas Varga")]
    said = cues.related("working under Ilka Brandt. The director of Brandt Freight Ltd is recorded as Tomas Varga, he says", sorted(persons))
    assert [(a, b, k, t) for a, b, k, t, *_ in said] == [("Tomas Varga", "Brandt Freight Ltd", "ORG", "DIRECTOR_OF")]
    assert cues.owned("call 9876543210", []) == [] and cues.related("", []) == []


def test_intake(spark, tmp_path):
    folder = str(tmp_path / "case")
    first, more, bad = (str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv"))
    head = "record_id,name,phone,prior_cases,offence_categories,active_period,police_district\n"
    open(first, "w", encoding="utf-8-sig").write(head + "R1,Tomas Varga,9876543210,0,-,-,N\nR2,Ilka Brandt,,3,theft,2019,N\n")
    open(more, "w").write(head + "R2,Somebody Else,1,1,x,x,x\nR3,New One,2,1,x,x,x\nR3,Newer One,3,1,x,x,x\n")
    open(bad, "w").write("record_id,name\nR9,x\n")
    assert sources.bulk_upload(spark, folder, "criminal_records", first) == {"kind": "criminal_records", "mode": "append", "records_in_file": 2, "records_added": 2}
    assert sources.bulk_upload(spark, folder, "criminal_records", more)["records_added"] == 1
    rows = {r["record_id"]: r["name"] for r in sources.table(spark, folder, "criminal_records").collect()}
    assert rows == {"R1": "Tomas Varga", "R2": "Ilka Brandt", "R3": "New One"}
    assert sources.bulk_upload(spark, folder, "criminal_records", more, "replace")["records_in_file"] == 2
    with pytest.raises(sources.IntakeError, match="missing"):
        sources.read_file(spark, "criminal_records", bad)
    good, broken = str(tmp_path / "g.json"), str(tmp_path / "n.json")
    json.dump([{"post_id": "SM/2026/0007", "text": "hi", "posted_on": "2024-01-02T03:04:05"}], open(good, "w"))
    json.dump([{"text": "no id"}], open(broken, "w"))
    assert sources.bulk_upload(spark, folder, "social", good)["records_added"] == 1
    with pytest.raises(sources.IntakeError, match="post_id"):
        sources.read_file(spark, "social", broken)
    assert sources.quick_add(spark, folder, "social", "2024-02-01T00:00:00", text=" more ")["post_id"] == "SM/2026/0008"
    assert sources.quick_add(spark, folder, "fir", "2024-02-01T00:00:00", narrative="x")["fir_id"] == "FIR/2026/0001"
    for kind, fields in (("social", {"text": " "}), ("cdr", {})):
        with pytest.raises(sources.IntakeError):
            sources.quick_add(spark, folder, kind, "2024-02-01T00:00:00", **fields)
    assert sorted(r["source_type"] for r in sources.texts(spark, folder).collect()) == ["fir", "social_media", "social_media"]
    assert sources.clear_all(spark, folder) and sources.texts(spark, folder).count() == 0
    assert sources.safe_name("a b/../c.png") == "a_b_.._c.png"


def test_adapters_and_pages(spark, tmp_path):
    path = str(tmp_path / "j.json")
    json.dump([{"personName": "Tomas Varga", "custodyStatus": "Judicial custody", "custodyFrom": "2024-01-01"}, {"personName": "Else"}], open(path, "w"))
    justice = adapters.adapters(justice_path=path)["icjs"]
    with pytest.raises(PermissionError):
        justice.fetch(spark)
    rows = justice.fetch(spark, "order 1", name="VARGA").collect()
    assert [(r["name"], str(r["custody_from"]), r["custody_to"]) for r in rows] == [("Tomas Varga", "2024-01-01", None)]
    assert justice.status()["mode"] == "file" and justice.status()["fields"]["personName"] == "name"
    (tmp_path / "scans").mkdir()
    for name in ("FIR_1.png", "FIR_2.jpg", "note.txt"):
        (tmp_path / "scans" / name).write_bytes(b"x")
    assert adapters.read_pages(spark, str(tmp_path / "scans")).where("NOT ok").count() == 2
    pages = spark.createDataFrame([("d/FIR_1.png", "w" * 80, 0.9, True, None), ("d/FIR_2.png", "w" * 80, 0.9, True, None), ("d/FIR_3.png", "w", 0.9, True, None)], "path string, text string, mean_confidence double, ok boolean, error string")
    held = spark.createDataFrame([("FIR/2",)], "source_id string")
    assert [r["status"] for r in adapters.admit(pages, held).orderBy("path").collect()] == ["admitted", "already held as digital text", "too little text recovered"]
    assert spark.createDataFrame([("HEAD abc  def", "abc def")], "r string, t string").select(adapters.recovered_share("r", "t")).first()[0] == 1.0


def test_entities(spark):
    rows = [("Tomas Varga", "1", ["p1"]), ("T. Varga", "2", []), ("तोमस वर्गा", "3", ["p9"]), ("Somebody", "4", ["p1"]), ("Ilka Brandt", "5", []), ("mr", "6", []), (None, "7", [])]
    seen = spark.createDataFrame([(n, s, "criminal_record", p, [], []) for n, s, p in rows], extraction.OBSERVATION)
    observed = entities.with_ids(seen)
    records = spark.createDataFrame([("1", 2, "-", "x", ""), ("2", 4, "theft", "-", "N")], "source_id string, prior_cases int, offence_categories string, active_period string, police_district string")
    decided = entities.decisions(observed)
    out = {r["label"]: r for r in entities.entities(observed, decided, records).collect()}
    assert sorted(out) == ["Ilka Brandt", "Tomas Varga"] and [out[k]["id"] for k in ("Tomas Varga", "Ilka Brandt")] == ["P0001", "P0002"]
    one = out["Tomas Varga"]
    assert one["aliases"] == sorted(["Somebody", "T. Varga", "तोमस वर्गा"]) and one["phones"] == ["p1", "p9"]
    assert (one["prior_cases"], one["offence_categories"], one["active_period"], one["police_district"]) == (4, "theft", "x", "N")
    assert out["Ilka Brandt"]["prior_cases"] is None and "shared identifier p1" in one["merge_evidence"]
    best = entities.mode_of(spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "z"), (2, "y")], "g int, v string"), ["g"], "v")
    assert sorted((r["g"], r["v"]) for r in best.collect()) == [(1, "b"), (2, "y")]


def test_numbers_and_spread(spark):
    out = numbered(spark.range(500).select((F.col("id") * 37 % 500).alias("x")).repartition(7), ["x"], "n").collect()
    assert all(r["n"] == r["x"] + 1 for r in out) and len(out) == 500
    pairs = [(a, b, 1.0) for k in ("a", "b") for a in (f"{k}1", f"{k}2", f"{k}3") for b in (f"{k}1", f"{k}2", f"{k}3") if a != b] + [("a1", "b1", 0.1), ("b1", "a1", 0.1)]
    edges = spark.createDataFrame(pairs, "u string, v string, w double")
    want = {f"{k}{i}": f"{k}1" for k in "ab" for i in (1, 2, 3)}
    assert {r["node"]: r["community"] for r in communities(edges).collect()} == want
    assert {r["node"][0]: r["community"][0] for r in spread(edges).collect()} == {"a": "a", "b": "b"}


def test_stream_follows_the_rule(spark, tmp_path):
    days = [f"2024-01-{d:02d}T{h:02d}:00:00" for d in range(1, 13) for h in range(20 if d == 6 else 1)]
    spark.createDataFrame([(t,) for t in days], "t string").select(F.col("t").cast("timestamp").alias("start_time")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("start_time timestamp").parquet(str(tmp_path / "in"))
    streaming.watch(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    held = spark.read.schema(streaming.SCHEMA).parquet(str(tmp_path / "out"))
    assert [(str(r["day"]), r["n"], r["severity"]) for r in streaming.judged(held).collect()] == [("2024-01-06", 20, "medium")]
    assert streaming.judged(held.limit(3)).count() == 0


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    folder = str(base / "case")
    numbers = {"Tomas Varga": "9000000001", "Ilka Brandt": "9000000002", "Nils Okafor": "9000000003", "Vera Lindqvist": "9000000004", "Anton Reyes": "9000000005", "Marta Kiss": "9000000006", "Olga Petrov": "9000000007"}
    phone = list(numbers.values())
    put = lambda kind, rows: spark.createDataFrame([Row(**{c: r.get(c) for c in sources.KINDS[kind].schema.names}) for r in rows], sources.KINDS[kind].columns.replace("timestamp_ntz", "string")).select(*(F.col(f.name).cast(f.dataType) for f in sources.KINDS[kind].schema)).write.parquet(f"{folder}/{kind}")
    priors = [0, 1, 2, 3, None, 0, 5]
    put("criminal_records", [{"record_id": f"R{i}", "name": n, "phone": p, "prior_cases": k, "offence_categories": "-"} for i, ((n, p), k) in enumerate(zip(numbers.items(), priors, strict=True)) if k is not None] + [{"record_id": "R9", "name": "Tomas Varga", "phone": "9000000011", "prior_cases": 0}])
    calls, n = [], 0

    def call(a, b, when, cell, imei=None):
        nonlocal n
        n += 1
        calls.append({"call_id": f"C{n:04d}", "caller": a, "callee": b, "start_time": when, "duration_sec": 60, "call_type": "VOICE", "cell_tower": cell, "imei": imei})

    for d in range(1, 13):  # a quiet call a day, a burst on one
        call(phone[0], phone[1], f"2024-01-{d:02d} 09:00:00", "North")
    for k in range(25):
        call(phone[1], phone[2], f"2024-01-15 {k % 24:02d}:30:00", "South")
    for d in (16, 17, 18, 19):
        call(phone[2], phone[3], f"2024-01-{d} 10:00:00", "East" if d % 2 else "West", "111")
        call(phone[5], "9999999999", f"2024-01-{d} 10:20:00", "East" if d % 2 else "West", "111")
        call("9000000011", "9888888888", f"2024-01-{d} 20:00:00", "North")
    put("cdr", calls)
    account = {n: f"ACABC000{i}" for i, n in enumerate([*numbers, "Brandt Freight Ltd"])}
    paid = [("Vera Lindqvist", "Brandt Freight Ltd", 900_000, "RTGS"), ("Brandt Freight Ltd", "Olga Petrov", 800_000, "RTGS"), ("Olga Petrov", "Vera Lindqvist", 700_000, "NEFT")] + [("Marta Kiss", "Anton Reyes", 49_000, "CASH")] * 5 + [("Marta Kiss", "Olga Petrov", 50_000, "CASH")]
    put("transactions", [{"txn_id": f"T{i}", "from_name": a, "to_name": b, "from_account": account.get(a), "to_account": account.get(b), "amount_inr": v, "mode": m, "timestamp": f"2024-02-0{1 + i % 9} 10:00:00"} for i, (a, b, v, m) in enumerate(paid)])
    put("fir", [{"fir_id": "FIR/2026/0001", "narrative": "Tomas Varga was seen with Ilka Brandt near Harbour Gate in MH 12 AB 1234. He is working under Vera Lindqvist. Brandt Freight Ltd was named.", "registered_on": "2024-01-05 00:00:00", "station": "N", "sections": "1"}])
    put("surveillance", [{"report_id": "SUR/2026/0001", "observation": "तोमस वर्गा, हार्बर", "observed_on": "2024-01-06 00:00:00"}])
    justice = str(base / "j.json")
    json.dump([{"personName": "varga tomas", "caseNumber": "K1", "courtName": "X", "custodyStatus": "Judicial custody", "custodyFrom": "2024-01-16"}, {"personName": "Ilka Brandt", "custodyStatus": "On bail", "custodyFrom": "2024-01-01"}], open(justice, "w"))
    return Engine(spark, folder, BOOK, {"Harbour Gate": (1.0, 2.0)}, adapters.adapters(justice_path=justice), key=b"0123456789abcdef")


USER, ADMIN = User("A. Nowak", "investigator"), User("S. Admin", "admin")


def test_graph_of_the_case(engine):
    g = engine.graph_
    node = {r["label"]: r for r in g.nodes.collect()}
    ids = {k: r["id"] for k, r in node.items()}
    edge = {(r["a"], r["b"]): r for r in g.edges.collect()}
    get = lambda x, y: edge.get((min(ids[x], ids[y]), max(ids[x], ids[y])))
    tomas = node["Tomas Varga"]
    assert tomas["phones"] == ["9000000001", "9000000011"] and "तोमस वर्गा" in tomas["aliases"] and tomas["prior_cases"] == 0 and node["Anton Reyes"]["prior_cases"] is None
    both = get("Tomas Varga", "Ilka Brandt")
    assert both["types"] == ["CALLED", "CO_NAMED_IN"] and both["call_count"] == 12 and abs(both["weight"] - (1 + 12 / 25 + 0.6)) < 1e-9 and both["confidence"] == 0.92
    assert get("Nils Okafor", "Marta Kiss")["types"] == ["SHARES_HANDSET"] and get("Nils Okafor", "Marta Kiss")["first_seen"] is None
    assert get("Vera Lindqvist", "Brandt Freight Ltd")["types"] == ["LINKED_TO_ORG", "TRANSACTED_WITH"] and node["Brandt Freight Ltd"]["type"] == "ORG"
    assert get("Ilka Brandt", "Vera Lindqvist")["types"] == ["CO_NAMED_IN", "REPORTS_TO"] and get("Tomas Varga", "FIR/2026/0001")["types"] == ["NAMED_IN"]
    place = get("Tomas Varga", "Harbour Gate")
    assert place["types"] == ["SEEN_AT"] and place["observations"] == 2 and node["Harbour Gate"]["lat"] == 1.0
    assert all(r["sources"] for r in edge.values()) and "V-MH12AB1234" in ids.values()
    assert graph.as_of(g.edges, "2024-01-01").where(F.array_contains("types", "SHARES_HANDSET")).count() == 1
    assert graph.evidence(g, ids["Ilka Brandt"], ids["Tomas Varga"]).where("record IS NOT NULL").count() == 1
    nodes, edges = graph.filtered(g, 0.9, ["CALLED"], ["PERSON"], redact=True)
    assert edges.count() == 3 and nodes.where("type <> 'PERSON' OR array_contains(phones, '9000000001')").count() == 0


def test_findings_of_the_case(engine):
    found = engine.findings(USER).collect()
    by = {}
    for f in found:
        by.setdefault(f["type"], []).append(f)
    assert [f["id"] for f in found] == [f"A{k:03d}" for k in range(1, len(found) + 1)]
    assert [f["date"] for f in by["communication_burst"]] == ["2024-01-15"] and json.loads(by["communication_burst"][0]["basis"])["observed"] == 25
    assert sorted(f["title"][-10:] for f in by["burner_handset"]) == sorted(["9000000001", "9000000002", "9000000003", "9000000004", "9000000006", "9000000011"])
    assert {f["title"][-10:]: f["severity"] for f in by["burner_handset"]}["9000000011"] == "high"
    assert len(by["circular_fund_flow"]) == 1 and json.loads(by["circular_fund_flow"][0]["basis"])["total_inr"] == 2_400_000
    assert len(by["structuring"]) == 1 and json.loads(by["structuring"][0]["basis"])["count"] == 5
    together = {tuple(sorted(f["entity_labels"])): f["severity"] for f in by["repeated_co_location"]}
    assert together[("Marta Kiss", "Nils Okafor")] == "high" == together[("Nils Okafor", "Vera Lindqvist")]
    assert [json.loads(f["basis"])["events_during_custody"] for f in by["custody_conflict"]] == [4]
    clean = {f["entity_labels"][0]: f["severity"] for f in by["clean_skin_bridge"]}
    assert "Tomas Varga" in clean and "Anton Reyes" not in clean
    assert engine.findings(USER, "medium").where("severity <> 'medium'").count() == 0


def test_answers(engine, tmp_path):
    names = engine.names
    ask = lambda t: questions.parse(t, names).intent
    assert [ask(t) for t in ("How is Varga connected to Olga Petrov?", "who is around Ilka Brandt within 3 hops", "top 5 key players", "any red flags", "payments over Rs 2.5 lakh", "who did Marta Kiss call", "which gangs", "Olga Petrov", "hm")] == ["path", "neighbourhood", "influencers", "anomalies", "transactions", "calls", "communities", "entity", "unknown"]
    assert questions.amount_above("over Rs 1,50,000") == 150_000 and questions.amount_above("above 2 crore.") == 20_000_000 and questions.amount_above("5 lakh") is None
    question, answer = engine.ask(USER, "payments over 5 lakh by Olga Petrov")
    assert question.params["min_amount"] == 500_000 and sorted(r["amount_inr"] for r in answer.collect()) == [700_000, 800_000]
    _, path = engine.ask(USER, "how is Tomas Varga linked to Olga Petrov")
    best = path["paths"][0]
    assert best["hops"] == 2 and "Vera Lindqvist" in path["markdown"] and path["paths"] == sorted(path["paths"], key=lambda p: (p["hops"], -p["confidence"]))
    report = engine.entity(USER, best["path"][0])
    assert "9000000011" in report["markdown"] and "Limitations" in report["markdown"] and "custody" in report["markdown"]
    assert reports.strangers(report["narrative"], [report["markdown"]]) == [] and reports.strangers("Also Nobody", ["x"]) == ["Also", "Nobody"]
    panels = engine.dashboard(USER)
    assert {r["week"] for r in panels["activity"].collect()} >= {"2024-01-01", "2024-01-15", "2024-01-29"} and panels["findings_by_type"].count() >= 7
    view = engine.overview(USER)
    assert view["sha256"] == export.digest("Case overview", view["markdown"]) and view["stats"]["entities"] == 7
    top = engine.influencers(USER, 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and all(r["why"].startswith(r["label"]) for r in top)
    engine.export(USER, str(tmp_path / "out"))
    lines = [r["value"] for r in engine.spark.read.text(f"{tmp_path}/out/1-nodes").collect()]
    assert any(x.startswith("MERGE (n:Person {id: 'P0001'}) SET n += {") for x in lines)
    engine.export(USER, str(tmp_path / "json"), "json")
    assert engine.spark.read.json(f"{tmp_path}/json/edges").count() == engine.graph_.edges.count()
    with pytest.raises(Denied):
        engine.upload(USER, "cdr", "x")
    state = engine.verify_audit(ADMIN)
    assert state["intact"] and state["entries"] >= 10
    latest = engine.read_audit(ADMIN, 50).collect()
    assert latest[0]["action"] == "VIEW_AUDIT_LOG" and any(r["action"] == "ACCESS_DENIED" for r in latest) and all(json.loads(r["payload"]) is not None for r in latest)


def test_literals(spark):
    rows = spark.createDataFrame([Row(id="a'b\\c\nd", n=1, x=None, l=["p", "q'"])], "id string, n long, x string, l array<string>")
    assert rows.select(export.properties(rows, ["id", "n", "x", "l"])).first()[0] == "{id: 'a\\'b\\\\c d', n: 1, x: null, l: ['p', 'q\\'']}"
    assert export.clean({"a": 1, "b": {"k": 1}, "c": [1, object()], "d": object(), "e": []}) == {"a": 1, "b": '{"k": 1}', "c": [1]}
    assert export.digests(spark.createDataFrame([("t", "b")], "title string, body string")).first()["sha256"] == export.digest("t", "b")
