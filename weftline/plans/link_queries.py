"""Link-analysis queries that are plain relational plans.

Roles over the driver's tables: a customer pays a supplier (orders, lineitem);
a user meets a place ``k`` (events); ``event_type`` is the source system.
Every query is one statement; Catalyst plans scans, joins and partial
aggregation. Interval joins carry a bucket equality, so that they stay hash
joins: both sides of a pair meet in exactly one bucket.
"""

from __future__ import annotations

from weftline.plans.dialects import cents, four, key_of_props

K = key_of_props()
PAY = f"""pay AS (SELECT o_custkey AS c, l_suppkey AS s, o_orderdate AS paid, o_orderpriority AS mode, {cents('l_extendedprice')} AS amt
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
#: What nations pay each other, every pair: ``legs`` directed, ``sym`` both ways.
NATION_FLOW = f"""flow AS (SELECT c.c_nationkey AS src, s.s_nationkey AS dst, sum({cents('l_extendedprice')}) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON c_custkey = o_custkey JOIN supplier s ON s_suppkey = l_suppkey
  GROUP BY c.c_nationkey, s.s_nationkey),
 legs AS (SELECT src, dst, CAST(amt AS BIGINT) AS amt FROM flow WHERE src <> dst),
 und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(amt) AS BIGINT) AS amt FROM legs GROUP BY least(src, dst), greatest(src, dst)),
 sym AS (SELECT a AS u, b AS v, amt FROM und UNION ALL SELECT b, a, amt FROM und)"""
UK = f"uk AS (SELECT user_id AS u, {K} AS k, ts, event_type, event_id FROM events)"


def structuring_band(d):
    """Payments just under a threshold by one mode, at least five per pair."""
    return f"""SELECT c_nationkey AS payer, s_nationkey AS payee, count(*) AS n, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS total_cents
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
      WHERE l_extendedprice >= 42500 AND l_extendedprice < 50000 AND o_orderpriority = '1-URGENT'
      GROUP BY c_nationkey, s_nationkey HAVING count(*) >= 5"""


MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def edge_merge_cust_supp(d):
    """One edge per pair: observations, summed weight, the ways of payment,
    first and last date. Line items are summed by order and supplier first, so
    the join meets one row for each; ways are one bit each."""
    bits = " + ".join(f"max(CASE WHEN o_orderpriority = '{m}' THEN 1 ELSE 0 END) * {1 << k}" for k, m in enumerate(MODES))
    other = " AND ".join(f"o_orderpriority <> '{m}'" for m in MODES)
    return f"""WITH i AS (SELECT l_orderkey, l_suppkey, count(*) AS n, sum({cents('l_extendedprice')}) AS amt FROM lineitem GROUP BY l_orderkey, l_suppkey)
      SELECT o_custkey AS c, l_suppkey AS s, CAST(sum(n) AS BIGINT) AS observations, CAST(sum(amt) AS BIGINT) AS total_cents, CAST({bits} + max(CASE WHEN {other} THEN 1 ELSE 0 END) * {1 << len(MODES)} AS BIGINT) AS modes,
      {d.text('CAST(min(o_orderdate) AS DATE)')} AS first_seen, {d.text('CAST(max(o_orderdate) AS DATE)')} AS last_seen,
      {four('1 + least(sum(amt) / 500000000.0, 3)')} AS weight FROM orders JOIN i ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY o_custkey, l_suppkey"""


def edge_merge_user_k(d):
    return f"""WITH {UK} SELECT u, k, count(*) AS observations, {d.joined('event_type')} AS types, min({d.us('ts')}) AS first_us,
      max({d.us('ts')}) AS last_us, count(DISTINCT event_type) AS n_types, {four('1 + count(*) / 25.0')} AS weight FROM uk GROUP BY u, k"""


def node_edge_stats(d):
    return f"""WITH {UK}, e AS (SELECT u, k, count(DISTINCT event_type) AS t FROM uk GROUP BY u, k)
      SELECT 'user' AS what, count(DISTINCT u) AS n FROM e UNION ALL SELECT 'place', count(DISTINCT k) FROM e
      UNION ALL SELECT 'edge', count(*) FROM e UNION ALL SELECT 'edge_type', CAST(sum(t) AS BIGINT) FROM e
      UNION ALL SELECT event_type, count(*) FROM (SELECT DISTINCT u, k, event_type FROM uk) y GROUP BY event_type"""


def timeline(d):
    return f"SELECT min({d.us('ts')}) AS first_us, max({d.us('ts')}) AS last_us, CAST(sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undated FROM events"


def corroboration_levels(d):
    return f"WITH {UK} SELECT u, k, count(DISTINCT event_type) AS level FROM uk GROUP BY u, k HAVING count(DISTINCT event_type) >= 2"


def corroboration_histogram(d):
    return f"""WITH {UK}, l AS (SELECT u, k, count(DISTINCT event_type) AS level, count(*) AS n FROM uk GROUP BY u, k)
      SELECT level, count(*) AS edges, CAST(sum(n) AS BIGINT) AS observations FROM l GROUP BY level"""


def burst_hourly(d):
    """Hours far above the mean of the hours that were observed."""
    return f"""WITH h AS (SELECT {d.hour('ts')} AS hr, count(*) AS n FROM events GROUP BY {d.hour('ts')}),
      m AS (SELECT avg(CAST(n AS DOUBLE)) AS mu, CASE WHEN stddev_pop(CAST(n AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST(n AS DOUBLE)) END AS sd, count(*) AS days FROM h)
      SELECT hr, n, {four('(n - mu) / sd')} AS z, CASE WHEN (n - mu) / sd >= 3.5 THEN 'high' ELSE 'medium' END AS severity
      FROM h CROSS JOIN m WHERE days >= 5 AND n >= 6 AND (n - mu) / sd >= 2.5"""


def burst_user_day(d):
    return f"""WITH c AS (SELECT user_id, {d.text('CAST(ts AS DATE)')} AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id, {d.text('CAST(ts AS DATE)')}),
      z AS (SELECT *, avg(n) OVER (PARTITION BY user_id) AS mu, stddev_pop(n) OVER (PARTITION BY user_id) AS sd, count(*) OVER (PARTITION BY user_id) AS days FROM c)
      SELECT user_id, day, CAST(n AS BIGINT) AS n, {four('(n - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END')} AS z FROM z
      WHERE days >= 5 AND n >= 6 AND (n - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END >= 2.5"""


def burner_profile(d):
    """Few contacts, a short life, some use."""
    return f"""WITH {UK} SELECT u, k, count(DISTINCT event_type) AS contacts, count(*) AS n,
      CAST(floor((max({d.us('ts')}) - min({d.us('ts')})) / 86400000000.0) AS BIGINT) AS days FROM uk GROUP BY u, k
      HAVING count(DISTINCT event_type) <= 3 AND count(*) >= 3 AND floor((max({d.us('ts')}) - min({d.us('ts')})) / 86400000000.0) <= 25"""


def co_location_pairs(d):
    """Two users at one place within 90 minutes, by a bucketed range join."""
    return f"""WITH {UK}, p AS (SELECT u, k, {d.us('ts')} AS t, CAST(floor({d.us('ts')} / 5400000000.0) AS BIGINT) AS b, event_id FROM uk),
      r AS (SELECT u, k, t, b + o AS b, event_id FROM p CROSS JOIN (SELECT -1 AS o UNION ALL SELECT 0 UNION ALL SELECT 1) w)
      SELECT l.u AS a, r.u AS b, count(*) AS n, count(DISTINCT l.k) AS cells FROM p l JOIN r ON l.k = r.k AND l.b = r.b
      WHERE l.u < r.u AND abs(l.t - r.t) <= 5400000000 GROUP BY l.u, r.u HAVING count(*) >= 3 AND count(DISTINCT l.k) >= 2"""


def custody_interval_join(d):
    """Every distinct (user, start date) is an interval of a week, without an
    end for every third user; one row for each with three or more purchases
    inside."""
    end = "CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) + INTERVAL '7' DAY END"
    return f"""WITH c AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS a, {end} AS z FROM events WHERE event_type = 'error')
      SELECT e.user_id, {d.text('a')} AS start, count(*) AS n, count(DISTINCT {key_of_props('e.props')}) AS cells, max({d.us('e.ts')}) AS last_us
      FROM events e JOIN c ON c.user_id = e.user_id WHERE e.event_type = 'purchase' AND CAST(e.ts AS DATE) >= a AND (z IS NULL OR CAST(e.ts AS DATE) <= z)
      GROUP BY e.user_id, a HAVING count(*) >= 3"""


def weekly_activity_full_outer(d):
    return f"""WITH e AS (SELECT {d.week('ts')} AS w, count(*) AS n FROM events GROUP BY {d.week('ts')}),
      o AS (SELECT {d.week('o_orderdate')} AS w, count(*) AS n FROM orders GROUP BY {d.week('o_orderdate')})
      SELECT coalesce(e.w, o.w) AS week, coalesce(e.n, 0) AS events, coalesce(o.n, 0) AS orders FROM e FULL OUTER JOIN o ON e.w = o.w"""


def nearest_preceding(d):
    """For every purchase the latest view in the week before it, by one window."""
    return f"""WITH w AS (SELECT event_id, user_id, event_type, {d.us('ts')} AS t,
        max(CASE WHEN event_type = 'view' THEN {d.us('ts')} END) OVER (PARTITION BY user_id ORDER BY {d.us('ts')}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM events)
      SELECT event_id, user_id, t - v AS gap_us FROM w WHERE event_type = 'purchase' AND v IS NOT NULL AND t - v < 604800000000"""


def append_dedupe(d):
    """Existing rows win, then the first of the incoming."""
    return """WITH old AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
      inc AS (SELECT o_orderkey, o_totalprice, 1 AS seq FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, 2 FROM orders WHERE o_orderkey % 5 = 0),
      f AS (SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq, o_totalprice) AS rn FROM inc) x WHERE rn = 1)
      SELECT o_orderkey, o_totalprice, 'kept' AS origin FROM old
      UNION ALL SELECT f.o_orderkey, f.o_totalprice, 'added' FROM f LEFT JOIN old ON old.o_orderkey = f.o_orderkey WHERE old.o_orderkey IS NULL"""


def next_id(d):
    return f"SELECT max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) + 1 AS next_number, max(length(regexp_extract(c_name, '([0-9]+)$', 1))) AS width FROM customer"


def extract_identifiers(d):
    email, phone, ip, card = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"[0-9]{3}[-. ][0-9]{4}", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", r"[0-9]{16}"
    parts = ", ".join(f"CAST({d.all('text', p)} AS BIGINT) AS {n}" for n, p in (("emails", email), ("phones", phone), ("ips", ip), ("cards", card)))
    return f"WITH x AS (SELECT doc_id, {parts} FROM documents) SELECT * FROM x WHERE emails + phones + ips + cards > 0"


def _skeleton(d, x: str) -> str:
    """Phonetic key of a word: letters only, ph as f, near letters as one,
    vowels after the first letter dropped, runs of a letter as one."""
    letters = f"translate({d.replace(d.replace(f'lower({x})', '[^a-z]', ''), 'ph', 'f')}, 'qzwx', 'kjvk')"
    tail = d.replace(f"substr({letters}, 2)", "[aeiouy]", "")
    key = f"concat(substr({letters}, 1, 1), {tail})"
    for c in "bcdfghjklmnprstvaeiou":
        key = d.replace(key, f"{c}{c}+", c)
    return key


def phonetic_keys(d):
    return f"""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, split(p_name, ' ')[{0 if d.group == '$1' else 1}] AS one, split(p_name, ' ')[{1 if d.group == '$1' else 2}] AS two FROM n)
      SELECT p_name, least({_skeleton(d, 'one')}, {_skeleton(d, 'two')}) AS k1, greatest({_skeleton(d, 'one')}, {_skeleton(d, 'two')}) AS k2 FROM w"""


def blocked_name_pairs(d):
    """Candidate pairs of names: blocked on a shared key of four letters."""
    return f"""WITH k AS ({phonetic_keys(d)}), t AS (SELECT p_name, k1 AS k FROM k WHERE length(k1) >= 3 UNION SELECT p_name, k2 FROM k WHERE length(k2) >= 3)
      SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM t a JOIN t b ON a.k = b.k WHERE a.p_name < b.p_name"""


def cooccur_in_doc(d):
    """Pairs of roles that speak in one conversation, with how many they share."""
    return """WITH s AS (SELECT DISTINCT conv_id, role FROM conversations)
      SELECT a.role AS a, b.role AS b, count(*) AS n FROM s a JOIN s b ON a.conv_id = b.conv_id WHERE a.role < b.role GROUP BY a.role, b.role"""


def circular_flow_nation(d):
    """Simple cycles of three to five nations, anchored at the smallest: each
    step goes on to larger nodes only, so a cycle is met once a direction. For
    a set of nodes the direction with the largest total stays."""
    hops = []
    for n in (3, 4, 5):
        joins = " ".join(f"JOIN legs e{i} ON e{i}.src = e{i - 1}.dst" for i in range(2, n + 1))
        nodes = ["e1.src", *(f"e{i}.dst" for i in range(1, n))]
        rules = [f"e{n}.dst = e1.src", *(f"{x} > e1.src" for x in nodes[1:]), *(f"{nodes[i]} <> {nodes[j]}" for i in range(1, n) for j in range(i + 1, n))]
        total = " + ".join(f"e{i}.amt" for i in range(1, n + 1))
        bits = " + ".join(f"CAST(power(2, {x}) AS BIGINT)" for x in nodes)
        named = ", ".join(f"{x} AS n{i}" for i, x in enumerate([*nodes, *["-1"] * (5 - n)], 1))
        hops.append(f"SELECT {n} AS hops, {bits} AS members, {named}, {total} AS total FROM legs e1 {joins} WHERE {' AND '.join(rules)}")
    step = lambda i: f"CASE WHEN n{i} < 0 THEN '' ELSE concat('-', {d.text(f'n{i}')}) END"
    return f"""WITH {NATION_FLOW}, c AS ({' UNION ALL '.join(hops)})
      SELECT hops, concat({d.text('n1')}, {', '.join(step(i) for i in range(2, 6))}) AS path, total
      FROM (SELECT *, row_number() OVER (PARTITION BY members ORDER BY total DESC, n2, n3, n4, n5) AS rn FROM c WHERE total >= 100000000) x WHERE rn = 1"""


def broker_foreign_groups(d):
    return f"""WITH {NATION_FLOW} SELECT u, count(DISTINCT nb.n_regionkey) AS foreign_groups FROM sym JOIN nation me ON me.n_nationkey = u JOIN nation nb ON nb.n_nationkey = v
      WHERE nb.n_regionkey <> me.n_regionkey GROUP BY u HAVING count(DISTINCT nb.n_regionkey) >= 2"""


def modularity_by_region(d):
    return f"""WITH {NATION_FLOW}, m AS (SELECT CAST(sum(amt) AS DOUBLE) AS m FROM und),
      inside AS (SELECT x.n_regionkey AS r, CAST(sum(amt) AS DOUBLE) AS l FROM und JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey = y.n_regionkey GROUP BY x.n_regionkey),
      deg AS (SELECT n_regionkey AS r, CAST(sum(amt) AS DOUBLE) AS dg FROM sym JOIN nation ON n_nationkey = u GROUP BY n_regionkey)
      SELECT {four('sum(coalesce(l, 0.0) / m - (dg / (2 * m)) * (dg / (2 * m)))')} AS q FROM deg LEFT JOIN inside ON inside.r = deg.r CROSS JOIN m"""


def degree_weighted_top(d):
    """Weighted degree of every party in the payment graph, the top hundred."""
    return f"""WITH {PAY}, e AS (SELECT c, s, CAST(sum(amt) AS BIGINT) AS w, count(*) AS n FROM pay GROUP BY c, s),
      x AS (SELECT concat('C', {d.text('c')}) AS node, w, n FROM e UNION ALL SELECT concat('S', {d.text('s')}), w, n FROM e)
      SELECT node, CAST(sum(w) AS BIGINT) AS degree, count(*) AS neighbours, CAST(sum(n) AS BIGINT) AS observations FROM x GROUP BY node ORDER BY degree DESC, node LIMIT 100"""


def khop_neighbourhood(d):
    """Nations within two hops of nation 0, with their distance."""
    return f"""WITH {NATION_FLOW}, h1 AS (SELECT DISTINCT v AS n FROM sym WHERE u = 0), h2 AS (SELECT DISTINCT v AS n FROM sym JOIN h1 ON u = n)
      SELECT n, min(dist) AS distance FROM (SELECT 0 AS n, 0 AS dist UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2) x GROUP BY n"""


def simple_paths_topk(d):
    """Simple paths of up to five hops between two nations, six best by length,
    then by weight."""
    parts = []
    for n in (1, 2, 3, 4, 5):
        joins = " ".join(f"JOIN sym e{i} ON e{i}.u = e{i - 1}.v" for i in range(2, n + 1))
        nodes = ["e1.u", *(f"e{i}.v" for i in range(1, n + 1))]
        rules = ["e1.u = 0", f"e{n}.v = 12", *(f"{nodes[i]} <> {nodes[j]}" for i in range(n + 1) for j in range(i + 1, n + 1))]
        parts.append(f"SELECT {n} AS hops, concat({', \'-\', '.join(d.text(x) for x in nodes)}) AS path, {' + '.join(f'e{i}.amt' for i in range(1, n + 1))} AS total FROM sym e1 {joins} WHERE {' AND '.join(rules)}")
    return f"WITH {NATION_FLOW}, p AS ({' UNION ALL '.join(parts)}) SELECT hops, path, total FROM p ORDER BY hops, total DESC, path LIMIT 6"


def graph_as_of(d):
    return f"""WITH {UK}, e AS (SELECT u, k, min(ts) AS first_seen FROM uk GROUP BY u, k)
      SELECT u, count(*) AS edges FROM e WHERE first_seen IS NULL OR first_seen <= TIMESTAMP '2024-01-08 00:00:00' GROUP BY u"""


def export_graph_projection(d):
    return f"""WITH {UK} SELECT concat('U-', {d.text('u')}) AS source, concat('K-', {d.text('k')}) AS target, {d.joined('event_type')} AS source_types,
      {four('0.4 * count(*)')} AS weight, concat('MERGE (:User {{id: "U-', {d.text('u')}, '"}})-[:SEEN_AT]->(:Place {{id: "K-', {d.text('k')}, '"}})') AS statement FROM uk GROUP BY u, k"""


def clean_skin_3hop(d):
    """Nations with no flag that reach a flagged one within three hops."""
    return f"""WITH {NATION_FLOW}, flag AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 7 = 0 THEN 3 END AS prior FROM nation),
      h1 AS (SELECT u AS s, v AS n FROM sym), h2 AS (SELECT DISTINCT h1.s, v AS n FROM h1 JOIN sym ON u = n), h3 AS (SELECT DISTINCT h2.s, v AS n FROM h2 JOIN sym ON u = n),
      r AS (SELECT s, n, min(dist) AS dist FROM (SELECT s, n, 1 AS dist FROM h1 UNION ALL SELECT s, n, 2 FROM h2 UNION ALL SELECT s, n, 3 FROM h3) x WHERE s <> n GROUP BY s, n)
      SELECT s, min(dist) AS nearest, count(*) AS flagged, CASE WHEN min(dist) = 1 THEN 'high' ELSE 'medium' END AS severity
      FROM r JOIN flag me ON me.n = s JOIN flag f ON f.n = r.n WHERE me.prior IS NOT NULL AND me.prior <= 0 AND f.prior >= 3 GROUP BY s"""


def findings(d):
    """The detectors' findings in one list; of the cycles the three largest."""
    return f"""SELECT 'structuring' AS type, 'high' AS severity, concat({d.text('payer')}, '-', {d.text('payee')}) AS title FROM ({structuring_band(d)}) s
        UNION ALL SELECT 'burst', severity, {d.text('hr')} FROM ({burst_hourly(d)}) b
        UNION ALL SELECT 'burner', severity, concat({d.text('u')}, '-', {d.text('k')}) FROM ({burner_owner(d)}) o
        UNION ALL SELECT 'co_location', severity, concat({d.text('a')}, '-', {d.text('b')}) FROM ({co_location_severity(d)}) c
        UNION ALL SELECT 'custody', 'high', concat({d.text('user_id')}, ' ', start) FROM ({custody_interval_join(d)}) u
        UNION ALL SELECT 'cycle', 'high', path FROM (SELECT path FROM ({circular_flow_nation(d)}) f ORDER BY total DESC, path LIMIT 3) t
        UNION ALL SELECT 'broker', 'medium', {d.text('u')} FROM ({broker_foreign_groups(d)}) g
        UNION ALL SELECT 'clean_skin', severity, {d.text('s')} FROM ({clean_skin_3hop(d)}) k"""


def findings_all_sql(d):
    """The list, ordered and numbered; in Spark ``operators.numbering`` does it."""
    return f"SELECT row_number() OVER (ORDER BY CASE WHEN severity = 'high' THEN 0 ELSE 1 END, type, title) AS number, type, severity, title FROM ({findings(d)}) a"


def burst_top_users(d):
    """Bursts with their busiest place and their five busiest users."""
    return f"""WITH b AS ({burst_hourly(d)}), e AS (SELECT {d.hour('ts')} AS hr, user_id, {K} AS k FROM events),
      u AS (SELECT e.hr, user_id, count(*) AS c FROM e JOIN b ON b.hr = e.hr GROUP BY e.hr, user_id),
      t AS (SELECT *, row_number() OVER (PARTITION BY hr ORDER BY c DESC, user_id) AS rn FROM u),
      p AS (SELECT e.hr, k, count(*) AS c FROM e JOIN b ON b.hr = e.hr GROUP BY e.hr, k),
      m AS (SELECT *, row_number() OVER (PARTITION BY hr ORDER BY c DESC, k) AS rn FROM p)
      SELECT t.hr, t.rn, t.user_id, t.c AS calls, m.k AS dominant FROM t JOIN m ON m.hr = t.hr AND m.rn = 1 WHERE t.rn <= 5"""


def burner_owner(d):
    """Short-lived identifiers; severe where the user has another one."""
    return f"""WITH p AS ({burner_profile(d)}), o AS (SELECT user_id AS u, count(DISTINCT {K}) AS others FROM events GROUP BY user_id)
      SELECT p.u, p.k, p.contacts, p.days, CASE WHEN others > 1 THEN 'high' ELSE 'medium' END AS severity FROM p JOIN o ON o.u = p.u"""


def co_location_severity(d):
    """Meetings of users, expected where both often report errors at one place;
    six of them: severe first, then by number."""
    return f"""WITH m AS ({co_location_pairs(d)}), x AS (SELECT user_id AS u, {K} AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id, {K}),
      t AS (SELECT l.u AS a, r.u AS b, CAST(sum(l.n + r.n) AS BIGINT) AS calls FROM x l JOIN x r ON l.k = r.k AND l.u < r.u GROUP BY l.u, r.u)
      SELECT m.a, m.b, m.n, m.cells, coalesce(calls, 0) AS calls, CASE WHEN coalesce(calls, 0) >= 10 THEN 'medium' ELSE 'high' END AS severity
      FROM m LEFT JOIN t ON t.a = m.a AND t.b = m.b ORDER BY CASE WHEN coalesce(calls, 0) >= 10 THEN 1 ELSE 0 END, m.n DESC, m.a, m.b LIMIT 6"""


STATEMENTS = [
    structuring_band, edge_merge_cust_supp, edge_merge_user_k, node_edge_stats, timeline, corroboration_levels, corroboration_histogram, burst_hourly, burst_user_day,
    burner_profile, co_location_pairs, custody_interval_join, weekly_activity_full_outer, nearest_preceding, append_dedupe, next_id, extract_identifiers, phonetic_keys,
    blocked_name_pairs, cooccur_in_doc, circular_flow_nation, broker_foreign_groups, modularity_by_region, degree_weighted_top, khop_neighbourhood, simple_paths_topk,
    graph_as_of, export_graph_projection, clean_skin_3hop, burst_top_users, burner_owner, co_location_severity,
]
