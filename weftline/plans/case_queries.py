"""A case's operators as statements over the driver's tables.

Users, places and payments stand for callers, cells and transactions; each
statement is one operator, so that it can be held against SQL by itself.
"""

from __future__ import annotations

from weftline.plans import link_queries as links
from weftline.plans.dialects import cents, key_of_props

K, UK, PAY = key_of_props(), links.UK, links.PAY
EMAIL, IP = "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"


def call_pairs(d):
    """Unordered pairs of ends: how often, how much, when, in which ways."""
    return f"""SELECT least(user_id, {K}) AS p, greatest(user_id, {K}) AS q, count(*) AS n, CAST(sum({cents('value')}) AS BIGINT) AS total, min({d.us('ts')}) AS first_us, max({d.us('ts')}) AS last_us, {d.joined('event_type')} AS ways
      FROM events WHERE user_id <> {K} GROUP BY least(user_id, {K}), greatest(user_id, {K})"""


def shared_device_links(d):
    """Users that report errors from one place: pairs, with the places."""
    return f"""WITH o AS (SELECT DISTINCT user_id AS u, {K} AS k FROM events WHERE event_type = 'error'), m AS (SELECT k FROM o GROUP BY k HAVING count(*) > 1)
      SELECT a.u AS a, b.u AS b, count(*) AS devices, min(a.k) AS first_device FROM o a JOIN o b ON a.k = b.k AND a.u < b.u JOIN m ON m.k = a.k GROUP BY a.u, b.u"""


def transaction_pairs(d):
    """Payments by pair, with their first twenty orders."""
    return f"""WITH {PAY.replace('SELECT o_custkey', 'SELECT o_orderkey AS id, o_custkey')} SELECT c, s, count(*) AS n, CAST(sum(amt) AS BIGINT) AS total, {d.first('id', 20)} AS ids FROM pay GROUP BY c, s HAVING count(*) >= 2"""


def party_filter(d):
    """The hundred largest payments that a nation's party pays or receives."""
    return f"""SELECT o_orderkey, l_linenumber, l_suppkey, l_partkey, {cents('l_extendedprice')} AS amt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
      WHERE c_nationkey = 3 OR s_nationkey = 3 ORDER BY amt DESC, o_orderkey, l_linenumber, l_suppkey, l_partkey LIMIT 100"""


def lookup_with_fallback(d):
    """A user's owner: the customer of that number, else the supplier."""
    return f"""WITH u AS (SELECT DISTINCT user_id AS u FROM events)
      SELECT u, CASE WHEN c_custkey IS NOT NULL THEN concat('C', {d.text('c_custkey')}) WHEN s_suppkey IS NOT NULL THEN concat('S', {d.text('s_suppkey')}) END AS owner FROM u LEFT JOIN customer ON c_custkey = u AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = u"""


def unique_owner(d):
    """Names by phonetic key, only where the key is one name's."""
    return f"""WITH k AS ({links.phonetic_keys(d)}), one AS (SELECT k1, k2, min(p_name) AS owner FROM k GROUP BY k1, k2 HAVING count(DISTINCT p_name) = 1)
      SELECT k.p_name, one.owner FROM k LEFT JOIN one ON one.k1 = k.k1 AND one.k2 = k.k2"""


def parties_that_paid(d):
    """Customers with a large order: an existence test."""
    return "SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"


def _first(d) -> str:
    """The first address of each kind in a document, with its place."""
    spot = lambda p, n: f"regexp_extract(text, '({p})', 1) AS {n}"
    return f"f AS (SELECT doc_id, text, {spot(EMAIL, 'email')}, {spot(IP, 'ip')} FROM documents)"


def identifier_spans(d):
    """Addresses in documents with start and end (code points from 0)."""
    one = lambda n: f"SELECT doc_id, '{n}' AS type, {n} AS value, {d.position('text', n)} - 1 AS start_at, {d.position('text', n)} - 1 + length({n}) AS end_at FROM f WHERE {n} <> ''"
    return f"WITH {_first(d)} {one('email')} UNION ALL {one('ip')}"


def context_snippets(d):
    """The first address of a document with ninety characters to each side."""
    s, e = f"{d.position('text', 'email')} - 1", f"{d.position('text', 'email')} - 1 + length(email)"
    return f"""WITH {_first(d)} SELECT doc_id, concat(CASE WHEN {s} > 90 THEN '...' ELSE '' END, replace(substr(text, CAST(greatest({s} - 90, 0) + 1 AS INT), CAST(least({e} + 90, length(text)) - greatest({s} - 90, 0) AS INT)), chr(10), ' '),
      CASE WHEN {e} + 90 < length(text) THEN '...' ELSE '' END) AS context FROM f WHERE email <> ''"""


def text_window_pairs(d):
    """Speakers and question marks of a turn within two hundred characters."""
    return f"""WITH p AS (SELECT conv_id, turn, role, {d.position('text', "'a'")} AS x, {d.position('text', "'. '")} AS y FROM conversations)
      SELECT conv_id, turn, role, abs(x - y) AS gap FROM p WHERE x > 0 AND y > 0 AND abs(x - y) < 200"""


def induced_subgraph(d):
    """Edges between well-linked users and well-linked places, of some types."""
    return f"""WITH {UK}, e AS (SELECT u, k, count(*) AS n, count(DISTINCT event_type) AS t FROM uk GROUP BY u, k), a AS (SELECT u FROM e GROUP BY u HAVING count(*) >= 20), b AS (SELECT k FROM e GROUP BY k HAVING count(*) >= 20)
      SELECT u, k, n FROM e WHERE t >= 2 AND u IN (SELECT u FROM a) AND k IN (SELECT k FROM b)"""


def types_overlap(d):
    """Edges of which some type is among those wanted."""
    return f"""WITH {UK} SELECT u, k, count(*) AS n FROM uk GROUP BY u, k HAVING {d.overlap('event_type', "'error', 'purchase'")}"""


def types_except(d):
    """What an edge's types are besides the common ones."""
    return f"""WITH {UK} SELECT u, k, {d.without('event_type', "'view', 'click'")} AS others FROM uk GROUP BY u, k"""


def dominant_type(d):
    """Each place's most frequent type of event, the smallest of equals."""
    return f"""WITH c AS (SELECT {K} AS k, event_type, count(*) AS n FROM events GROUP BY {K}, event_type)
      SELECT k, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, event_type) AS rn FROM c) x WHERE rn = 1"""


def findings_by_type(d):
    """How many findings of a type, and how many of them are severe."""
    return f"SELECT type, count(*) AS value, CAST(sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high FROM ({links.findings(d)}) f GROUP BY type"


def community_risk(d):
    """Flags by group of nations."""
    return "SELECT n_regionkey AS community, CAST(sum(CASE WHEN n_nationkey % 7 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS prior_cases, count(*) AS members FROM nation GROUP BY n_regionkey"


def node_statements(d):
    """Statements that load customers, quotes in their names escaped."""
    return f"""SELECT c_custkey, concat('MERGE (n:Customer {{id: ''', {d.text('c_custkey')}, '''}}) SET n += {{label: ''', replace(c_name, '#', '-'), ''', segment: ''', replace(c_mktsegment, '''', '-'), '''}};') AS statement FROM customer"""


def json_export(d):
    """Edges as JSON objects."""
    fields = d.json(a="u", b="k", observations="n", types="types")
    return f"WITH e AS (SELECT user_id AS u, {K} AS k, count(*) AS n, {d.joined('event_type')} AS types FROM events GROUP BY user_id, {K}) SELECT u, k, {fields} AS line FROM e"


def report_digest(d):
    """The digest of a turn's title and body."""
    body = "concat(coalesce(role, ''), coalesce(text, ''))"
    return f"SELECT conv_id, turn, {d.sha256(body)} AS digest FROM conversations"


def edge_evidence(d):
    """The sources of one user's edges, joined to what they are."""
    return f"""WITH {UK} SELECT uk.k, event_id, uk.event_type, {cents('e.value')} AS amt FROM uk JOIN events e USING (event_id) WHERE uk.u = 7"""


def replace_dedupe(d):
    """A replacing upload: what was held goes, repeats in the file go."""
    return """WITH inc AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders)
      SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM inc) x WHERE rn = 1"""


def next_padded_id(d):
    """The next identifier in the form of the held ones."""
    n, w = "max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) + 1", "max(length(regexp_extract(c_name, '([0-9]+)$', 1)))"
    return f"SELECT concat(min(regexp_extract(c_name, '^([^0-9]*)', 1)), {d.pad(n, w)}) AS next_id FROM customer"


def log_tail(d):
    """The latest entries, newest first."""
    return f"SELECT event_id, user_id, event_type, {d.us('ts')} AS at_us FROM events ORDER BY event_id DESC LIMIT 200"


def amounts_in_words(d):
    """Amounts with a word for a round number, in whole units."""
    return f"""WITH t AS (SELECT p_partkey, concat({d.text('p_size')}, CASE p_size % 4 WHEN 0 THEN ' lakh' WHEN 1 THEN ' crore' WHEN 2 THEN ' k' ELSE '' END) AS said FROM part),
      x AS (SELECT p_partkey, CAST(regexp_extract(said, '^([0-9]+)', 1) AS BIGINT) AS n, regexp_extract(said, ' ([a-z]+)$', 1) AS w FROM t)
      SELECT p_partkey, n * CASE w WHEN 'lakh' THEN 100000 WHEN 'crore' THEN 10000000 WHEN 'k' THEN 1000 ELSE 1 END AS amount FROM x"""


def digits_and_script(d):
    """Devanagari digits as ASCII, and which script a text is in."""
    deva = "translate(c_name, '0123456789', '०१२३४५६७८९')"
    return f"SELECT c_custkey, translate({deva}, '०१२३४५६७८९', '0123456789') AS plain, CASE WHEN {d.has(deva, '[ऀ-ॿ]')} THEN 'devanagari' ELSE 'latin' END AS script FROM customer"


def entity_rollup(d):
    """Customers of a nation and segment as one entity: its fullest name, its
    numbers, its sources."""
    return f"""SELECT c_nationkey, c_mktsegment, {d.best('c_name', 'c_custkey')} AS label, count(*) AS members, {d.first('c_custkey', 5)} AS first_ids, min(c_custkey) AS entity FROM customer GROUP BY c_nationkey, c_mktsegment"""


def entity_ids(d):
    """Numbered identifiers of entities in the order of their first member."""
    return f"""SELECT c_nationkey, concat('P', {d.pad('row_number() OVER (ORDER BY first_member)', '4')}) AS id FROM (SELECT c_nationkey, min(c_custkey) AS first_member FROM customer GROUP BY c_nationkey) x"""


def decision_log(d):
    """Which names were joined and why, each once, cross-spelling first by flag."""
    return f"""SELECT DISTINCT a, b, concat('name key ', substr(a, 1, 1)) AS reason, CASE WHEN a = b THEN 1 ELSE 0 END AS same FROM ({links.blocked_name_pairs(d)}) p"""


def role_permissions(d):
    """Which role may do what, and who is denied."""
    return """WITH r AS (SELECT 'investigator' AS role, 'graph:read' AS permission UNION ALL SELECT 'admin', 'graph:read' UNION ALL SELECT 'admin', 'audit:read'),
      u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'investigator' END AS role FROM events)
      SELECT user_id, u.role, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.role = u.role AND r.permission = 'audit:read') THEN 'allowed' ELSE 'denied' END AS verdict FROM u"""


def corroborated_first(d):
    """Edges by the number of systems behind them, the best two hundred."""
    return f"""WITH {UK} SELECT u, k, count(DISTINCT event_type) AS level, count(*) AS n FROM uk GROUP BY u, k ORDER BY level DESC, n DESC, u, k LIMIT 200"""


STATEMENTS = [
    call_pairs, shared_device_links, transaction_pairs, party_filter, lookup_with_fallback, unique_owner, parties_that_paid, identifier_spans, context_snippets, text_window_pairs,
    induced_subgraph, types_overlap, types_except, dominant_type, findings_by_type, community_risk, node_statements, json_export, report_digest, edge_evidence, replace_dedupe,
    next_padded_id, log_tail, amounts_in_words, digits_and_script, entity_rollup, entity_ids, decision_log, role_permissions, corroborated_first,
]
