"""The queries of queries.py in DuckDB's SQL, written from their descriptions."""

_EDGES = "SELECT user_id AS s, lead(user_id) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS t FROM events"
_LINKS = """
SELECT c_nationkey AS from_id, s_nationkey AS to_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"""
_PATHS = "SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages"


def _reach(edges: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM ({edges}) WHERE t IS NOT NULL),
w AS (SELECT s AS src, t AS dst, 1 AS d FROM e UNION SELECT w.src, e.t, w.d + 1 FROM w JOIN e ON e.s = w.dst WHERE w.d < 8),
b AS (SELECT src, dst, min(d) AS d FROM w WHERE src <> dst GROUP BY 1, 2)
SELECT src, count(*) AS reached, round(sum(power(0.7, d - 1)), 6) AS weight, CAST(max(d) AS BIGINT) AS farthest FROM b GROUP BY 1"""


def _pagerank(seed: str) -> str:
    parts = [
        f"WITH e AS (SELECT s, t FROM ({_EDGES}) WHERE t IS NOT NULL), v AS (SELECT DISTINCT user_id AS node FROM events), c AS (SELECT count(*) AS n FROM v)",
        "deg AS (SELECT s AS node, count(*) AS deg FROM e GROUP BY 1)",
        seed,
        "b AS (SELECT v.node, deg, CASE WHEN sk.k = 0 THEN 1.0 / n WHEN sd.node IS NOT NULL THEN 1.0 / sk.k ELSE 0.0 END AS jump FROM v CROSS JOIN c CROSS JOIN sk LEFT JOIN deg USING (node) LEFT JOIN sd ON sd.node = v.node)",
        "r0 AS MATERIALIZED (SELECT node, 1.0 / n AS r FROM v CROSS JOIN c)",
    ]
    for i in range(20):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT b.node, 0.15 * jump + 0.85 * (coalesce(g.x, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} JOIN b b2 USING (node) WHERE b2.deg IS NULL) * jump) AS r"
            f" FROM b LEFT JOIN (SELECT e.t AS node, sum(r / deg) AS x FROM e JOIN r{i} ON r{i}.node = e.s JOIN deg ON deg.node = e.s GROUP BY 1) g USING (node))"
        )
    return ", ".join(parts) + " SELECT node, round(r, 8) AS rank FROM r20"


_SCORES = f"""
WITH e AS (SELECT s, t FROM ({_EDGES}) WHERE t IS NOT NULL),
nb AS (SELECT node, count(DISTINCT other) AS neighbours, sum(o) AS fan_out, sum(i) AS fan_in FROM (SELECT s AS node, t AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, s, 0, 1 FROM e) GROUP BY 1),
k AS (SELECT user_id AS node, count(*) FILTER (event_type = 'purchase') * 100 + count(*) FILTER (event_type = 'view') * 35 AS state, count(*) FILTER (event_type = 'error') AS io FROM events GROUP BY 1),
j AS (SELECT k.node, coalesce(neighbours, 0) AS nbs, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, state, io FROM k LEFT JOIN nb USING (node)),
m AS (SELECT *, max(nbs) OVER () AS m1, max(fan_out) OVER () AS m2, max(state) OVER () AS m3, max(io) OVER () AS m4 FROM j),
x AS (SELECT node, fan_in,
  CAST(CASE WHEN m1 > 0 THEN floor(nbs / m1 * 100 + 0.5) ELSE 0 END AS BIGINT) AS reachability, CAST(CASE WHEN m2 > 0 THEN floor(fan_out / m2 * 100 + 0.5) ELSE 0 END AS BIGINT) AS orchestration,
  CAST(CASE WHEN m3 > 0 THEN floor(state / m3 * 100 + 0.5) ELSE 0 END AS BIGINT) AS state_authority, CAST(CASE WHEN m4 > 0 THEN floor(io / m4 * 100 + 0.5) ELSE 0 END AS BIGINT) AS boundary FROM m)"""

_JS_TEST = r"regexp_matches(path, '\.(test|spec)\.(ts|tsx|js|jsx)$') OR list_contains(string_split(path, '/'), '__tests__') OR string_split(path, '/')[1] IN ('test', 'tests', 'e2e')"

SQL: dict[str, str] = {
    "history_islands": """
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') || '::' || event_type AS k FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS b FROM e),
g AS (SELECT user_id, k, min(a) AS first_a, count(*) AS n, arg_min(event_id, a) AS lead_id FROM x GROUP BY user_id, k, a - b)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_a) AS island, k AS group_key, n, lead_id FROM g""",
    "primary_mode": """
SELECT user_id, day, event_type, n FROM (
  SELECT user_id, day, event_type, n, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, o) AS r FROM (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY ALL)) WHERE r = 1""",
    "kind_priority": """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
  arg_min(event_type, list_position(['purchase', 'signup', 'click', 'view', 'error'], event_type)) AS event_type FROM events GROUP BY 1, 2""",
    "latest_per_key": """
SELECT user_id, event_id, event_type, props->>'$.k' AS k FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "language_shares": """
WITH g AS (SELECT CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang IN ('es', 'fr') THEN 'romance' END AS analyzer, sum(n_chars) AS n FROM documents GROUP BY 1)
SELECT analyzer, CAST(n AS BIGINT) AS n, round(n / (SELECT sum(n_chars) FROM documents), 6) AS share FROM g WHERE analyzer IS NOT NULL AND n / (SELECT sum(n_chars) FROM documents) >= 0.1""",
    "top_language_message": """
WITH g AS (SELECT lang, sum(n_chars) AS n FROM documents GROUP BY 1)
SELECT 'No analyzer for ' || lang || ' (' || CAST(CAST(floor(n * 100 / (SELECT sum(n) FROM g) + 0.5) AS BIGINT) AS VARCHAR) || '% of the text)' AS message FROM g ORDER BY n DESC, lang DESC LIMIT 1""",
    "insert_or_get": """
WITH o AS (SELECT o_custkey AS k, o_orderkey, year(o_orderdate) AS y FROM orders),
a AS (SELECT k, min(o_orderkey) AS o_orderkey, 'old' AS origin FROM o WHERE y < 1997 GROUP BY k), b AS (SELECT k, min(o_orderkey) AS o_orderkey, 'new' AS origin FROM o WHERE y >= 1997 GROUP BY k)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)""",
    "upsert_last": """
SELECT o_custkey AS k, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey DESC) = 1""",
    "case_insensitive_canonical": """
WITH v AS (SELECT p_partkey, lower(p_name) AS low, p_size > 25 AS runs, CASE p_partkey % 3 WHEN 0 THEN upper(p_name)
  WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_name END AS spelling FROM part)
SELECT low, p_partkey AS id, spelling, n FROM (SELECT *, count(*) OVER (PARTITION BY low) AS n, row_number() OVER (PARTITION BY low ORDER BY spelling = low DESC, runs DESC, p_partkey) AS r FROM v) WHERE r = 1""",
    "islands_hot_key": """
WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_id FROM b GROUP BY 1""",
    "numbered_global": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem""",
    "numbered_runs": """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ord FROM events""",
    "cooldown_claims": """
WITH RECURSIVE s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, event_id, r, ts AS last_ok, true AS granted FROM s WHERE r = 1
  UNION ALL SELECT s.user_id, s.event_id, s.r, CASE WHEN f.last_ok <= s.ts - INTERVAL 1 HOUR THEN s.ts ELSE f.last_ok END, f.last_ok <= s.ts - INTERVAL 1 HOUR FROM f JOIN s ON s.user_id = f.user_id AND s.r = f.r + 1)
SELECT user_id, event_id, granted FROM f""",
    "remaining_seconds": """
SELECT user_id, CAST(greatest(0, ceil((epoch_us(max(ts)) + 3600000000 - epoch_us(TIMESTAMP '2024-01-30 23:00:00')) / 1000000)) AS BIGINT) AS remaining FROM events GROUP BY 1""",
    "stale_runs": """
SELECT o_orderstatus, count(*) FILTER (o_orderdate <= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 1 DAY) AS stale, count(*) AS n FROM orders GROUP BY 1""",
    "path_prefix_area": f"""
WITH p AS ({_PATHS}), s AS (SELECT page_id, path, string_split(path, '/') AS w FROM p),
pre AS (SELECT page_id, i, array_to_string(w[1:i], '/') AS a FROM (SELECT page_id, w, unnest(range(1, len(w))) AS i FROM s)),
ar AS (SELECT a FROM pre GROUP BY a HAVING count(*) >= 3)
SELECT p.page_id, coalesce((SELECT arg_max(pre.a, length(pre.a)) FROM pre WHERE pre.page_id = p.page_id AND pre.a IN (SELECT a FROM ar)), '.') AS area FROM p""",
    "alias_match": """
SELECT p_partkey, CASE WHEN p_name = 'blue bolt' THEN 'blue bolt' WHEN p_name LIKE 'small g%' THEN 'small g' WHEN p_name LIKE 'small%' THEN 'small'
  WHEN p_name LIKE 'red%' THEN 'red' WHEN p_name LIKE 'blue%' THEN 'blue' END AS pattern FROM part""",
    "candidate_resolution": rf"""
WITH p AS ({_PATHS}), q AS (SELECT page_id, path, regexp_replace(path, '\.[^./]+$', '') AS b FROM p),
c AS (SELECT page_id, unnest([b || '.html', b, b || '/index', CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END]) AS k, unnest([0, 1, 2, 3]) AS r FROM q),
h AS (SELECT page_id, arg_min(k, r) AS hit, min(r) AS hit_rank FROM c WHERE k IN (SELECT path FROM p) GROUP BY 1)
SELECT p.page_id, hit, CAST(hit_rank AS BIGINT) AS hit_rank FROM p LEFT JOIN h USING (page_id)""",
    "link_extract": """
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""",
    "import_classify": """
SELECT page_id, CASE WHEN h LIKE './%' OR h LIKE '../%' THEN 'relative' WHEN h LIKE '@/%' THEN 'alias' WHEN h LIKE '/%' THEN 'absolute' ELSE 'external' END AS kind, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) GROUP BY ALL""",
    "unique_name_join": """
SELECT p_brand, p_type, p_name, (SELECT CASE WHEN count(*) = 1 THEN min(q.p_partkey) END FROM part q WHERE q.p_brand = p.p_brand AND q.p_name = p.p_name) AS partkey,
  (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand AND q.p_name = p.p_name) AS local_n FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part) p""",
    "priority_cascade": """
WITH s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 2000), a AS (SELECT s_nationkey, min(s_suppkey) AS x FROM s GROUP BY 1), b AS (SELECT n_regionkey, min(s_suppkey) AS y FROM s GROUP BY 1)
SELECT c_custkey, coalesce(x, y) AS supp, CASE WHEN x IS NOT NULL THEN 'nation' WHEN y IS NOT NULL THEN 'region' ELSE 'none' END AS how
FROM customer JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN a ON a.s_nationkey = c_nationkey LEFT JOIN b ON b.n_regionkey = n.n_regionkey""",
    "unmatched_gaps": """
SELECT c_custkey AS k, 'unknown' AS certainty, 'no urgent order of ' || c_name AS description FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1-%')""",
    "external_deps_scope": """
SELECT l_partkey, CASE WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'direct' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'dev' ELSE 'peer' END AS scope, count(*) AS uses FROM lineitem GROUP BY 1""",
    "normalized_name_join": """
SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = 'nation' || s_nationkey GROUP BY 1""",
    "dependency_category": """
WITH q AS (SELECT CASE p_partkey % 8 WHEN 0 THEN 'jest-' || p_name WHEN 1 THEN 'vue-cli' WHEN 2 THEN 'react' WHEN 3 THEN 'eslint-' || p_name WHEN 4 THEN 'redis' WHEN 5 THEN 'types-' || p_name WHEN 6 THEN 'chart ' || p_name ELSE p_name END AS package,
  CASE p_partkey % 8 WHEN 0 THEN 'testing' WHEN 1 THEN 'cli' WHEN 2 THEN 'framework' WHEN 3 THEN 'devTooling' WHEN 4 THEN 'database' ELSE 'other' END AS category FROM part)
SELECT category, count(*) AS n, min(package) AS first_package FROM q GROUP BY 1""",
    "area_links": _LINKS,
    "area_rank": f"""
WITH l AS ({_LINKS}), d AS (SELECT k, count(DISTINCT x) AS links FROM (SELECT from_id AS k, to_id AS x FROM l UNION ALL SELECT to_id, from_id FROM l) GROUP BY 1),
o AS (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT n_name, coalesce(links, 0) AS links, coalesce(orders, 0) AS orders, row_number() OVER (ORDER BY n_nationkey % 5 = 0, coalesce(links, 0) DESC, coalesce(orders, 0) DESC, n_name) AS place
FROM nation LEFT JOIN d ON d.k = n_nationkey LEFT JOIN o ON o.k = n_nationkey""",
    "production_filter": """
WITH c AS (SELECT p_brand, 0 AS s, l_orderkey AS o, 'returned in order ' || l_orderkey AS why FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_returnflag = 'R' AND l_discount > 0.095
  UNION ALL SELECT p_brand, 1, p_partkey, 'holds part ' || p_partkey FROM part WHERE p_size >= 50 AND p_retailprice > 1500)
SELECT p_brand, count(*) AS n, (SELECT why FROM c WHERE c.p_brand = p.p_brand ORDER BY s, o LIMIT 1) AS why FROM part p GROUP BY p_brand""",
    "degree": f"""
WITH e AS (SELECT s, t FROM ({_EDGES}) WHERE t IS NOT NULL)
SELECT u AS node, (SELECT count(*) FROM e WHERE t = u) AS fan_in, (SELECT count(*) FROM e WHERE s = u) AS fan_out, (SELECT count(DISTINCT x) FROM (SELECT t AS x FROM e WHERE s = u UNION SELECT s FROM e WHERE t = u)) AS neighbours
FROM (SELECT DISTINCT user_id AS u FROM events)""",
    "reference_counts": f"""
WITH e AS (SELECT s, t FROM ({_EDGES}) WHERE t IS NOT NULL)
SELECT u AS node, 1 + (SELECT count(*) FROM e WHERE t = u) + (SELECT count(*) FROM e WHERE s = u) AS refs FROM (SELECT DISTINCT user_id AS u FROM events)""",
    "decayed_reachability": _reach(_EDGES),
    "reach_of_purchases": _reach(f"{_EDGES} WHERE event_type = 'purchase'"),
    "call_chains": f"""
WITH RECURSIVE l AS ({_LINKS}),
e AS (SELECT DISTINCT a.n_regionkey AS r, from_id, to_id FROM l JOIN nation a ON a.n_nationkey = from_id JOIN nation b ON b.n_nationkey = to_id AND b.n_regionkey = a.n_regionkey),
c AS (
  SELECT n_regionkey AS r, [min(n_nationkey)] AS p, false AS closed FROM nation GROUP BY 1
  UNION ALL SELECT c.r, c.p || [to_id], list_contains(c.p, to_id) FROM c JOIN e ON e.r = c.r AND e.from_id = c.p[len(c.p)] WHERE NOT closed AND len(c.p) < 4
)
SELECT r AS run_id, array_to_string(p, '>') AS path, closed FROM c""",
    "pagerank": _pagerank("sd AS (SELECT node FROM v WHERE false), sk AS (SELECT 0 AS k)"),
    "seeded_pagerank": _pagerank("sd AS (SELECT user_id AS node FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND event_type = 'signup'), sk AS (SELECT count(*) AS k FROM sd)"),
    "importance_score": f"{_SCORES} SELECT node, reachability, orchestration, state_authority, boundary, CAST(floor((20 * reachability + 30 * orchestration + 25 * state_authority + 25 * boundary) / 100 + 0.5) AS BIGINT) AS score FROM x",
    "roles": f"""{_SCORES} SELECT node, CASE WHEN r = '' AND fan_in > 0 THEN 'UTILITY' ELSE r END AS roles FROM (SELECT *, concat_ws('|', CASE WHEN orchestration >= 60 THEN 'ORCHESTRATOR' END,
  CASE WHEN state_authority >= 60 THEN 'STATE_CONTROLLER' END, CASE WHEN boundary >= 60 THEN 'BOUNDARY' END) AS r FROM x)""",
    "reasons_topk": """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_id) AS place, event_id
FROM events WHERE event_type = 'purchase' QUALIFY place <= 3""",
    "call_roots": f"""
WITH l AS ({_LINKS}), r AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT to_id FROM l WHERE n >= 8))
SELECT id FROM r UNION ALL SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM r)""",
    "neighborhood": f"""
WITH l AS ({_LINKS}), f AS (SELECT n_regionkey AS run_id, min(n_nationkey) AS id FROM nation GROUP BY 1)
SELECT run_id, id FROM f UNION SELECT run_id, to_id FROM f JOIN l ON from_id = id UNION SELECT run_id, from_id FROM f JOIN l ON to_id = id""",
    "round_robin_merge": """
WITH j AS (SELECT n_regionkey, n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY i, n_nationkey) AS place, s_suppkey FROM j QUALIFY place <= 7""",
    "slugs": """
WITH b AS (SELECT p_partkey, p_brand, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)
SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand, s ORDER BY p_partkey) = 1 THEN s ELSE s || '-' || row_number() OVER (PARTITION BY p_brand, s ORDER BY p_partkey) END AS slug FROM b""",
    "paging": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 30",
    "last_page": """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, ord FROM n WHERE ord > (n - 1) // 40 * 40""",
    "featured": """
SELECT n_name, row_number() OVER (ORDER BY coalesce(list_position(['NATION_7', 'NATION_3', 'NATION_99'], n_name), 1000), n_nationkey DESC) AS place FROM nation QUALIFY place <= 6""",
    "dep_sort_desc": """
WITH a AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal), s_name, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_suppkey, n - r + 1 AS place FROM a""",
    "median_budget": """
WITH m AS (SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1), b AS (SELECT * FROM (VALUES ('click', 50.0::DOUBLE), ('view', 40.0), ('purchase', 60.0), ('signup', 30.0)) t(event_type, budget))
SELECT event_type, median, budget, coalesce(median > budget, false) AS over_budget FROM m LEFT JOIN b USING (event_type)""",
    "contract_flags": """
SELECT *, all_shipped AND NOT any_returned AND enough AS complete FROM (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS all_shipped, bool_or(l_returnflag = 'R') AS any_returned, count(*) >= 3 AS enough FROM lineitem GROUP BY 1)""",
    "indexable": """
SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority NOT LIKE '1-%'""",
    "recency_buckets": """
SELECT CASE WHEN epoch(TIMESTAMP '2024-02-03 12:00:00') - floor(epoch(ts)) < 604800 THEN 'This week' WHEN date_trunc('month', ts) = DATE '2024-02-01' THEN 'Earlier this month' ELSE strftime(ts, '%B %Y') END AS bucket, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1""",
    "semver_max": """
SELECT p_brand, 'v' || a || '.' || b || '.' || c AS version FROM (SELECT p_brand, p_size % 4 AS a, p_partkey % 13 AS b, p_partkey % 29 AS c FROM part) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY a DESC, b DESC, c DESC) = 1""",
    "skipped_examples": """
WITH o AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WHERE o_orderpriority LIKE '1-%')
SELECT o_orderstatus, n, string_agg(o_orderkey, ', ' ORDER BY o_orderkey) || CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more' ELSE '' END AS examples FROM o WHERE i <= 5 GROUP BY 1, 2""",
    "patch_lines": """
SELECT doc_id, CASE WHEN regexp_matches(line, '^[A-M]') THEN '-' ELSE '+' END AS sign, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[A-Z]') GROUP BY 1, 2""",
    "data_layer_paths": rf"""
WITH p AS ({_PATHS}), q AS (SELECT page_id, replace(replace(path, '/en/', '/models/'), '/fr/', '/Schema2/') AS path FROM p)
SELECT page_id, regexp_matches(path, '(?i)(^|/)(models?|migrations?|schema\w*|db|database)(/|$)') AS data_layer, true AS manifest FROM q""",
    "test_file_predicate": rf"""
WITH p AS ({_PATHS}), q AS (SELECT page_id, ['src/', 'tests/', 'pkg/__tests__/', 'lib/e2e/x/'][page_id % 4 + 1] || string_split(path, '/')[-1] || ['.test.ts', '.py', '.js'][page_id % 3 + 1] AS path FROM p)
SELECT page_id, {_JS_TEST} AS js_test, (regexp_matches(string_split(path, '/')[-1], '^(test_.*|.*_test)\.py$') OR string_split(path, '/')[1] IN ('test', 'tests')) AS py_test,
  ['', 'tests', 'pkg/__tests__', 'lib/e2e'][page_id % 4 + 1] AS root FROM q""",
    "evidence_count": """
SELECT o_orderstatus, CAST(sum(1 + (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)) AS BIGINT) AS evidence FROM orders GROUP BY 1""",
    "state_scope": "SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'shared' ELSE 'local' END AS scope FROM lineitem GROUP BY 1",
    "boundary_dedupe": """
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, n FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
    "nearest_span": """
SELECT o.o_orderkey, (SELECT s.o_orderkey FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderpriority LIKE '1-%' AND s.o_orderdate <= o.o_orderdate AND o.o_orderdate < s.o_orderdate + INTERVAL 90 DAY ORDER BY s.o_orderdate DESC, s.o_orderkey DESC LIMIT 1) AS span_id FROM orders o""",
    "language_version_key": "SELECT source, 'dispatch-v1:' || string_agg(DISTINCT lang || '-v1', '+' ORDER BY lang || '-v1') AS version FROM documents GROUP BY 1",
    "running_limits": """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, CASE WHEN n > 12 THEN 'too-many' ELSE 'too-large' END AS code FROM r WHERE n > 12 OR t > 150000000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n) = 1""",
    "area_subdivision": rf"""
WITH p AS (SELECT page_id, string_split(regexp_replace(path, '([0-9])', '\1/', 'g') || 'x', '/') AS w FROM ({_PATHS})), q AS (SELECT page_id, w[1:len(w) - 1] AS dirs FROM p),
s AS (SELECT page_id, d, array_to_string(dirs[1:d], '/') AS name, len(dirs) > d AS deeper FROM q, (SELECT unnest(range(2, 20)) AS d)),
g AS (SELECT d, name, count(*) > 10 AND bool_or(deeper) AS split FROM s GROUP BY 1, 2)
SELECT page_id, arg_min(s.name, s.d) AS area FROM s JOIN g ON g.d = s.d AND g.name = s.name WHERE NOT split GROUP BY 1""",
}
