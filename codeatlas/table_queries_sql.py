"""The queries of table_queries.py in DuckDB's SQL, written from their descriptions."""

_LINKS = """
SELECT c_nationkey AS from_id, s_nationkey AS to_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"""
_FILES = """
SELECT page_id, ['', 'src/', 'tests/', 'e2e/', 'src/__fixtures__/', 'pkg/__mocks__/a/'][page_id % 6 + 1]
  || ['a.test.ts', 'test_b.py', 'setup.py', 'vite.config.ts', 'jest.setup.mjs', 'logo.SVG', 'x.module.css', 'conftest.py'][page_id // 6 % 8 + 1] AS path FROM pages"""
_RUNS = "SELECT o_custkey AS repo_id, o_orderpriority AS commit_sha, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'partial' END AS status, '{}' || o_orderkey AS result, o_orderdate, o_orderkey, year(o_orderdate) >= 1997 AS late FROM orders"

SQL: dict[str, str] = {
    "source_languages": """
WITH t AS (SELECT source, sum(n_chars) AS total FROM documents GROUP BY 1),
g AS (SELECT source, CASE WHEN lang IN ('en', 'de') THEN 'js-ts' ELSE 'python' END AS analyzer, sum(n_chars) AS n FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY 1, 2)
SELECT source AS run_id, analyzer, round(n / total, 6) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, analyzer) AS place FROM g JOIN t USING (source) WHERE n / total >= 0.1""",
    "unsupported_sources": """
WITH g AS (SELECT source, lang, sum(n_chars) AS n FROM documents GROUP BY 1, 2),
t AS (SELECT source, arg_max(lang, (n, lang)) AS lang, max(n) AS top, sum(n) AS total FROM g GROUP BY 1)
SELECT source AS run_id, 'It currently analyzes JavaScript, TypeScript, and Python only. o/' || source || '''s primary language is ' || lang || ' (' || CAST(floor(top / total * 100 + 0.5) AS INTEGER)
  || '% of classified source), so no supported analyzer could produce a result.' AS message FROM t""",
    "ranked_areas": f"""
WITH l AS ({_LINKS}),
a AS (SELECT n_regionkey AS run_id, n_nationkey AS k, n_name AS name, n_nationkey % 3 = 1 AS tests FROM nation WHERE n_nationkey % 7 <> 0),
x AS (SELECT a.*, (SELECT count(*) FROM l WHERE from_id = k AND n > 1) + (SELECT count(*) FROM l WHERE to_id = k AND n > 2) AS links, (SELECT count(*) FROM supplier WHERE s_nationkey = k) AS entries FROM a)
SELECT run_id, name, links, row_number() OVER (PARTITION BY run_id ORDER BY tests, links DESC, entries DESC, name) AS place FROM x""",
    "area_slugs": """
WITH b AS (SELECT p_partkey AS ord, p_brand, CASE WHEN p_partkey % 9 = 0 THEN 'area' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS s FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, s ORDER BY ord) AS i FROM b)
SELECT ord, CASE WHEN i = 1 THEN s ELSE s || '-' || i END AS slug FROM n""",
    "ranked_functions": """
SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 0 END DESC, p_name, p_partkey) AS place FROM part""",
    "unique_callees": """
WITH f AS (SELECT o_custkey AS caller, l_suppkey AS callee, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT caller, callee, s_name AS name, row_number() OVER (PARTITION BY caller ORDER BY o, callee) AS place FROM f JOIN supplier ON s_suppkey = callee""",
    "evidence_totals": """
SELECT o_custkey AS run_id, CAST(sum(1 + (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)) AS BIGINT) AS evidence FROM orders GROUP BY 1""",
    "value_contract": """
SELECT o_custkey AS run_id, CASE WHEN count(*) >= 3 AND bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AND max(o_totalprice) > 200000
  AND count(*) FILTER (o_orderpriority LIKE '1-%' AND o_totalprice <= 20000) = 0 AND min(o_totalprice) < 400000 THEN 'completed' ELSE 'partial' END AS status FROM orders GROUP BY 1""",
    "skipped_gaps": """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, CASE WHEN o_orderpriority LIKE '1-%' THEN 'symbolic link' ELSE 'device' END AS t
  FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%')
SELECT o_custkey AS run_id, n || CASE WHEN n = 1 THEN ' tarball entry was' ELSE ' tarball entries were' END
  || ' skipped during extraction because they weren''t a regular file or directory (e.g. a symbolic link): ' || string_agg('''o' || o_orderkey || ''' (' || t || ')', ', ' ORDER BY i)
  || CASE WHEN n > 5 THEN ', and ' || (n - 5) || ' more' ELSE '' END || '. These paths were not analyzed.' AS description
FROM o WHERE i <= 5 GROUP BY o_custkey, n""",
    "budgets": """
WITH m AS (SELECT event_type AS metric, median(value) FILTER (user_id % 2 = 0) AS a, median(value) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT metric, round(a, 6) AS target, round(b, 6) AS production, round(a - b, 6) AS delta, coalesce(metric NOT IN ('view', 'error') AND a > length(metric) * 6.5, false) AS over_budget FROM m""",
    "latest_version": """
SELECT 'v' || a || '.' || b || '.' || c AS latest, 'v' || a || '.' || b || '.' || (c + 1) AS next_patch, 'v' || a || '.' || (b + 1) || '.0' AS next_minor, 'v' || (a + 1) || '.0.0' AS next_major
FROM (SELECT p_size % 4 AS a, p_partkey % 13 AS b, p_partkey % 29 AS c FROM part WHERE p_partkey % 5 > 0) ORDER BY a DESC, b DESC, c DESC LIMIT 1""",
    "dependency_order": """
WITH u AS (SELECT p_partkey, p_brand, p_name, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS uses, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = p_partkey) AS n_files FROM part)
SELECT p_partkey AS ord, uses, n_files, row_number() OVER (PARTITION BY p_brand ORDER BY uses DESC, lower(p_name) DESC, p_partkey DESC) AS place FROM u""",
    "search_parts": """
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%blue%' OR p_brand ILIKE '%blue%'""",
    "indexable_customers": """
WITH f AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey FROM f JOIN customer ON c_custkey = o_custkey WHERE s = 'F' AND top > 300000 AND NOT c_acctbal < 0 AND c_name NOT LIKE '%7'""",
    "commit_listing": """
WITH c AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS author_name, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT user_id AS run_id, event_id, author_name, n > 5 AS truncated FROM c WHERE i <= 5""",
    "store_runs": f"""
WITH r AS ({_RUNS}),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, commit_sha ORDER BY late, o_orderdate, o_orderkey) AS i, bool_or(late) OVER (PARTITION BY repo_id, commit_sha) AS asked FROM r)
SELECT repo_id, commit_sha, status, result, asked AS returned, row_number() OVER (PARTITION BY repo_id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest FROM k WHERE i = 1""",
    "store_history": """
SELECT o_custkey AS repo_id, CAST(max(o_orderkey) AS VARCHAR) AS computed_through_sha, CAST(count(*) AS VARCHAR) AS entries FROM orders WHERE o_custkey % 3 = 0 OR year(o_orderdate) < 1997 GROUP BY 1""",
    "schema_versions": """
WITH a AS (SELECT *, CASE WHEN year(o_orderdate) >= 1997 THEN 3 WHEN year(o_orderdate) >= 1995 OR o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE '?' END AS guess FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN v = 1 THEN guess ELSE o_orderstatus END AS o_orderstatus, CASE v WHEN 3 THEN o_orderpriority WHEN 2 THEN 'by-status-' || o_orderstatus ELSE 'by-status-' || guess END AS o_orderpriority,
       v AS schema_version FROM a""",
    "archive_round_trip": """
WITH p AS (SELECT page_id, page_id // 8 AS r, page_id // 8 % 5 AS k, page_id % 8 = 3 AS odd, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, k = 3 AND odd AS link, CASE WHEN k = 3 AND odd THEN 0 ELSE octet_length(encode(html)) END AS size FROM p),
s AS (SELECT *, sum(size) OVER (PARTITION BY r ORDER BY page_id) AS total FROM q),
g AS (
  SELECT r, k, min(page_id) FILTER (k = 1 AND odd) AS unsafe_at, min(page_id) FILTER (total > 60000) AS large_at, count(*) FILTER (NOT link) AS n, sum(length(html)) FILTER (NOT link) AS chars, min(page_id) FILTER (link) AS link_at
  FROM s GROUP BY r, k
), c AS (
  SELECT *, CASE WHEN k = 2 THEN 'unreadable' WHEN unsafe_at IS NOT NULL AND (large_at IS NULL OR unsafe_at <= large_at) THEN 'unsafe-entry' WHEN large_at IS NOT NULL THEN 'extracted-too-large' END AS code FROM g
)
SELECT CAST(r AS VARCHAR) AS run_id, code, CASE WHEN code IS NULL THEN n ELSE 0 END AS n_files, CAST(CASE WHEN code IS NULL THEN chars ELSE 0 END AS BIGINT) AS chars,
       CASE WHEN code IS NULL AND link_at IS NOT NULL THEN 'src/p' || link_at || '.html' END AS skipped FROM c""",
    "repository_urls": r"""
WITH a AS (SELECT page_id, [concat('https://github.com/Octo/r', page_id, '.git'), concat('octo/r', page_id), concat('github.com/o/r', page_id, '/tree/main'), url, concat('-o/r', page_id), concat('www.GitHub.com/r', page_id)][page_id % 6 + 1] AS asked FROM pages)
SELECT page_id, asked, CASE page_id % 6 WHEN 0 THEN 'Octo' WHEN 1 THEN 'octo' WHEN 2 THEN 'o' END AS owner, CASE WHEN page_id % 6 < 3 THEN 'r' || page_id END AS repo,
       CASE page_id % 6 WHEN 3 THEN 'unsupported-host' WHEN 4 THEN 'invalid-owner' WHEN 5 THEN 'missing-owner-or-repo' END AS reason FROM a""",
    "path_predicates": rf"""
WITH f AS (SELECT page_id, path, string_split(path, '/') AS s FROM ({_FILES}))
SELECT page_id, path, regexp_matches(path, '\.(test|spec)\.(ts|tsx|js|jsx)$') OR s[1] IN ('test', 'tests', 'e2e') OR list_contains(s, '__tests__') AS js_test, s[-1] = 'test_b.py' OR s[1] IN ('test', 'tests') AS py_test,
       path IN ('vite.config.ts', 'jest.setup.mjs') AS js_tooling, path = 'setup.py' AS py_tooling, list_has_any(s, ['fixtures', '__fixtures__', '__mocks__']) AS support, s[-1] IN ('logo.SVG', 'x.module.css') AS asset, s[1] = 'e2e' AS e2e,
       list_has_any(s[1:len(s) - 1], ['test', 'tests', '__tests__', 'e2e']) AS under_root FROM f""",
    "relative_paths": f"""
WITH f AS (SELECT page_id, path, string_split(path, '/') AS s, page_id % 5 AS k FROM ({_FILES}))
SELECT page_id, CASE k WHEN 0 THEN array_to_string(s[1:len(s) - 1] || ['x'], '/') WHEN 1 THEN array_to_string(s[1:greatest(0, len(s) - 2)] || ['x', 'y'], '/') WHEN 2 THEN array_to_string(s[1:greatest(0, len(s) - 4)] || ['z'], '/') END AS target,
       CASE k WHEN 3 THEN '@scope/pkg' WHEN 4 THEN 'pkg' END AS package, path AS inside FROM f""",
    "text_labels": """
WITH p AS (SELECT p_partkey, p_name, p_partkey % 3 AS k, ['a', 'b', p_name][1:p_partkey % 4] AS parts, string_split(p_name, ' ') AS w, ' ' || repeat(p_name, p_partkey % 9) AS r FROM part)
SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS title, k || CASE WHEN k = 1 THEN ' entry' ELSE ' entries' END AS plural, CASE k WHEN 0 THEN 'no gaps' WHEN 1 THEN '1 gap' ELSE k || ' gaps' END AS phrase,
       CASE len(parts) WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b and ' || p_name END AS joined, upper(CASE WHEN len(w) >= 2 THEN w[1][1] || w[-1][1] ELSE p_name[1:2] END) AS initials,
       CASE k WHEN 0 THEN '/' WHEN 1 THEN '/a' ELSE '/b/c' END AS label, CASE k WHEN 0 THEN 'b' WHEN 1 THEN 'c' ELSE '/' END AS last,
       CASE WHEN length(trim(r)) > 89 THEN rtrim(trim(r)[1:89]) || '…' ELSE trim(r) END AS lead,
       'https://github.com/o/r/blob/s/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '#L' || p_partkey ELSE '' END AS blob, 'https://github.com/o/r/tree/s' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/src' END AS tree
FROM p""",
    "relative_times": """
WITH a AS (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1000000) AS BIGINT) * (event_id % 40) AS s FROM events)
SELECT event_id, CASE WHEN s >= 31536000 THEN CASE WHEN s // 31536000 = 1 THEN 'last year' ELSE s // 31536000 || ' years ago' END WHEN s >= 2592000 THEN CASE WHEN s // 2592000 = 1 THEN 'last month' ELSE s // 2592000 || ' months ago' END
  WHEN s >= 86400 THEN CASE WHEN s // 86400 = 1 THEN 'yesterday' ELSE s // 86400 || ' days ago' END WHEN s >= 3600 THEN CASE WHEN s // 3600 = 1 THEN '1 hour ago' ELSE s // 3600 || ' hours ago' END
  WHEN s >= 60 THEN CASE WHEN s // 60 = 1 THEN '1 minute ago' ELSE s // 60 || ' minutes ago' END ELSE 'just now' END AS said FROM a""",
    "page_clamps": """
WITH n AS (SELECT o_custkey, greatest(1, CAST(ceil(count(*) / 4) AS BIGINT)) AS pages FROM orders GROUP BY 1)
SELECT o_custkey, least(greatest(CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE o_custkey % 9 - 2 END, 1), pages) AS page FROM n""",
    "registry_enrichment": """
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN ' ' END ELSE p_type END AS description,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN p_brand ELSE array_to_string(string_split(p_brand, ' '), ' ') || ' b' END AS keywords FROM part),
d AS (SELECT l_suppkey AS run_id, l_orderkey * 100 + l_linenumber AS ord, l_partkey AS k, rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT run_id, ord, CASE WHEN d.k % 2 = 0 THEN 'npm' ELSE 'pypi' END AS registry, 'p' || d.k AS name, CASE WHEN n <= 100 THEN description END AS description,
  CASE WHEN n <= 100 AND description IS NOT NULL THEN CASE WHEN d.k % 2 = 0 THEN 'npm' ELSE 'pypi' END END AS description_source, CASE WHEN n <= 100 THEN keywords END AS keywords,
  CASE WHEN n > 100 THEN 'Description lookup skipped: more than 100 external dependencies were declared in this repository.'
    WHEN description IS NULL THEN 'Could not fetch a description for "p' || d.k || '" from the ' || CASE WHEN d.k % 2 = 0 THEN 'npm' ELSE 'PyPI' END || ' registry.' END AS enrichment_gap
FROM d LEFT JOIN p USING (k)""",
}
