"""The jobs as queries: each runs its job twice into one new folder, as a scheduler would, and returns the output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.session import shared_dir

from . import history, site_links


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "history")
    for _ in range(2):  # a pattern, as a file stream reads folders and patterns, not single files
        history.run(spark, f"{sf_dir}/event[s].parquet", f"{root}/out", f"{root}/checkpoint")
    return history.read_entries(spark, f"{root}/out")


def job2_site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables: `part` says which one a row is from."""
    root = _folder(spark, "site-links")
    for _ in range(2):
        site_links.run(spark, f"{sf_dir}/pages.parquet", f"{root}/out")
    found = site_links.read_links(spark, f"{root}/out").select(F.lit("links").alias("part"), "*")
    return found.unionByName(site_links.read_areas(spark, f"{root}/out").select(F.lit("areas").alias("part"), "*"), allowMissingColumns=True)


QUERIES = {"job1_history": job1_history, "job2_site_links": job2_site_links}

SQL: dict[str, str] = {
    "job1_history": """
WITH e AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, ts, user_id, event_type, value FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), event_id ORDER BY ts, user_id, event_type, value) = 1
), f AS (
  SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
  FROM e WINDOW w AS (PARTITION BY day, user_id ORDER BY ts DESC, event_id DESC)
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY day, user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS entry FROM f
)
SELECT day, user_id, CAST(entry AS BIGINT) AS entry, any_value(event_type) AS event_type, count(*) AS n_events, round(sum(value), 2) AS total_value, arg_max(event_id, (ts, event_id)) AS lead_event_id,
       min(ts) AS started, max(ts) AS ended
FROM g GROUP BY day, user_id, entry""",
    "job2_site_links": r"""
WITH p AS (
  SELECT page_id, html, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS page FROM pages
), q AS (SELECT *, string_split(page, '/') AS s FROM p WHERE page <> ''),
h AS (SELECT page_id, page, s, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM q),
l AS (SELECT page_id, page, s, array_to_string(s[1:len(s) - 1], '/') AS area, unnest(hs) AS href, unnest(range(len(hs))) AS pos FROM h),
k AS (
  SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'url' WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'other'
    WHEN href = '' OR href[1] IN ('#', '?') THEN 'self' WHEN href[1] = '/' THEN 'absolute' WHEN starts_with(href, '@/') THEN 'alias' ELSE 'relative' END AS kind FROM l
), b AS (
  -- '.' and '..' segments don't occur in the tables' links
  SELECT *, list_filter(string_split(regexp_replace(href, '[?#].*$', ''), '/'), lambda x: x NOT IN ('', '.')) AS bare FROM k
), t AS (
  SELECT *, CASE kind
    WHEN 'url' THEN regexp_replace(lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
    WHEN 'self' THEN page WHEN 'absolute' THEN array_to_string([s[1]] || bare, '/') WHEN 'relative' THEN array_to_string(s[1:greatest(1, len(s) - 1)] || bare, '/') END AS target FROM b
), d AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS dir FROM (SELECT s, unnest(range(1, len(s))) AS i FROM q)),
n AS (SELECT DISTINCT page FROM q),
r AS (
  SELECT t.*, CASE WHEN target IN (SELECT page FROM n) THEN target WHEN target || '.html' IN (SELECT page FROM n) THEN target || '.html' WHEN target || '/index' IN (SELECT page FROM n) THEN target || '/index' END AS at_page,
         target IN (SELECT dir FROM d) AS is_dir, string_split(target, '/')[1] IN (SELECT s[1] FROM q) AS host_known FROM t
), f AS (
  SELECT page_id, pos, href, kind, target, coalesce(at_page, CASE WHEN is_dir THEN target END) AS hit, area,
         CASE WHEN at_page IS NOT NULL THEN 'page' WHEN is_dir THEN 'area' WHEN target IS NOT NULL AND NOT host_known THEN 'external' ELSE 'gap' END AS resolution FROM r
), own AS (SELECT array_to_string(s[1:len(s) - 1], '/') AS area, count(*) AS n_pages FROM q GROUP BY 1),
o AS (SELECT area, count(*) AS n_links, count(hit) AS n_resolved, count(*) FILTER (resolution = 'gap') AS n_gaps FROM f GROUP BY 1),
c AS (
  SELECT dest AS area, count(*) AS n_in FROM (
    SELECT area, CASE WHEN resolution = 'area' THEN hit ELSE array_to_string(string_split(hit, '/')[1:len(string_split(hit, '/')) - 1], '/') END AS dest FROM f WHERE hit IS NOT NULL)
  WHERE dest <> area GROUP BY 1
)
SELECT 'links' AS part, page_id, CAST(pos AS BIGINT) AS pos, href, kind, target, hit, area,
       CASE WHEN resolution = 'gap' THEN CASE WHEN target IS NOT NULL THEN 'no page or area has this path' ELSE 'not a path: ' || kind END END AS reason, resolution,
       CAST(NULL AS BIGINT) AS n_pages, CAST(NULL AS BIGINT) AS n_links, CAST(NULL AS BIGINT) AS n_resolved, CAST(NULL AS BIGINT) AS n_gaps, CAST(NULL AS BIGINT) AS n_in, CAST(NULL AS INTEGER) AS level
FROM f
UNION ALL
SELECT 'areas', NULL, NULL, NULL, NULL, NULL, NULL, area, NULL, NULL, n_pages, coalesce(n_links, 0), coalesce(n_resolved, 0), coalesce(n_gaps, 0), coalesce(n_in, 0),
       CAST(len(list_filter(string_split(area, '/'), lambda x: x <> '')) AS INTEGER)
FROM own LEFT JOIN o USING (area) LEFT JOIN c USING (area)""",
}
