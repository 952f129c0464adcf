"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens
    from ._common import new_path

    return tokens.tokenize(spark, _read(spark, sf_dir, "documents"), new_path(spark, "tokens"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import paragraphs

    found = paragraphs.find_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_repeats", "removed_chars", "class_id", F.to_json("removed").alias("removed_spans"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    out = sharding.shard_rows(_read(spark, sf_dir, "documents"), shards=8, law="rows")
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    led = quality.ledger(_read(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejected(quality.POLICIES["base"]).alias("base_failed"), (~quality.rejected(quality.POLICIES["v1"])).alias("kept"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join_components(_read(spark, sf_dir, "documents"), percent=85, n=4)


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wrappers

    return wrappers.extract_pages(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from ._common import new_path

    return warc.round_trip(spark, _read(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat
    from ._common import materialize

    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    output = materialize(chat.render_rows(chat.fold_rows(chat.events_of_rows(rows.unionByName(probe)))), "chat")
    return chat.digest(output)


#: (host, path prefix, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_templates

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_templates.judge(_read(spark, sf_dir, "pages"), rules)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_tokens": op2_tokens,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_extraction": op7_extraction,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_url_filter": op11_url_filter,
    "op12_ranked_search": op12_ranked_search,
}


def _template_sql() -> str:
    """The levels of the template tree as common table expressions t1 to t4."""
    out = []
    for i in range(1, 5):
        segment = "CASE WHEN len(p) >= 4 THEN array_to_string(p[4:], '/') END" if i == 4 else f"CASE WHEN len(p) >= {i} THEN p[{i}] END"
        out.append(f"""
s{i} AS (SELECT *, {segment} AS s FROM t{i - 1}),
c{i} AS (SELECT host, t, s, sum(n) AS c, sum(sum(n)) OVER (PARTITION BY host, t) AS total FROM s{i} WHERE s IS NOT NULL GROUP BY host, t, s),
f{i} AS (SELECT host, t, s FROM c{i} WHERE c >= 5 AND c * 20 >= total AND NOT regexp_full_match(s, '[0-9]+|\\*')),
t{i} AS (
  SELECT x.host, x.path, x.n, x.good, x.bad, x.rule, x.ruled, x.p, x.t || CASE WHEN x.s IS NULL THEN '' WHEN f.s IS NOT NULL THEN '/' || x.s ELSE '/*' END AS t
  FROM s{i} x LEFT JOIN f{i} f ON f.host = x.host AND f.t = x.t AND f.s = x.s
)""")
    return ",".join(out)


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op7_extraction": r"""
WITH p AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)</article>', 1, 's'),
           '<br[^>]*>', ' ', 'g'), '</?(p|h1|h2|h3|div|li|ul)\b[^>]*>', chr(1), 'g'), chr(1)) AS b
  FROM pages
),
t AS (
  SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'),
      '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'),
    '[ \t\r\n]+', ' ', 'g'))), lambda x: x <> '') AS b
  FROM p
)
SELECT page_id, url, array_to_string(b, chr(10)) AS text, CAST(length(array_to_string(b, chr(10))) AS BIGINT) AS n_chars FROM t""",
    "op6_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_in JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, y FROM reach JOIN link ON b = x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)""",
    "op5_quality": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_exclaims,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines)
            OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)) OR 10 * n_exclaims > 5 * n_words) AS kept
FROM m""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw))
),
hit AS (SELECT doc_id, item_id, i, l FROM dw JOIN bw USING (l, k)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(i // 4 AS BIGINT) * 5 + 1, 5))::BIGINT >> CAST((3 - i % 4) * 5 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM m""",
    "op10_chat": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(role, '&', '&a'), '<', '&l'), '[', '&b') AS erole,
         replace(replace(replace(text, '&', '&a'), '<', '&l'), '[', '&b') AS etext FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length('<|turn|>') + length(erole) + length('<|text|>') + length(etext) + length('<|end|>') + 1) AS chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g""",
    "op11_url_filter": rf"""
WITH rules(rhost, rpath, ruled) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
),
u AS (SELECT host, path, count(*) AS n FROM a GROUP BY host, path),
m AS (
  SELECT u.host, u.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(ruled, length(rhost || rpath)) AS ruled
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY u.host, u.path
),
t0 AS (
  SELECT u.host, u.path, n, CASE WHEN ruled = 'allow' THEN n ELSE 0 END AS good, CASE WHEN ruled = 'block' THEN n ELSE 0 END AS bad, rule, ruled,
         list_filter(string_split(u.path, '/'), lambda x: x <> '') AS p, '' AS t
  FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path
),{_template_sql()},
k AS (SELECT host, t, sum(good) AS good, sum(bad) AS bad, regexp_extract(t, '((?:/[*])*)\z', 1) AS tail FROM t4 GROUP BY host, t),
h AS (SELECT *, regexp_extract(substr(t, 1, length(t) - length(tail)), '^(.*/)?[^/]*\z', 1) AS parent FROM k),
g AS (
  SELECT *, good + bad > 0 AND 100.0::DOUBLE * gap * gap <= 384.0::DOUBLE * mm * bb * (aa - bb) AS alike FROM (
    SELECT *, bad::DOUBLE * aa - mm * bb AS gap FROM (
      SELECT *, (good + bad)::DOUBLE AS mm, (sum(bad) OVER w)::DOUBLE AS bb, (sum(good + bad) OVER w)::DOUBLE AS aa FROM h WINDOW w AS (PARTITION BY host, parent, tail)))
),
j AS (
  SELECT host, t, CASE WHEN alike THEN sum(good) OVER w ELSE good END AS n_good, CASE WHEN alike THEN sum(bad) OVER w ELSE bad END AS n_bad
  FROM g WINDOW w AS (PARTITION BY host, parent, tail, alike)
)
SELECT page_id, a.host, a.path, t4.rule, coalesce(t4.ruled, CASE WHEN (n_good + 2) * 10 < (n_good + n_bad + 3) * 4 THEN 'block' ELSE 'allow' END) AS verdict,
       t4.t AS template, CAST(n_good AS BIGINT) AS n_good, CAST(n_bad AS BIGINT) AS n_bad
FROM a JOIN t4 ON t4.host = a.host AND t4.path = a.path JOIN j ON j.host = t4.host AND j.t = t4.t""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS k
  FROM benchmark
),
g AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, k, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS k FROM d) WHERE k IN (SELECT k FROM q) GROUP BY doc_id, n, k),
f AS (SELECT k, count(*) AS df FROM p GROUP BY k),
s AS (
  SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * g.N + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * g.N) // g.L)))) AS BIGINT) AS score
  FROM q JOIN p USING (k) JOIN f USING (k), g GROUP BY item_id, doc_id
),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 10""",
}
