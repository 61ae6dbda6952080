"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.llm import (
    embedding_dedup,
    filter_audit,
    hard_negatives,
    near_dedup,
    nearest_neighbours,
    piece_sampling,
    pipeline,
    quality_classifier,
    secret_scan,
    sharding,
    source_mixing,
    substring_dedup,
    token_counts,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixing_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.neighbours(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return got.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_source_mixing": op3_source_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_near_dedup": op8_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline.run,
}


def _ref_sql(col: str) -> str:
    return rf"regexp_replace(regexp_replace(trim({col}), '(?i)&(amp|#38|#x26);', '&', 'g'), '(?s)#.*$', '')"


def _resolved_sql(base: str) -> str:
    """The absolute URL of the column ref on the page `base`."""
    origin, path = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    own, query = "regexp_extract(ref, '(?s)^([^?]*)', 1)", "regexp_extract(ref, '(?s)^[^?]*(.*)$', 1)"
    whole = rf"regexp_replace(CASE WHEN starts_with({own}, '/') THEN {own} ELSE '/' || regexp_extract({path}, '(?s)^/(.*/)', 1) || {own} END, '(/\.\.?)$', '\1/')"
    plain = f"""array_to_string(list_reduce(list_transform(string_split({whole}, '/'), lambda s: [s]), lambda a, x:
      CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE a || x END), '/')"""
    return f"""CASE WHEN regexp_matches(ref, '(?i)^[a-z][a-z0-9+.-]*://') THEN ref WHEN {origin} = '' THEN NULL WHEN starts_with(ref, '//') THEN 'http:' || ref
      WHEN {own} = '' THEN {origin} || {path} || CASE WHEN {query} = '' THEN regexp_extract({base}, '(?s)^[^?#]*(\\?[^#]*)', 1) ELSE {query} END
      ELSE {origin} || {plain} || {query} END"""


#: DuckDB SQL over the same tables. The other queries learn, sample or search: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
pos AS (
  SELECT a.vec_id AS a, p.vec_id AS p, list_inner_product(a.q, p.q)::BIGINT AS ps FROM v a JOIN v p ON a.label = p.label AND a.vec_id <> p.vec_id
  WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY ps DESC, p.vec_id) <= 5),
neg AS (SELECT a.vec_id AS a, n.vec_id AS n, list_inner_product(a.q, n.q)::BIGINT AS ns FROM v a JOIN v n ON a.label <> n.label WHERE a.vec_id % 50 = 0)
SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY ns DESC, n)::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM pos JOIN neg USING (a) WHERE 50 * ps <= 100 * ns AND 100 * ns <= 95 * ps
QUALIFY rank <= 3
""",
    "op11_filter_audit": r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e FROM doc d LEFT JOIN lab l USING (doc_id)),
sets AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END ||
    CASE WHEN e THEN 'E' ELSE '' END AS bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM f p, f q, f r, f s, f t
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM orders, range(1, 6) r(step)),
-- the filter that removes a set of failures is the first of the order in it
met AS (
  SELECT z.part, s.o, s.step, s.x,
    sum(n) FILTER (contains(bad, s.x) AND regexp_extract(s.before, '[' || bad || ']') = '')::BIGINT AS removed,
    sum(n) FILTER (regexp_extract(s.before || s.x, '[' || bad || ']') = '')::BIGINT AS kept,
    sum(n) FILTER (contains(bad, s.x) AND regexp_extract(s.before, '[' || bad || ']') <> '')::BIGINT AS redundant,
    sum(n) FILTER (bad = s.x)::BIGINT AS unique_fails,
    sum(good) FILTER (contains(bad, s.x) AND regexp_extract(s.before, '[' || bad || ']') = '')::BIGINT AS good_lost,
    sum(toxic) FILTER (contains(bad, s.x) AND regexp_extract(s.before, '[' || bad || ']') = '')::BIGINT AS toxic_lost
  FROM (SELECT part, CASE WHEN bad = '' THEN '0' ELSE bad END AS bad, n, good, toxic FROM sets) z, steps s GROUP BY z.part, s.o, s.step, s.x),
fair AS (SELECT part, x, sum(removed)::BIGINT AS shapley FROM met GROUP BY part, x)
SELECT m.part, m.o AS filter_order, m.step::INTEGER AS step, coalesce(m.kept, 0) AS kept, coalesce(m.removed, 0) AS removed, coalesce(m.redundant, 0) AS redundant,
  coalesce(m.unique_fails, 0) AS unique_fails, coalesce(m.good_lost, 0) AS good_lost, coalesce(m.toxic_lost, 0) AS toxic_lost, coalesce(g.shapley, 0) AS shapley
FROM met m JOIN fair g USING (part, x)
""",
    "op3_source_mixing": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM doc GROUP BY source),
fill(n, level) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM per
  UNION ALL
  SELECT n + 1, next FROM (
    SELECT f.n, f.level, max(1.5::DOUBLE * t.total::DOUBLE - s.capped) / nullif(max(s.free), 0) AS next
    FROM fill f, (SELECT sum(source_size) AS total FROM per) t,
    LATERAL (SELECT coalesce(sum(CASE WHEN p.weight * f.level > 2 * p.source_size THEN 2 * p.source_size END), 0)::DOUBLE AS capped,
                    coalesce(sum(CASE WHEN NOT p.weight * f.level > 2 * p.source_size THEN p.weight END), 0)::DOUBLE AS free FROM per p) s
    GROUP BY f.n, f.level) WHERE next > level),
top AS (SELECT max(level) AS level FROM fill),
goal AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target,
         CASE WHEN source_size > 0 THEN least(2.0::DOUBLE * source_size, weight * level) / source_size ELSE 0.0::DOUBLE END AS rate
  FROM per, top)
SELECT d.doc_id, d.size, g.source_size, g.target,
  (d.size * (floor(g.rate) + CASE WHEN (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.mark), 1, 13))::BIGINT)::DOUBLE
     / 4503599627370496.0::DOUBLE < g.rate - floor(g.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM doc d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
""",
    "op4_url_filter": r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tag AS (SELECT url, regexp_extract(html, '(?is)<base\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS base,
          unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM page
        WHERE contains(lower(html), 'canonical') OR contains(lower(html), 'refresh')),
aim AS (
  SELECT url, base, CASE WHEN regexp_matches(tag, '(?is)^<link') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                   ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS t
  FROM tag WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') OR regexp_matches(tag, '(?is)http-equiv\s*=\s*["'']?refresh\b')),
based AS (SELECT url, t, {base} AS base FROM (SELECT url, t, base AS href, {base_ref} AS ref FROM aim WHERE t <> '')),
link AS (SELECT url, {target} AS target FROM (SELECT url, base, {target_ref} AS ref FROM based)),
good AS (SELECT * FROM link WHERE regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1) <> ''),
named AS (SELECT url AS u FROM good UNION SELECT target FROM good UNION SELECT url FROM page WHERE url IS NOT NULL),
node AS (
  SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM named),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ruled AS (
  SELECT n.u, n.host || CASE WHEN starts_with(n.rest, '/') THEN n.rest ELSE '/' || n.rest END AS id,
         arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM node n LEFT JOIN rules r ON (n.host = r.h OR n.host LIKE '%.' || r.h) AND starts_with(n.path, r.p) WHERE n.host <> '' GROUP BY ALL),
edge AS (
  SELECT a.id AS x, b.id AS y FROM good l JOIN ruled a ON a.u = l.url JOIN ruled b ON b.u = l.target
  UNION SELECT b.id, a.id FROM good l JOIN ruled a ON a.u = l.url JOIN ruled b ON b.u = l.target),
reach(x, y) AS (SELECT x, x FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x),
alias AS (
  SELECT r.x, bool_or(u.verdict = 'block') AS blocked, bool_or(u.verdict = 'allow') AS allowed FROM reach r JOIN ruled u ON u.id = r.y GROUP BY r.x)
SELECT p.page_id, p.host, p.path, u.rule,
  coalesce(u.verdict, CASE WHEN a.blocked AND NOT coalesce(a.allowed, false) THEN 'block' END, 'allow') AS verdict
FROM page p LEFT JOIN ruled u ON u.u = p.url LEFT JOIN alias a ON a.x = u.id
""".replace("{base_ref}", _ref_sql("base")).replace("{base}", "CASE WHEN href = '' THEN url ELSE " + _resolved_sql("url") + " END")
    .replace("{target_ref}", _ref_sql("t")).replace("{target}", _resolved_sql("base")),
}
