"""URL filters with redirect equivalence.

A page's own rule decides. Pages without one get the decision of their alias group, which distributed connected components find over
redirect (meta refresh) and canonical-link edges: block if a URL of the group is blocked by a rule and none is explicitly allowed, else
allow. Targets are resolved against the page's url or its <base href>: relative paths, dot segments, //host, ?query, and &amp; for &.

Rules are a table (verdict, host, path), joined by the suffixes of the distinct hosts, so a long list costs no more per page than a short one.

A null url or one without :// has an empty host and path and takes no part in groups, a null html has no edges, pages that
repeat a url share its decision, an empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import connected_components, spread_join, written

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a graph node: host, path and query, without scheme and fragment; null if there is no host. An empty path is /."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.xxhash64(host_of(url), rest))


def resolved(base: Column, ref: Column) -> Column:
    """The absolute URL that `ref`, as written in html, means on the page `base`; null without a host in either."""
    ref = F.regexp_replace(F.trim(ref), r"(?i)&(amp|#38|#x26);", "&")
    ref = F.regexp_replace(ref, r"(?s)#.*$", "")
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, query = F.regexp_extract(ref, r"(?s)^([^?]*)", 1), F.regexp_extract(ref, r"(?s)^[^?]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)", 1))
    whole = F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), r"(?s)(/\.\.?)$", "$1/")

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.substring(whole, 2, 1 << 30), "/", -1)
    plain = F.array_join(F.aggregate(parts, F.array(F.lit("")), step), "/")
    found = (
        F.when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), ref)
        .when(origin == "", None)
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
        .when(path == "", F.concat(origin, path_of(base), F.when(query == "", F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)).otherwise(query)))
        .otherwise(F.concat(origin, plain, query))
    )
    return F.when(host_of(found) != "", found)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical link and the meta refresh of each page."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    kept = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"))
    hint = F.lower(F.col("html")).contains("canonical") | F.lower(F.col("html")).contains("refresh")
    base = F.regexp_extract("html", r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    t = pages.filter(hint).select("url", F.when(base == "", F.col("url")).otherwise(resolved(F.col("url"), base)).alias("base"), F.explode(kept).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    go = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    t = t.withColumn("to", F.when(F.col("tag").rlike(r"(?is)^<link"), href).otherwise(go)).filter("to <> ''")
    return t.select("url", resolved(F.col("base"), F.col("to")).alias("target")).filter("target is not null")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each of the distinct hosts and the domains above it, for hosts that have any."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = hosts.filter("host <> ''").distinct().select("host", F.explode(above).alias("domain"))
    own = rules.select(F.col("host").alias("domain"), F.struct(F.length(F.concat("host", "path")).alias("n"), (F.col("verdict") == "allow").alias("allow"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    return named.join(own, "domain").groupBy("host").agg(F.collect_list("r").alias("rules"))


def best_rule(rules: Column, path: Column) -> Column:
    """The struct of the longest rule whose path starts the given one, allow first among equals; null if none fits."""
    return F.array_max(F.filter(rules, lambda r: path.startswith(r["path"])))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (host and path of the rule that fits, else null) and verdict. rules: (verdict, host, path), a DataFrame
    with these columns or a sequence."""
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    p = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    edges = written(alias_edges(p))
    ends = written(edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).filter("a is not null"))
    group = written(connected_components(ends))
    named = edges.select(F.explode(F.array("url", "target")).alias("u")).select(node_of(F.col("u")).alias("node"), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    named = named.distinct()
    own = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    known = host_rules(own.select("host").unionByName(named.select("host")), rules)
    known = written(known)
    ruled = spread_join(named, known, "host").select("node", best_rule(F.col("rules"), F.col("path")).alias("r")).filter("r is not null")
    verdicts = (
        ruled.join(group, "node")
        .groupBy("component")
        .agg(F.max(F.col("r.verdict") == "block").alias("blocked"), F.max(F.col("r.verdict") == "allow").alias("allowed"))
        .filter("blocked and not allowed")
    )
    alias = group.join(verdicts, "component").select("node", F.lit("block").alias("alias_verdict"))
    out = spread_join(own, known, "host").select("page_id", "host", "path", best_rule(F.col("rules"), F.col("path")).alias("r"), "node")
    out = spread_join(out, alias, "node")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
