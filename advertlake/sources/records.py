"""The record tables of the engine (sources, listings, evaluations, alerts, feedback, history, subscribers, state), made from the driver's tables.

Each table is one SELECT that reads the same in Spark and in the oracle: {name} stands for a driver's table, and {{hours:column,n}}, {{days:column,n}}
and {{list:a,b}} for what the two dialects write differently.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.session import table

NOW = dt.datetime(2001, 6, 1)
_NOW = f"CAST('{NOW}' AS TIMESTAMP)"

TABLES = {
    "sources": f"""
SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 1 THEN 'facebook' WHEN 2 THEN 'instagram' ELSE 'web' END AS platform,
  CASE s_nationkey % 5 WHEN 1 THEN 'deneme' WHEN 2 THEN 'aday' WHEN 3 THEN 'pasif' ELSE 'aktif' END AS status,
  CASE WHEN s_suppkey % 5 = 3 THEN 'sari' WHEN s_suppkey % 5 = 4 THEN 'golge' ELSE 'yesil' END AS alert_level, s_nationkey AS priority,
  concat('https://www.site', CAST(s_suppkey AS STRING), '.example/', CASE WHEN s_suppkey % 2 = 1 THEN 'groups/' ELSE 'list/' END, s_name, '/') AS url,
  CASE WHEN s_suppkey % 11 <> 10 THEN [[hours:{_NOW},-(s_suppkey * 7 % 400)]] END AS last_checked_at, [[days:{_NOW},-(s_suppkey % 100)]] AS created_at,
  CAST(s_suppkey % 30 AS INT) AS listings_7d, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS cursor
FROM {{supplier}}""",
    "listings": """
SELECT o_orderkey AS id, o_orderkey % 10 AS source_id, concat(CAST(o_orderkey * 7 % 90001 AS STRING), '-x') AS item_id,
  concat('https://', CASE WHEN o_orderkey % 2 = 0 THEN 'www.' ELSE 'm.' END, 'site', CAST(o_orderkey % 10 AS STRING), '.example/ad/', CAST(o_orderkey AS STRING), '/?q=1') AS url,
  concat('Brand#', CAST(o_custkey % 7 AS STRING)) AS brand_norm, CASE WHEN o_custkey % 29 <> 0 THEN concat('M', CAST(o_custkey % 5 AS STRING)) END AS model_norm,
  CAST(CASE WHEN o_custkey % 37 <> 0 THEN 1990 + o_custkey % 11 END AS INT) AS year, CAST(CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey * 37 % 250000 END AS INT) AS km,
  CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice / 50 END AS price_gbp, o_totalprice AS price_amount,
  CASE o_orderkey % 4 WHEN 0 THEN 'TRY' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE WHEN o_custkey % 4 <> 0 THEN concat('9053', lpad(CAST(o_custkey AS STRING), 8, '0')) END AS seller_phone,
  CASE WHEN o_custkey % 3 = 0 THEN concat('site:', CAST(o_custkey AS STRING)) WHEN o_custkey % 3 = 1 THEN 'someone' END AS seller_handle,
  o_orderstatus <> 'F' AS is_active, o_orderdate AS first_seen_at, CASE WHEN o_orderkey % 5 <> 0 THEN [[days:o_orderdate,-(o_orderkey % 6)]] END AS posted_at,
  [[days:o_orderdate,o_orderkey % 90]] AS last_seen_at, CASE WHEN o_orderstatus = 'F' THEN [[days:o_orderdate,20]] END AS inactive_at,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'satildi' WHEN 1 THEN 'kaldirildi' ELSE 'belirsiz' END END AS inactive_reason,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN [[days:o_orderdate,15]] END AS sold_at,
  CASE WHEN o_orderkey % 9 = 4 THEN o_orderkey - 4 END AS duplicate_of,
  CASE o_orderkey % 8 WHEN 0 THEN [[list:'fiyatsiz']] WHEN 1 THEN [[list:'foto_fiyat','acil']] WHEN 2 THEN [[list:'satildi']] END AS signals,
  CASE WHEN o_orderkey % 31 = 0 THEN 'tek' END AS quarantine, CASE o_orderkey % 3 WHEN 0 THEN 'otomatik' WHEN 1 THEN 'manuel' END AS transmission, o_orderpriority AS location
FROM {orders}""",
    "evaluations": """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS id, l_orderkey AS listing_id, l_shipdate AS evaluated_at,
  CASE WHEN l_discount > 0.085 THEN 'yok' WHEN l_returnflag = 'R' THEN 'guclu' WHEN l_returnflag = 'A' THEN 'pazarlik' ELSE 'tahmini' END AS tier,
  CAST(l_quantity AS INT) AS comparables_n, l_extendedprice / 50 AS median_gbp, l_extendedprice / 50 - l_partkey AS profit_gbp, l_discount * 3 AS profit_pct,
  concat('v', CAST(l_suppkey % 3 AS STRING)) AS rules_version, CASE l_partkey % 4 WHEN 0 THEN 'yuksek' WHEN 1 THEN 'orta' WHEN 2 THEN 'dusuk' ELSE 'yok' END AS confidence,
  CASE WHEN l_partkey % 5 = 0 THEN [[list:'yazim']] WHEN l_partkey % 5 = 1 THEN [[list:'km','yil']] END AS reasons, CASE WHEN l_partkey % 2 = 0 THEN 'B' END AS method
FROM {lineitem}""",
    "alerts": """
SELECT l_orderkey AS listing_id, concat('c', CAST(l_suppkey % 3 AS STRING)) AS chat_id,
  CASE l_partkey % 4 WHEN 0 THEN 'guclu' WHEN 1 THEN 'tahmini' WHEN 2 THEN 'pazarlik' ELSE 'acil' END AS tier, [[hours:l_shipdate,l_partkey % 50]] AS sent_at,
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS evaluation_id,
  l_extendedprice / 50 AS price_sent, CASE WHEN l_partkey % 17 = 0 THEN 'geri_cekildi' WHEN l_partkey % 17 = 1 THEN 'teyit' END AS kind
FROM {lineitem} WHERE l_linenumber <= 2""",
    "feedback": f"""
SELECT event_id AS id, event_id AS listing_id, CASE event_type WHEN 'purchase' THEN 'ilgilendim' WHEN 'click' THEN 'yanlis_fiyat' WHEN 'error' THEN 'kusurlu' WHEN 'view' THEN 'pas'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'audit_yanlis' ELSE 'audit_dogru' END END AS action,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('chat:c', CAST(user_id % 4 AS STRING)) END AS note, [[hours:{_NOW},-(event_id * 13 % 2000)]] AS created_at
FROM {{events}}""",
    "history": """
SELECT l_orderkey AS listing_id, CASE l_linenumber WHEN 5 THEN 'km' WHEN 7 THEN 'km_deneme' ELSE 'price_gbp' END AS field, CAST(CAST(l_quantity AS INT) AS STRING) AS old_value,
  CAST(CAST(l_quantity + 1 AS INT) AS STRING) AS new_value, [[hours:l_shipdate,l_partkey % 24]] AS changed_at
FROM {lineitem} WHERE l_linenumber >= 4""",
    "subscribers": """
SELECT concat('c', CAST(n_nationkey AS STRING)) AS chat_id, n_nationkey = 0 AS is_owner, CASE n_nationkey WHEN 2 THEN 'reddedildi' WHEN 3 THEN 'bekliyor' ELSE 'onayli' END AS status
FROM {nation} WHERE n_nationkey < 5""",
    "state": f"""
SELECT CASE c_custkey % 3 WHEN 0 THEN concat('alert:est:', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('sent:unsaved:', CAST(c_custkey AS STRING), ':c1')
    ELSE concat('cfg:', CAST(c_custkey AS STRING)) END AS key,
  CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN CAST([[hours:{_NOW},-(c_custkey % 300)]] AS STRING) ELSE CAST(c_custkey AS STRING) END AS value
FROM {{customer}}""",
}
_MARK = re.compile(r"\[\[(hours|days|list):([^\]]*)\]\]")


def _dialect(text: str, spark: bool) -> str:
    def one(m: re.Match) -> str:
        kind, body = m.groups()
        if kind == "list":
            return f"array({body})" if spark else f"[{body}]"
        column, n = body.split(",", 1)
        return f"timestampadd({kind[:-1].upper()}, {n}, {column})" if spark else f"({column} + to_{kind}(CAST({n} AS INT)))"

    return _MARK.sub(one, text)


def records_sql(*names: str) -> str:
    """The tables as common table expressions for the oracle."""
    return ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', _dialect(TABLES[n], False))})" for n in names or TABLES)


@dataclasses.dataclass(frozen=True)
class Records:
    """The record tables, and the instant that counts as now."""

    sources: DataFrame
    listings: DataFrame
    evaluations: DataFrame
    alerts: DataFrame
    feedback: DataFrame
    history: DataFrame
    subscribers: DataFrame
    state: DataFrame
    now: dt.datetime = NOW


def instants(df: DataFrame) -> DataFrame:
    """df with its local timestamps as instants (the session's zone is UTC)."""
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def records(spark: SparkSession, sf_dir: str) -> Records:
    def built(text: str) -> DataFrame:
        used = {n: instants(table(spark, sf_dir, n)) for n in set(re.findall(r"{(\w+)}", text))}
        return spark.sql(_dialect(text, True), **used)

    return Records(**{n: built(t) for n, t in TABLES.items()})
