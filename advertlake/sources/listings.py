"""The advert table that the operators run over, made from the driver's order lines, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.session import table


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line. The line's four keys make the id; unknown values are null as in real adverts."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("p_brand").alias("brand_norm"),
        F.col("p_type").alias("model_norm"),
        (1990 + F.col("p_size") % 10).alias("year"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 4000).cast("int").alias("km"),
        F.col("l_extendedprice").alias("price_gbp"),
        F.when(F.col("l_returnflag") == "R", "TRY").when(F.col("l_returnflag") == "A", "GBP").otherwise("USD").alias("currency"),
        F.col("l_suppkey").alias("seller"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0)).alias("is_sold"),
        F.when(F.col("l_tax") < 0.015, None).when(F.col("l_tax") < 0.065, "RHD").otherwise("LHD").alias("steering"),
        F.when(F.col("l_discount") < 0.025, None).when(F.col("l_discount") < 0.085, "automatic").otherwise("manual").alias("transmission"),
        F.when(F.col("l_suppkey") % 5 != 0, (10 + F.col("l_partkey") % 8) / 10).alias("engine_l"),
        F.col("l_shipdate").alias("first_seen_at"),
        F.col("l_orderkey").alias("order_id"),
    )


LISTINGS_SQL = """
listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, p_brand AS brand_norm, p_type AS model_norm,
    1990 + p_size % 10 AS year, CASE WHEN l_linenumber <> 7 THEN (l_quantity * 4000)::INTEGER END AS km, l_extendedprice AS price_gbp,
    CASE l_returnflag WHEN 'R' THEN 'TRY' WHEN 'A' THEN 'GBP' ELSE 'USD' END AS currency, l_suppkey AS seller,
    l_linestatus = 'O' AS is_active, l_linestatus = 'F' AND l_linenumber % 2 = 0 AS is_sold,
    CASE WHEN l_tax < 0.015 THEN NULL WHEN l_tax < 0.065 THEN 'RHD' ELSE 'LHD' END AS steering,
    CASE WHEN l_discount < 0.025 THEN NULL WHEN l_discount < 0.085 THEN 'automatic' ELSE 'manual' END AS transmission,
    CASE WHEN l_suppkey % 5 <> 0 THEN (10 + l_partkey % 8) / 10.0::DOUBLE END AS engine_l,
    l_shipdate AS first_seen_at, l_orderkey AS order_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
