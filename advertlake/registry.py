"""Registry of the engine's queries: name -> callable, and the oracle SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from advertlake.plans import advert_text, book, changes, checks, curves, delivery, freetext, market, pages, reads, relational, sitemaps, streams, texts, twins

_PLANS = [market, relational, book, streams, delivery, curves, advert_text, reads, changes, texts, twins, checks, freetext, pages, sitemaps]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _PLANS for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _PLANS for k, q in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["DM_market_median"](spark, sf_dir)
