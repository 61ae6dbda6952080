"""Decisions about adverts: profit, data gaps and tier from their market, with the strong checks as a second plan over the few strong rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.functions.rules import NEGOTIABLE, STRONG, buy_ceiling, confidence, profit, tier
from advertlake.operators.market import find_market
from advertlake.settings import Settings
from advertlake.sources.shared import persisted


def work_list(pool: DataFrame, s: Settings) -> DataFrame:
    """Active priced adverts first seen within recent_days before the instant of the settings."""
    age = F.datediff(F.lit(s.as_of), F.col("first_seen_at"))
    return pool.filter(F.col("is_active") & F.col("price_gbp").isNotNull() & age.between(0, s.recent_days))


def assess(market: DataFrame, s: Settings) -> DataFrame:
    """Profit, confidence, gaps and tier of each target that has a market; any gap turns a strong tier into a negotiable one."""
    price, median = F.col("t_price_gbp"), F.col("median")
    raw = tier(price, median, F.col("n"), s)
    strong = raw == STRONG
    skew = F.col("median_year") - F.col("t_year")
    wide = F.col("step") >= 3

    def gap(when: Column, code: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), code)

    gaps = F.array_compact(
        F.array(
            gap(F.col("t_currency") == "TRY", "tl_fiyat"),
            gap(F.col("t_model").isNull(), "model_yok"),
            gap(F.col("near_n") < s.km_near_min, "km_yakin_emsal_az"),
            gap(strong & (price > F.col("p25")), "ucuz_ceyrek_degil"),
            gap(strong & ((skew >= 1) | (wide & (skew > 0))), "emsal_yili_yeni"),
            gap(strong & (F.col("z") > s.strong_max_z), "fiyat_gurultu"),
        )
    )
    d = market.withColumn("profit", profit(price, median, s)).withColumn("raw_tier", raw).withColumn("gaps", gaps)
    lowered = (F.col("raw_tier") == STRONG) & (F.size("gaps") > 0)
    return d.withColumns(
        {
            "profit_pct": F.col("profit") / price,
            "confidence": confidence(F.col("n")),
            "tier": F.when(lowered, NEGOTIABLE).otherwise(F.col("raw_tier")),
            "gaps": F.when(lowered, F.col("gaps")).otherwise(F.array().cast("array<string>")),
        }
    )


def decide(targets: DataFrame, pool: DataFrame, s: Settings, market: DataFrame | None = None) -> DataFrame:
    """assess(), then the cautious-mileage check: a strong target of unknown mileage and some age is judged again as if it had the market's median
    mileage plus unknown_km_extra, and is lowered with the gap km_temkinli unless it stays strong. Then a plain market, without z gate. market: the targets'
    markets, where they are already written."""
    first = persisted(assess(find_market(targets, pool, s), s)) if market is None else assess(market, s)
    doubt = (F.col("tier") == STRONG) & F.col("t_km").isNull() & (s.as_of.year - F.col("t_year") >= s.unknown_km_min_age) & (F.col("median_km") > 0)
    assumed = first.filter(doubt).select(F.col("t_id").alias("d_id"), (F.col("median_km") + s.unknown_km_extra).alias("d_km"))
    again = targets.join(assumed, F.col("id") == F.col("d_id")).withColumn("km", F.col("d_km")).drop("d_id", "d_km")
    second = assess(find_market(again, pool, s), s.but(strong_max_z=float("inf"))).filter(F.col("tier") == STRONG)
    stay = second.select(F.col("t_id").alias("s_id"))
    out = first.join(stay, F.col("t_id") == F.col("s_id"), "left")
    lower = doubt & F.col("s_id").isNull()
    return out.withColumns(
        {"tier": F.when(lower, NEGOTIABLE).otherwise(F.col("tier")), "gaps": F.when(lower, F.array(F.lit("km_temkinli"))).otherwise(F.col("gaps"))}
    ).drop("s_id")


def send_floor(tier: Column, n: Column, method: Column, s: Settings) -> Column:
    """Strong adverts are sent with enough direct comparables only, estimated ones never; other tiers are not held back here."""
    return F.when(tier == STRONG, (method == "A") & (n >= s.rich_comparables)).otherwise(tier != "tahmini")


def clean_negotiable(targets: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """Targets that pass every gate of a strong one at the lower share and profit of a clean negotiable one."""
    d = decide(targets, pool, s.but(strong_threshold=s.clean_threshold, min_strong_profit=s.clean_min_profit))
    return d.filter((F.col("tier") == STRONG) & send_floor(F.col("tier"), F.col("n"), F.lit("A"), s))


def cheap_to_verify(targets: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """Targets that are not strong, and would be if their price were believed: without the noise gate and the cautious mileage, and with a lower
    absurd share."""
    market = persisted(find_market(targets, pool, s))  # the gates that are loosened decide on a market, and have no part in it
    strict = decide(targets, pool, s, market).filter(F.col("tier") == STRONG).select("t_id")
    loose = assess(market, s.but(strong_max_z=float("inf"), absurd_price_ratio=min(s.absurd_price_ratio, s.verify_min_ratio)))
    return loose.filter((F.col("tier") == STRONG) & send_floor(F.col("tier"), F.col("n"), F.lit("A"), s)).join(strict, "t_id", "left_anti")


def ask_value(targets: DataFrame, pool: DataFrame, s: Settings, step: int = 50) -> DataFrame:
    """What a target is worth to a buyer who does not know its price: the market's median, its rows, and the highest price that still pays,
    rounded down to the step; rows with enough comparables and a positive price."""
    got = find_market(targets, pool, s).filter(F.col("n") >= s.rich_comparables)
    return got.select("t_id", "median", "n", (F.floor(buy_ceiling(F.col("median"), s) / step) * step).alias("max_buy")).filter("max_buy > 0")


def worth_sharing(price: Column, median: Column, s: Settings, most_cut: float, step: int = 50) -> Column:
    """Whether the price has to come down by no more than a share of itself to reach the ceiling."""
    ceiling = F.floor(buy_ceiling(median, s) / step) * step
    return price - ceiling <= price * most_cut
