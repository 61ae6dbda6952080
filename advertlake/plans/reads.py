"""Queries of the reads over the record tables, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from advertlake.operators import reads as R
from advertlake.sources.records import NOW, records, records_sql

_SINCE = NOW - dt.timedelta(days=400)


def _us(*names: str):
    return [F.unix_micros(n).alias(n) for n in names]


def _query(build):
    return lambda spark, d: build(records(spark, d))


def _urgent(r):
    """Adverts that count as handled by the urgent path."""
    return r.listings.filter("id % 5 = 0").select("id")


def _links(r):
    """Addresses as users paste them: another prefix, a query and a fragment."""
    k = F.col("id")
    link = F.concat(F.lit("http://web.site"), (k % 10).cast("string"), F.lit(".example/ad/"), F.when(k % 3 == 0, k + 1000000).otherwise(k).cast("string"), F.lit("/#top"))
    return r.listings.filter("id % 4 = 1").select(link.alias("link"), "item_id").distinct()


def _asked(r):
    return r.listings.filter("id % 2 = 0").select("id", F.explode(F.array(*[F.lit(f"c{k}") for k in range(5)])).alias("chat_id"))


QUERIES = {
    "SC01_sources": _query(lambda r: R.sources_of(r, "web", ["aktif", "deneme"]).select("id", "name", "priority")),
    "SC02_known_item_ids": _query(lambda r: R.known_items(r)),
    "SC07_SF11_for_quality": _query(lambda r: R.for_quality(r, 400)),
    "SC08_first_seen_since": _query(lambda r: R.first_seen_since(r, 300).select("id", "source_name", "platform", "price_gbp")),
    "SC10_SL_by_phone": _query(lambda r: R.of_phones(r, r.listings.filter("id % 50 = 0").select("seller_phone").distinct()).select("id", "seller_phone", "rank")),
    "SC11_SL03_by_link": _query(lambda r: R.by_link(r, _links(r))),
    "SC12_stale_active": _query(lambda r: R.stale_active(r, 24 * 30, 40).select("source_id", "id", "rank")),
    "SC13_SF15_stale_archived": _query(lambda r: R.stale_archived(r, 900, 24, 40).select("source_id", "id", "rank")),
    "SC14_km_backfill": _query(lambda r: R.km_backfill(r, 1500).select("source_id", "id", "rank")),
    "SC15_SF16_SF19_priceless": _query(lambda r: R.priceless_recent(r, 24 * 900).select("id", "source_name")),
    "SC16_priced_recent": _query(lambda r: R.priced_recent(r, 900).select("source_id", "id", "rank")),
    "SC05_JN16_new_in_group": _query(lambda r: R.new_in_group(r, 24 * 20).select("id", "brand_norm", "model_norm", "year")),
    "SC06_twin_candidates": _query(lambda r: R.twin_candidates(_cents(r), 24 * 400, ("site1.example", "site2.example"), 3000).select("id", "site")),
    "SL08_recent_opportunities": _query(lambda r: R.recent_opportunities(r, F.lit(_SINCE), 200).select("listing_id", "tier", "price_gbp", "e_median_gbp", "feedback", *_us("sent_at"))),
    "SL09_WN03_JN05_current_decisions": _query(lambda r: R.current_decisions(r).select("id", "rank", "total", "e_tier", "method")),
    "SL11_pending_negotiable": _query(lambda r: R.pending_negotiable(r, "c1", 24 * 900).select("id", "e_profit_pct", *_us("price_changed_at"))),
    "SL13_JN11_JN21_SF28_unnotified_strong": _query(lambda r: R.unnotified_strong(r, "v1", 1500).select("id", "e_profit_pct", *_us("price_changed_at"))),
    "SL14_near_misses": _query(lambda r: R.near_misses(r, "v1", 1500, 8, ("yazim",)).select("id", "e_profit_pct", "e_comparables_n")),
    "SL15_JN10_alerted_votes": _query(lambda r: R.alerted_votes(r, 900, F.lit(_SINCE)).select("id", "tier", "median_gbp", "voted", *_us("sent_at"))),
    "SL16_ST02_WN11_WN17_vote_queue": _query(lambda r: R.vote_queue(r, "c1", F.lit(_SINCE), _urgent(r)).select("listing_id", "tier", "canon", "price_sent", "median_gbp")),
    "SL17_SF06_twins": _query(lambda r: R.twins(r, 30).select("id", "t_id", "rank", "linked", *_us("alerted_at"))),
    "SL18_urgent_sent": _query(lambda r: R.urgent_sent(r, _urgent(r), 600).select("id", "price_gbp", *_us("sent_at"))),
    "SL19_SF25_resurfaced": _query(lambda r: R.resurfaced(r, "site5.example").select("id", "before")),
    "SL20_alarm_sources": _query(lambda r: R.alarm_sources(r).select("id", F.round("hours_since_check", 6).alias("hours"))),
    "SL21_stale_sources": _query(lambda r: R.stale_sources(r, ["site0.example", "site3.example", "site4.example"]).select("id", F.round("hours_since_check", 6).alias("hours"))),
    "SL22_price_history": _query(lambda r: R.price_history(r).select("listing_id", "step", "old_value", "new_value", *_us("changed_at"))),
    "SL23_scanned_sites": _query(lambda r: R.scanned_sites(r).select("host", "name", *_us("last_checked_at"))),
    "AG03_recent_counts": _query(lambda r: R.recent_counts(r, 60)),
    "AG05_pass_counts": _query(lambda r: R.pass_counts(r, 60)),
    "AG06_seller_counts": _query(lambda r: R.seller_counts(r)),
    "AG07_social_similar": _query(lambda r: R.social_similar(r, 600)),
    "AG08_alerts_sent": _query(lambda r: R.alerts_sent(r, 24 * 300)),
    "AG09_vote_count": _query(lambda r: R.vote_count(r)),
    "AG14_week_alerts": _query(lambda r: R.week_alerts(r, 300, F.lit(_SINCE))),
    "AG15_week_feedback": _query(lambda r: R.week_feedback(r, 40)),
    "JN02_canonical_counts": _query(lambda r: R.canonical_counts(r)),
    "JN06_AG42_tier_status": _query(lambda r: R.tier_status(r)),
    "DL15_SF29_marks_since": _query(lambda r: R.marks_since(r, "est:", 5)),
    "DL16_source_names": _query(lambda r: R.names_of(r, r.listings.filter("id % 40 = 0").select(F.col("source_id").cast("string").alias("source_key")).distinct())),
    "DL17_state_with_prefix": _query(lambda r: R.state_with_prefix(r, "cfg:")),
    "DL18_source_handles": _query(lambda r: R.source_handles(r, "instagram")),
    "DL20_alert_recent": _query(lambda r: R.recently_alerted(r, 100)),
    "DL23_approved": _query(lambda r: R.approved(r)),
    "DL24_DL27_DL28_DL29_alert_exists": _query(lambda r: R.alert_exists(r, _asked(r), "guclu")),
    "DL24_alert_exists_negotiable": _query(lambda r: R.alert_exists(r, _asked(r), "pazarlik")),
}


def _cents(r):
    """Amounts rounded so far that the two sites share some."""
    import dataclasses

    return dataclasses.replace(r, listings=r.listings.withColumn("price_amount", F.round(F.col("price_amount") / 100000) * 100000))


_AT = f"TIMESTAMP '{NOW}'"
_OWNER = "NOT EXISTS (SELECT 1 FROM subscribers v WHERE NOT v.is_owner AND f.note = 'chat:' || v.chat_id)"
_LAST = "(SELECT * FROM evaluations QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY evaluated_at DESC, id DESC) = 1)"
_HOST = "regexp_replace(lower(split_part(split_part({0}, '://', 2), '/', 1)), '^(www|m|web|mobile)\\.', '')"
_CANON = "rtrim(regexp_replace(split_part(split_part({0}, '#', 1), '?', 1), '^https?://(www\\.|m\\.|web\\.|mobile\\.)?', ''), '/')"
_REVIEWED = f"tier IN ('guclu', 'tahmini', 'pazarlik', 'acil') AND (tier <> 'pazarlik' OR sent_at >= TIMESTAMP '{_SINCE}')"
_ORDER = "list_position(['guclu', 'tahmini', 'pazarlik', 'acil'], tier)"
_PLAIN = "l.is_active AND l.duplicate_of IS NULL AND l.quarantine IS NULL"
_CHANGED = "(SELECT max(changed_at) FROM history h WHERE h.listing_id = l.id AND h.field = 'price_gbp')"
_ALERTED = "EXISTS (SELECT 1 FROM alerts a JOIN listings d ON d.id = a.listing_id WHERE (d.id = l.id OR d.duplicate_of = l.id) AND a.tier IN ({0}){1})"


def _days(n: int) -> str:
    return f"{_AT} - INTERVAL {n} DAY"


def _ranked(where: str, order: str, limit: int, cols: str = "source_id, id", by: str = "source_id") -> str:
    return f"SELECT {cols}, row_number() OVER (PARTITION BY {by} ORDER BY {order}, id)::INTEGER AS rank FROM listings l WHERE {where} QUALIFY rank <= {limit}"


_SQL = {
    "SC01_sources": "SELECT id, name, priority FROM sources WHERE platform = 'web' AND status IN ('aktif', 'deneme')",
    "SC02_known_item_ids": "SELECT DISTINCT source_id, item_id FROM listings",
    "SC07_SF11_for_quality": f"SELECT id, brand_norm, model_norm, year, km, price_gbp FROM listings WHERE brand_norm IS NOT NULL AND duplicate_of IS NULL AND (is_active OR coalesce(posted_at, first_seen_at) > {_days(400)})",
    "SC08_first_seen_since": f"""SELECT l.id, s.name AS source_name, s.platform, l.price_gbp FROM listings l JOIN sources s ON s.id = l.source_id WHERE l.first_seen_at > {_days(300)} AND price_gbp IS NOT NULL
  AND brand_norm IS NOT NULL AND duplicate_of IS NULL AND quarantine IS NULL AND (posted_at IS NULL OR posted_at > first_seen_at - INTERVAL 4 DAY)""",
    "SC10_SL_by_phone": _ranked("duplicate_of IS NULL AND seller_phone IN (SELECT seller_phone FROM listings WHERE id % 50 = 0)", "is_active DESC, first_seen_at DESC", 30, "id, seller_phone", "seller_phone"),
    "SC11_SL03_by_link": f"""SELECT a.link, max_by(l.id, (({_CANON.format('a.link')} = {_CANON.format('l.url')}), l.is_active, l.last_seen_at, -l.id)) AS id
  FROM (SELECT DISTINCT 'http://web.site' || (id % 10) || '.example/ad/' || CASE WHEN id % 3 = 0 THEN id + 1000000 ELSE id END || '/#top' AS link, item_id FROM listings WHERE id % 4 = 1) a
  JOIN listings l ON {_CANON.format('a.link')} = {_CANON.format('l.url')} OR ({_HOST.format('a.link')} = {_HOST.format('l.url')} AND l.item_id = a.item_id) GROUP BY a.link""",
    "SC12_stale_active": _ranked(f"is_active AND url IS NOT NULL AND last_seen_at < {_days(30)}", "last_seen_at", 40),
    "SC13_SF15_stale_archived": _ranked(f"NOT is_active AND inactive_reason = 'belirsiz' AND sold_at IS NULL AND url IS NOT NULL AND NOT list_has_any(coalesce(signals, []), ['satildi', 'kaldirildi']) AND inactive_at > {_days(900)} AND last_seen_at < {_days(1)}", "last_seen_at", 40),
    "SC14_km_backfill": _ranked(f"is_active AND duplicate_of IS NULL AND km IS NULL AND posted_at IS NULL AND first_seen_at > {_days(1500)} AND NOT EXISTS (SELECT 1 FROM history h WHERE h.listing_id = l.id AND h.field = 'km_deneme')", "first_seen_at", 3),
    "SC15_SF16_SF19_priceless": f"""SELECT l.id, s.name AS source_name FROM listings l JOIN sources s ON s.id = l.source_id WHERE s.platform = 'facebook' AND l.is_active AND duplicate_of IS NULL AND brand_norm IS NOT NULL
  AND year IS NOT NULL AND first_seen_at > {_days(900)} AND ((price_gbp IS NULL AND list_contains(coalesce(signals, []), 'fiyatsiz')) OR list_contains(coalesce(signals, []), 'foto_fiyat'))""",
    "SC16_priced_recent": _ranked(f"price_gbp IS NOT NULL AND first_seen_at > {_days(900)}", "first_seen_at DESC", 200),
    "SC05_JN16_new_in_group": f"""SELECT id, brand_norm, model_norm, year FROM listings l WHERE brand_norm IS NOT NULL AND year IS NOT NULL AND EXISTS (SELECT 1 FROM listings n WHERE n.first_seen_at > {_days(20)}
  AND n.brand_norm = l.brand_norm AND n.model_norm IS NOT DISTINCT FROM l.model_norm AND n.year = l.year)""",
    "SC06_twin_candidates": f"""SELECT t.id, t.site FROM t WHERE EXISTS (SELECT 1 FROM t o WHERE o.site <> t.site AND o.brand_norm = t.brand_norm AND o.model_norm = t.model_norm AND o.year = t.year AND o.amount = t.amount
  AND o.currency = t.currency AND o.first_seen_at BETWEEN t.first_seen_at - INTERVAL 400 DAY AND t.first_seen_at + INTERVAL 400 DAY)""",
    "SL08_recent_opportunities": f"""SELECT x.listing_id, x.tier, l.price_gbp, e.median_gbp AS e_median_gbp, epoch_us(x.sent_at) AS sent_at,
    (SELECT f.action FROM feedback f WHERE f.listing_id = l.id AND NOT starts_with(f.action, 'audit_') AND {_OWNER} ORDER BY f.created_at DESC, f.id DESC LIMIT 1) AS feedback
  FROM (SELECT listing_id, tier, min(sent_at) AS sent_at FROM alerts JOIN listings k ON k.id = listing_id WHERE {_REVIEWED} GROUP BY ALL ORDER BY sent_at DESC, listing_id, tier LIMIT 200) x
  JOIN listings l ON l.id = x.listing_id LEFT JOIN {_LAST} e ON e.listing_id = l.id""",
    "SL09_WN03_JN05_current_decisions": f"""SELECT l.id, row_number() OVER (w ORDER BY CASE e.tier WHEN 'guclu' THEN 0 WHEN 'pazarlik' THEN 1 ELSE 2 END, l.first_seen_at DESC, l.id)::INTEGER AS rank, count(*) OVER w AS total,
    e.tier AS e_tier, coalesce(e.method, 'A') AS method FROM listings l JOIN {_LAST} e ON e.listing_id = l.id WHERE {_PLAIN} AND l.price_gbp IS NOT NULL AND l.brand_norm IS NOT NULL AND l.model_norm IS NOT NULL AND l.year IS NOT NULL
  WINDOW w AS (PARTITION BY l.brand_norm, l.model_norm, l.year) QUALIFY rank <= 3""",
    "SL11_pending_negotiable": f"""SELECT l.id, e.profit_pct AS e_profit_pct, epoch_us({_CHANGED}) AS price_changed_at FROM {_LAST} e JOIN listings l ON l.id = e.listing_id JOIN sources s ON s.id = l.source_id
  WHERE ((e.tier = 'pazarlik' AND s.alert_level IN ('yesil', 'sari')) OR (e.tier = 'guclu' AND s.alert_level = 'sari') OR (e.tier = 'guclu' AND s.alert_level = 'yesil' AND s.platform IN ('instagram', 'facebook') AND l.posted_at < {_days(2)}))
  AND e.confidence IN ('yuksek', 'orta', 'dusuk') AND {_PLAIN} AND e.evaluated_at > {_days(900)} AND (l.first_seen_at > {_days(900)} OR coalesce({_CHANGED} > {_days(900)}, false))
  AND (l.posted_at IS NULL OR l.posted_at > l.first_seen_at - INTERVAL 4 DAY) AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.listing_id = l.id AND a.chat_id = 'c1' AND a.tier = 'pazarlik')""",
    "SL13_JN11_JN21_SF28_unnotified_strong": f"""SELECT l.id, e.profit_pct AS e_profit_pct, epoch_us({_CHANGED}) AS price_changed_at FROM {_LAST} e JOIN listings l ON l.id = e.listing_id JOIN sources s ON s.id = l.source_id
  WHERE e.tier = 'guclu' AND e.rules_version = 'v1' AND e.evaluated_at > {_days(1500)} AND s.alert_level = 'yesil' AND {_PLAIN} AND (l.first_seen_at > {_days(1500)} OR coalesce({_CHANGED} > {_days(1500)}, false))
  AND NOT {_ALERTED.format("'guclu', 'tahmini'", '')} AND NOT EXISTS (SELECT 1 FROM state u WHERE starts_with(u.key, 'sent:unsaved:' || l.id || ':'))""",
    "SL14_near_misses": f"""SELECT l.id, e.profit_pct AS e_profit_pct, e.comparables_n AS e_comparables_n FROM {_LAST} e JOIN listings l ON l.id = e.listing_id JOIN sources s ON s.id = l.source_id
  WHERE e.tier = 'pazarlik' AND e.rules_version = 'v1' AND e.comparables_n >= 8 AND NOT list_has_any(coalesce(e.reasons, []), ['yazim']) AND s.alert_level = 'yesil' AND {_PLAIN}
  AND (l.first_seen_at > {_days(1500)} OR coalesce({_CHANGED} > {_days(1500)}, false)) AND NOT {_ALERTED.format("'guclu', 'tahmini'", '')}""",
    "SL15_JN10_alerted_votes": f"""SELECT l.id, x.tier, epoch_us(x.sent_at) AS sent_at,
    (SELECT e.median_gbp FROM alerts a JOIN evaluations e ON e.id = a.evaluation_id WHERE a.listing_id = l.id ORDER BY a.sent_at, a.evaluation_id LIMIT 1) AS median_gbp,
    EXISTS (SELECT 1 FROM feedback f WHERE f.listing_id = l.id AND NOT starts_with(f.action, 'audit_') AND {_OWNER}) AS voted
  FROM (SELECT listing_id, min_by(tier, {_ORDER}) AS tier, min(sent_at) AS sent_at FROM alerts WHERE {_REVIEWED} AND sent_at > {_days(900)} AND kind IS DISTINCT FROM 'geri_cekildi' GROUP BY listing_id) x JOIN listings l ON l.id = x.listing_id""",
    "SL16_ST02_WN11_WN17_vote_queue": f"""SELECT x.listing_id, x.tier, coalesce(l.duplicate_of, l.id) AS canon, x.price_sent,
    coalesce((SELECT e.median_gbp FROM evaluations e WHERE e.id = x.ev_id), (SELECT e.median_gbp FROM evaluations e WHERE e.listing_id = l.id AND e.evaluated_at <= x.sent_at + INTERVAL 1 HOUR ORDER BY e.evaluated_at DESC, e.id DESC LIMIT 1)) AS median_gbp
  FROM (SELECT listing_id, min_by(tier, {_ORDER}) AS tier, min(sent_at) AS sent_at, arg_min(price_sent, (sent_at, evaluation_id)) AS price_sent, arg_min(evaluation_id, (sent_at, evaluation_id)) AS ev_id
        FROM alerts WHERE {_REVIEWED} AND chat_id = 'c1' AND kind IS DISTINCT FROM 'geri_cekildi' GROUP BY listing_id
        UNION ALL SELECT id, 'acil', first_seen_at, NULL, NULL FROM listings k WHERE id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.listing_id = k.id AND a.chat_id = 'c1' AND {_REVIEWED})) x
  JOIN listings l ON l.id = x.listing_id WHERE l.is_active AND l.price_gbp IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.listing_id IN (l.id, coalesce(l.duplicate_of, l.id)) AND NOT starts_with(f.action, 'audit_') AND {_OWNER})""",
    "SL17_SF06_twins": """SELECT l.id, t.id AS t_id, row_number() OVER (PARTITION BY l.id ORDER BY t.first_seen_at, t.id)::INTEGER AS rank, t.duplicate_of IS NOT NULL AND t.duplicate_of = l.id AS linked,
    epoch_us((SELECT min(a.sent_at) FROM alerts a WHERE a.listing_id = t.id AND a.tier IN ('guclu', 'tahmini'))) AS alerted_at
  FROM listings l JOIN listings t ON t.id <> l.id AND t.source_id <> l.source_id AND t.is_active AND (t.duplicate_of = l.id OR (t.brand_norm = l.brand_norm AND t.model_norm = l.model_norm AND t.year = l.year AND t.duplicate_of IS NULL
    AND t.first_seen_at BETWEEN l.first_seen_at - INTERVAL 30 DAY AND l.first_seen_at + INTERVAL 30 DAY AND (abs(t.price_gbp - l.price_gbp) <= 0.03 * l.price_gbp OR abs(t.price_amount - l.price_amount) <= 0.03 * l.price_amount)
    AND (t.km IS NULL OR l.km IS NULL OR abs(t.km - l.km) <= greatest(500, 0.03 * l.km))))
  JOIN sources s ON s.id = t.source_id AND s.alert_level IS DISTINCT FROM 'golge' WHERE l.is_active AND l.duplicate_of IS NULL AND l.quarantine IS NULL AND l.price_gbp IS NOT NULL QUALIFY rank <= 5""",
    "SL18_urgent_sent": f"""SELECT l.id, coalesce(a.price_sent, l.price_gbp) AS price_gbp, epoch_us(coalesce(a.sent_at, l.first_seen_at)) AS sent_at
  FROM listings l LEFT JOIN (SELECT * FROM alerts WHERE tier = 'acil' QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY sent_at, evaluation_id) = 1) a ON a.listing_id = l.id
  WHERE l.id % 5 = 0 AND coalesce(a.sent_at, l.first_seen_at) > {_days(600)}""",
    "SL19_SF25_resurfaced": f"""SELECT l.id, max(o.number) AS before FROM k l JOIN k o ON o.first_seen_at < l.first_seen_at - INTERVAL 10 MINUTE WHERE l.posted_at IS NULL GROUP BY l.id, l.number HAVING max(o.number) > l.number""",
    "SL20_alarm_sources": f"SELECT id, round(epoch_us({_AT} - last_checked_at) / 3.6e9, 6) AS hours FROM (SELECT *, last_checked_at AS x FROM sources) WHERE status = 'aktif' AND last_checked_at IS NOT NULL",
    "SL21_stale_sources": f"""SELECT id, round((epoch_us({_AT}) - epoch_us(coalesce(last_checked_at, created_at))) / 3.6e9, 6) AS hours FROM sources
  WHERE (platform IN ('instagram', 'facebook') AND status IN ('aktif', 'deneme') AND (platform = 'instagram' OR url LIKE '%/groups/%')) OR (platform = 'web' AND status = 'aktif' AND {_HOST.format('url')} IN ('site0.example', 'site3.example', 'site4.example'))""",
    "SL22_price_history": "SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY changed_at, old_value, new_value)::INTEGER AS step, old_value, new_value, epoch_us(changed_at) AS changed_at FROM history WHERE field = 'price_gbp'",
    "SL23_scanned_sites": f"""SELECT {_HOST.format('url')} AS host, name, epoch_us(last_checked_at) AS last_checked_at FROM sources WHERE platform = 'web' AND last_checked_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_HOST.format('url')} ORDER BY last_checked_at DESC, id DESC) = 1""",
    "AG03_recent_counts": f"SELECT source_id, count(*) AS n FROM listings WHERE first_seen_at > {_days(60)} GROUP BY source_id",
    "AG05_pass_counts": f"SELECT l.brand_norm, l.model_norm, count(DISTINCT l.id) AS n FROM feedback f JOIN listings l ON l.id = f.listing_id WHERE f.action = 'pas' AND f.created_at > {_days(60)} AND l.brand_norm IS NOT NULL AND l.model_norm IS NOT NULL AND {_OWNER} GROUP BY ALL",
    "AG06_seller_counts": """SELECT l.id, (SELECT count(*) FROM listings o WHERE o.is_active AND o.duplicate_of IS NULL AND o.id <> l.id AND o.id IS DISTINCT FROM l.duplicate_of
    AND (o.seller_phone = l.seller_phone OR (l.seller_handle LIKE 'site:_%' AND o.seller_handle = l.seller_handle AND o.source_id = l.source_id)))::INTEGER AS n
  FROM listings l WHERE seller_phone IS NOT NULL OR seller_handle LIKE 'site:_%'""",
    "AG07_social_similar": f"""SELECT brand_norm, model_norm, y AS year, count(*) AS n FROM (SELECT l.brand_norm, l.model_norm, unnest([year - 1, year, year + 1]) AS y FROM listings l JOIN sources s ON s.id = l.source_id
  WHERE s.platform = 'facebook' AND l.is_active AND l.duplicate_of IS NULL AND brand_norm IS NOT NULL AND year IS NOT NULL AND first_seen_at > {_days(600)}) GROUP BY ALL""",
    "AG08_alerts_sent": f"SELECT tier, kind, count(DISTINCT listing_id) AS n FROM alerts WHERE sent_at > {_days(300)} GROUP BY ALL",
    "AG09_vote_count": f"SELECT count(*) AS n FROM feedback f WHERE action IN ('ilgilendim', 'pas', 'yanlis_fiyat', 'kusurlu') AND {_OWNER}",
    "AG14_week_alerts": f"SELECT tier, count(DISTINCT listing_id) AS n FROM alerts WHERE tier <> 'acil' AND {_REVIEWED} AND sent_at > {_days(300)} GROUP BY tier",
    "AG15_week_feedback": f"SELECT action, count(*) AS n FROM feedback WHERE NOT starts_with(action, 'audit_') AND created_at > {_days(40)} GROUP BY action",
    "JN02_canonical_counts": "SELECT l.source_id, count(*) AS n, count(*) FILTER (c.source_id <> l.source_id) AS elsewhere FROM listings l LEFT JOIN listings c ON c.id = l.duplicate_of WHERE l.duplicate_of IS NOT NULL GROUP BY l.source_id",
    "JN06_AG42_tier_status": f"SELECT coalesce(e.tier, '-') AS tier, count(*) AS n, count(*) FILTER (e.comparables_n >= 8) AS rich FROM listings l LEFT JOIN {_LAST} e ON e.listing_id = l.id WHERE l.is_active GROUP BY 1",
    "DL15_SF29_marks_since": f"SELECT substr(key, 11) AS rest FROM state WHERE starts_with(key, 'alert:est:') AND regexp_matches(value, '^[0-9]{{4}}-') AND try_cast(value AS TIMESTAMP) > {_days(5)}",
    "DL16_source_names": "SELECT name FROM sources WHERE id IN (SELECT source_id FROM listings WHERE id % 40 = 0)",
    "DL17_state_with_prefix": "SELECT substr(key, 5) AS rest, value FROM state WHERE starts_with(key, 'cfg:')",
    "DL18_source_handles": "SELECT DISTINCT lower(split_part(rtrim(url, '/'), '/', -1)) AS handle FROM sources WHERE platform = 'instagram'",
    "DL20_alert_recent": f"SELECT substr(key, 7) AS key, coalesce(try_cast(nullif(value, '') AS TIMESTAMP) > {_AT} - INTERVAL 100 HOUR, false) AS recent FROM state WHERE starts_with(key, 'alert:')",
    "DL23_approved": "SELECT * FROM subscribers WHERE status = 'onayli'",
    "DL24_DL27_DL28_DL29_alert_exists": f"""SELECT l.id, s.chat_id, {_ALERTED.format("'guclu', 'tahmini'", ' AND a.chat_id = s.chat_id')} OR EXISTS (SELECT 1 FROM state u WHERE u.key = 'sent:unsaved:' || l.id || ':' || s.chat_id) AS hit
  FROM listings l, subscribers s WHERE l.id % 2 = 0""",
    "DL24_alert_exists_negotiable": f"SELECT l.id, s.chat_id, {_ALERTED.format(chr(39) + 'guclu' + chr(39) + ', ' + chr(39) + 'tahmini' + chr(39) + ', ' + chr(39) + 'acil' + chr(39) + ', ' + chr(39) + 'pazarlik' + chr(39), ' AND a.chat_id = s.chat_id')} AS hit FROM listings l, subscribers s WHERE l.id % 2 = 0",
}
_SQL["SL20_alarm_sources"] = f"SELECT id, round((epoch_us({_AT}) - epoch_us(last_checked_at)) / 3.6e9, 6) AS hours FROM sources WHERE status = 'aktif' AND last_checked_at IS NOT NULL"
_BEFORE = {
    "SC06_twin_candidates": f""",
t AS (SELECT l.*, {_HOST.format('s.url')} AS site, round(l.price_amount / 100000) * 100000 AS amount FROM listings l JOIN sources s ON s.id = l.source_id
  WHERE {_HOST.format('s.url')} IN ('site1.example', 'site2.example') AND l.first_seen_at > {_days(3000)})""",
    "SL19_SF25_resurfaced": f""",
k AS (SELECT l.*, regexp_extract(l.item_id, '^[0-9]{{1,15}}')::BIGINT AS number FROM listings l JOIN sources s ON s.id = l.source_id WHERE {_HOST.format("s.url")} = 'site5.example')""",
}
ORACLE_SQL = {n: f"WITH {records_sql()}{_BEFORE.get(n, '')}\n{q}" for n, q in _SQL.items()}
