"""Queries of the changes of the record tables, with their SQL: the rows as they are after the change, or the rows to append."""

from __future__ import annotations

from pyspark.sql import functions as F

from advertlake.operators import changes as C
from advertlake.operators import reads as R
from advertlake.sources.records import NOW, records, records_sql


def _query(build):
    return lambda spark, d: build(records(spark, d))


def _us(*names: str):
    return [F.unix_micros(n).alias(n) for n in names]


def _present(r):
    return r.listings.filter("id % 3 <> 1").select("source_id", "item_id")


def _ids(r, every: int):
    return r.listings.filter(F.col("id") % every == 0).select("id")


def _keys(r):
    """Corrected keys: one brand is written differently, unknown models of another become known."""
    brand = F.when(F.col("brand_norm") == "Brand#3", "Brand#03").otherwise(F.col("brand_norm"))
    model = F.when(F.col("brand_norm").isin("Brand#4", "Brand#3"), F.coalesce("model_norm", F.lit("M9"))).otherwise(F.col("model_norm"))
    return r.listings.select("id", brand.alias("new_brand_norm"), model.alias("new_model_norm"))


def _pages(r):
    at = F.timestamp_add("DAY", F.lit(-2), F.col("first_seen_at"))
    return r.listings.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.lit(77000)).alias("page_km"), at.alias("page_posted_at"), F.lit("page").alias("page_handle"))


def _reposts(r):
    """Posts that a reader knows from another post: the one of the advert 40 numbers before."""
    first = F.concat((((F.col("id") - 40) * 7) % 90001).cast("string"), F.lit("-x"))
    return r.listings.filter("id >= 40").select("source_id", "item_id", first.alias("first_item_id"))


def _same_car(r):
    """Every advert of a group of 40 is the same car at the same price, so that reposts can be linked."""
    import dataclasses

    return dataclasses.replace(r, listings=r.listings.withColumns({"brand_norm": F.lit("Brand#1"), "model_norm": F.when(F.col("id") % 5 != 0, F.lit("M1")), "year": F.lit(1995), "price_amount": F.round(F.col("price_amount") / 300000), "currency": F.lit("GBP")}))


def _failing(r):
    f = R.owner_votes(r).filter(F.col("action").isin(R.BAD_VOTES)).select("listing_id")
    sent = r.alerts.filter("tier = 'tahmini'").select("listing_id").distinct()
    rows = r.listings.select(F.col("id").alias("listing_id"), "brand_norm", "model_norm").dropna().join(f.distinct(), "listing_id").join(sent, "listing_id")
    return rows.groupBy("brand_norm", "model_norm").agg(F.count("*").alias("bad_n")).filter("bad_n >= 2")


def _estimate_votes(r):
    sent = r.alerts.filter("tier = 'tahmini'").select("listing_id").distinct()
    f = R.owner_votes(r).join(sent, "listing_id", "left_semi")
    return f.groupBy("listing_id").agg(F.bool_or(F.col("action").isin(R.BAD_VOTES)).alias("bad"), F.max("created_at").alias("at"))


def _new_sources(r):
    k = F.col("id")
    url = F.when(k % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://new"), k.cast("string"), F.lit(".example/")))
    return r.sources.select(url.alias("url"), F.concat(F.lit("N"), k.cast("string")).alias("name"), "platform", F.lit("aktif").alias("status"))


def _state_changes(r):
    return r.history.select(F.concat(F.lit("cfg:"), (F.col("listing_id") % 400).cast("string")).alias("key"), F.col("new_value").alias("value"), F.col("changed_at").alias("at"))


def _blocked(r):
    return r.listings.filter("id % 10 = 0 and seller_phone is not null").select(F.col("seller_phone").alias("phone")).distinct()


def _judgements(r):
    e = r.listings.filter("id % 20 = 0").select(F.concat(F.lit("new-"), F.col("id").cast("string")).alias("id"), F.col("id").alias("listing_id"), F.lit(NOW).alias("evaluated_at"), F.lit("yok").alias("tier"))
    return e


def _reasons(r):
    return r.listings.filter("id % 7 = 0").select("id", F.when(F.col("id") % 2 == 0, "tek").otherwise("fiyat").alias("reason"))


QUERIES = {
    "SM12_reactivate_present": _query(lambda r: C.reactivate_present(r, _present(r))[0].select("id", "is_active", "inactive_reason", *_us("last_seen_at"))),
    "SM12_reactivate_history": _query(lambda r: C.reactivate_present(r, _present(r))[1].select("listing_id", "field", "old_value", "new_value")),
    "SM13_expire_unverifiable": _query(lambda r: C.expire_unverifiable(r, 30, ["instagram"], ["site4.example"], ["site8.example", "site0.example"], 2).select("id", "is_active", "inactive_reason")),
    "SM16_set_quarantine": _query(lambda r: C.set_quarantine(r, _reasons(r))[0]),
    "SM16_new_in_quarantine": _query(lambda r: C.set_quarantine(r, _reasons(r))[1]),
    "SM18_SM20_apply_keys": _query(lambda r: C.apply_keys(r, _keys(r))[0].select("id", "brand_norm", "model_norm")),
    "SM18_key_history": _query(lambda r: C.apply_keys(r, _keys(r))[1].select("listing_id", "field", "old_value", "new_value")),
    "SM03_upsert_state": _query(lambda r: C.upsert_state(r.state, _state_changes(r))),
    "SM32_ST04_disabled_models": _query(lambda r: C.disabled_models(r.listings.filter("id % 100 = 0 and model_norm is not null").select(F.concat_ws("|", "brand_norm", "model_norm").alias("key")), _failing(r))),
    "SM33_tightened": _query(lambda r: C.tightened(_estimate_votes(r), 0.8, 10, 3)),
    "SM34_demote_sources": _query(lambda r: C.demote_sources(r, r.sources.filter("id % 2 = 0").select("id")).select("id", "alert_level")),
    "SM35_learning_open": _query(lambda r: C.learning_open(R.vote_count(r))),
    "DL01_note_km_attempts": _query(lambda r: C.note_km_attempts(r, _ids(r, 50)).select("listing_id", "field")),
    "DL02_fill_page_fields": _query(lambda r: C.fill_page_fields(r, _pages(r))[0].select("id", "km", "seller_handle", *_us("posted_at"))),
    "DL02_filled_history": _query(lambda r: C.fill_page_fields(r, _pages(r))[1].select("listing_id", "field", "new_value")),
    "DL03_mark_checked": _query(lambda r: C.mark_checked(r, r.sources.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "next").alias("new_cursor"), F.lit(None).cast("int").alias("new_week"))).select("id", "cursor", "listings_7d", *_us("last_checked_at"))),
    "DL04_mark_alive": _query(lambda r: C.mark_alive(r, _present(r)).select("id", *_us("last_alive_at"))),
    "DL05_set_duplicates": _query(lambda r: C.set_duplicates(r, r.listings.filter("id % 6 = 5").select("id", (F.col("id") - 1).alias("canonical"))).select("id", "duplicate_of")),
    "DL06_JN22_link_first_posts": _query(lambda r: C.link_first_posts(_same_car(r), _reposts(r))),
    "DL07_reopen": _query(lambda r: C.reopen(r, _ids(r, 9)).select("id", "is_active", "inactive_reason", F.size(F.coalesce("signals", F.array().cast("array<string>"))).alias("n_signals"))),
    "DL09_touch": _query(lambda r: C.touch(r, _ids(r, 9)).select("id", *_us("last_seen_at"))),
    "DL10_append_evaluations": _query(lambda r: C.append_evaluations(r, _judgements(r)).groupBy("tier").agg(F.count("*").alias("n"), F.count("comparables_n").alias("with_n"))),
    "DL11_SF17_mark_sold": _query(lambda r: C.mark_sold(r, _ids(r, 9)).select("id", "is_active", "inactive_reason", F.array_join("signals", ",").alias("signals"), *_us("inactive_at"))),
    "DL12_DL13_block_sellers": _query(lambda r: C.block_sellers(r, _blocked(r), _ids(r, 3).select("id", F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("reason")))),
    "DL19_set_alert_level": _query(lambda r: C.set_alert_level(r, r.sources.filter("id % 3 = 0").select("id"), "sari").select("id", "alert_level")),
    "DL21_mark_alerted": _query(lambda r: C.mark_alerted(r.state, r.listings.filter("id % 60 = 0").select(F.concat(F.lit("est:"), F.col("id").cast("string")).alias("key")), F.lit(NOW))),
    "DL22_forget_alert": _query(lambda r: C.mark_alerted(r.state, r.listings.filter("id % 60 = 0").select(F.concat(F.lit("est:"), F.col("id").cast("string")).alias("key")), F.lit(NOW), forget=True)),
    "DL30_add_sources": _query(lambda r: C.add_sources(r, _new_sources(r)).select("url", "name", "priority", "status")),
}

_AT = f"TIMESTAMP '{NOW}'"
_HOST = "regexp_replace(lower(split_part(split_part({0}, '://', 2), '/', 1)), '^(www|m|web|mobile)\\.', '')"
_OWNER = "NOT EXISTS (SELECT 1 FROM subscribers v WHERE NOT v.is_owner AND f.note = 'chat:' || v.chat_id)"
_PRESENT = "(source_id, item_id) IN (SELECT (source_id, item_id) FROM listings WHERE id % 3 <> 1)"
_SHUT = f"NOT is_active AND inactive_reason = 'belirsiz' AND sold_at IS NULL AND NOT list_has_any(coalesce(signals, []), ['satildi', 'kaldirildi']) AND {_PRESENT}"
_BRAND = "CASE WHEN brand_norm = 'Brand#3' THEN 'Brand#03' ELSE brand_norm END"
_MODEL = "CASE WHEN brand_norm IN ('Brand#4', 'Brand#3') THEN coalesce(model_norm, 'M9') ELSE model_norm END"
_QUAR = "(SELECT id, quarantine, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN 'tek' ELSE 'fiyat' END END AS new FROM listings)"
_MARKED = """SELECT key, value FROM state WHERE key NOT IN (SELECT 'alert:est:' || id FROM listings WHERE id % 60 = 0) UNION ALL SELECT DISTINCT 'alert:est:' || id, {0} FROM listings WHERE id % 60 = 0"""

_SQL = {
    "SM12_reactivate_present": f"SELECT id, true AS is_active, NULL::VARCHAR AS inactive_reason, epoch_us({_AT}) AS last_seen_at FROM listings WHERE {_SHUT}",
    "SM12_reactivate_history": f"SELECT id AS listing_id, 'geri_acildi' AS field, 'belirsiz' AS old_value, NULL::VARCHAR AS new_value FROM listings WHERE {_SHUT}",
    "SM13_expire_unverifiable": f"""SELECT l.id, false AS is_active, 'belirsiz' AS inactive_reason FROM listings l JOIN sources s ON s.id = l.source_id WHERE l.is_active AND coalesce(l.posted_at, l.first_seen_at) < {_AT} - INTERVAL 30 DAY
  AND (s.platform = 'instagram' OR {_HOST.format('s.url')} = 'site4.example' OR ({_HOST.format('s.url')} IN ('site8.example', 'site0.example') AND s.last_checked_at < {_AT} - INTERVAL 2 DAY))""",
    "SM16_set_quarantine": f"SELECT id, new AS quarantine FROM {_QUAR} WHERE quarantine IS DISTINCT FROM new",
    "SM16_new_in_quarantine": f"SELECT id FROM {_QUAR} WHERE quarantine IS NULL AND new IS NOT NULL",
    "SM18_SM20_apply_keys": f"SELECT id, {_BRAND} AS brand_norm, {_MODEL} AS model_norm FROM listings l WHERE l.brand_norm IS DISTINCT FROM {_BRAND} OR l.model_norm IS DISTINCT FROM {_MODEL}",
    "SM18_key_history": f"""SELECT id AS listing_id, 'brand_norm' AS field, brand_norm AS old_value, {_BRAND} AS new_value FROM listings WHERE brand_norm IS DISTINCT FROM {_BRAND}
  UNION ALL SELECT id, 'model_norm', model_norm, {_MODEL} FROM listings WHERE model_norm IS DISTINCT FROM {_MODEL}""",
    "SM03_upsert_state": """SELECT coalesce(s.key, n.key) AS key, CASE WHEN n.key IS NULL THEN s.value ELSE n.value END AS value FROM state s
  FULL JOIN (SELECT 'cfg:' || (listing_id % 400) AS key, arg_max(new_value, (changed_at, new_value)) AS value FROM history GROUP BY 1) n ON n.key = s.key""",
    "SM32_ST04_disabled_models": f"""SELECT DISTINCT brand_norm || '|' || model_norm AS key FROM listings WHERE id % 100 = 0 AND model_norm IS NOT NULL UNION
  SELECT l.brand_norm || '|' || l.model_norm FROM feedback f JOIN listings l ON l.id = f.listing_id WHERE f.action IN ('yanlis_fiyat', 'kusurlu') AND {_OWNER} AND l.brand_norm IS NOT NULL AND l.model_norm IS NOT NULL
    AND EXISTS (SELECT 1 FROM alerts a WHERE a.listing_id = l.id AND a.tier = 'tahmini') GROUP BY l.brand_norm, l.model_norm HAVING count(DISTINCT l.id) >= 2""",
    "SM33_tightened": f"""SELECT 0.75::DOUBLE AS share FROM (SELECT count(*) AS n, count(*) FILTER (bad) AS b FROM (SELECT f.listing_id, bool_or(f.action IN ('yanlis_fiyat', 'kusurlu')) AS bad FROM feedback f
  WHERE {_OWNER} AND EXISTS (SELECT 1 FROM alerts a WHERE a.listing_id = f.listing_id AND a.tier = 'tahmini') GROUP BY f.listing_id ORDER BY max(f.created_at) DESC, f.listing_id LIMIT 10)) WHERE n = 10 AND b >= 3""",
    "SM34_demote_sources": "SELECT id, 'sari' AS alert_level FROM sources WHERE id % 2 = 0 AND alert_level = 'yesil'",
    "SM35_learning_open": f"SELECT count(*) >= 10 AS open FROM feedback f WHERE action IN ('ilgilendim', 'pas', 'yanlis_fiyat', 'kusurlu') AND {_OWNER}",
    "DL01_note_km_attempts": "SELECT id AS listing_id, 'km_deneme' AS field FROM listings WHERE id % 50 = 0",
    "DL02_fill_page_fields": "SELECT id, coalesce(km, CASE WHEN id % 8 = 0 THEN 77000 END) AS km, coalesce(seller_handle, 'page') AS seller_handle, epoch_us(coalesce(posted_at, first_seen_at - INTERVAL 2 DAY)) AS posted_at FROM listings WHERE id % 4 = 0",
    "DL02_filled_history": "SELECT id AS listing_id, 'km' AS field, '77000' AS new_value FROM listings WHERE id % 8 = 0 AND km IS NULL",
    "DL03_mark_checked": f"SELECT id, CASE WHEN id % 4 = 0 THEN 'next' ELSE cursor END AS cursor, listings_7d, epoch_us({_AT}) AS last_checked_at FROM sources WHERE id % 2 = 0",
    "DL04_mark_alive": f"SELECT id, epoch_us({_AT}) AS last_alive_at FROM listings WHERE is_active AND {_PRESENT}",
    "DL05_set_duplicates": "SELECT id, id - 1 AS duplicate_of FROM listings WHERE id % 6 = 5",
    "DL06_JN22_link_first_posts": """SELECT DISTINCT n.id, c.id AS canonical FROM k n JOIN listings l ON l.id = n.id AND l.id >= 40
  JOIN (SELECT l.item_id, arg_min(coalesce(l.duplicate_of, l.id), (l.first_seen_at, l.id)) AS c_id FROM listings l JOIN sources s ON s.id = l.source_id WHERE s.platform = 'facebook' GROUP BY l.item_id) f
    ON f.item_id = (((l.id - 40) * 7) % 90001) || '-x' JOIN k c ON c.id = f.c_id AND c.id <> n.id AND c.model = n.model AND c.amount = n.amount AND (c.is_active OR NOT n.is_active) AND (NOT c.shadow OR n.shadow)""",
    "DL07_reopen": "SELECT id, true AS is_active, NULL::VARCHAR AS inactive_reason, 0 AS n_signals FROM listings WHERE id % 9 = 0",
    "DL09_touch": f"SELECT id, epoch_us({_AT}) AS last_seen_at FROM listings WHERE id % 9 = 0",
    "DL10_append_evaluations": "SELECT tier, count(*) AS n, count(comparables_n) AS with_n FROM (SELECT tier, comparables_n FROM evaluations UNION ALL SELECT 'yok', NULL FROM listings WHERE id % 20 = 0) GROUP BY tier",
    "DL11_SF17_mark_sold": f"""SELECT id, false AS is_active, 'satildi' AS inactive_reason, CASE WHEN list_contains(coalesce(signals, []), 'satildi') THEN array_to_string(signals, ',') ELSE array_to_string(coalesce(signals, []) || ['satildi'], ',') END AS signals,
  epoch_us(coalesce(inactive_at, {_AT})) AS inactive_at FROM listings WHERE id % 9 = 0""",
    "DL12_DL13_block_sellers": """SELECT seller_phone AS phone, 'r' || (min(id) % 2) AS reason FROM listings l WHERE id % 3 = 0 AND seller_phone IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM listings b WHERE b.id % 10 = 0 AND b.seller_phone = l.seller_phone) GROUP BY seller_phone""",
    "DL19_set_alert_level": "SELECT id, 'sari' AS alert_level FROM sources WHERE id % 3 = 0",
    "DL21_mark_alerted": _MARKED.format(f"'{NOW}'"),
    "DL22_forget_alert": _MARKED.format("''"),
    "DL30_add_sources": """SELECT n.url, n.name, coalesce(s.priority, coalesce(t.top, 0) + row_number() OVER (PARTITION BY n.platform, s.id IS NULL ORDER BY n.url))::INTEGER AS priority, 'aktif' AS status
  FROM (SELECT CASE WHEN id % 2 = 0 THEN url ELSE 'https://new' || id || '.example/' END AS url, 'N' || id AS name, platform FROM sources) n LEFT JOIN sources s ON s.url = n.url
  LEFT JOIN (SELECT platform, max(priority) AS top FROM sources GROUP BY platform) t ON t.platform = n.platform""",
}
_BEFORE = {
    "DL06_JN22_link_first_posts": """,
k AS (SELECT l.id, CASE WHEN l.id % 5 <> 0 THEN 'M1' END AS model, round(l.price_amount / 300000) AS amount, l.is_active, s.alert_level = 'golge' AS shadow FROM listings l JOIN sources s ON s.id = l.source_id WHERE l.duplicate_of IS NULL)""",
}
ORACLE_SQL = {n: f"WITH {records_sql()}{_BEFORE.get(n, '')}\n{q}" for n, q in _SQL.items()}
