"""Changes of the record tables: each returns the rows as they are after it, or the rows to append, never an update in place.

A caller writes them with whatever its table format offers (MERGE, overwrite by partition, append).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertlake.functions.text import link_host
from advertlake.operators.reads import CLOSED_SIGNALS, UNKNOWN, ago, has_any
from advertlake.sources.records import Records


def _history(ids: DataFrame, field: str, old: Column, new: Column, now: Column) -> DataFrame:
    return ids.select(F.col("id").alias("listing_id"), F.lit(field).alias("field"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), now.alias("changed_at"))


def reactivate_present(r: Records, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adverts closed for an unknown reason that the site still lists (source_id, item_id) are open again: (their rows, history rows to append)."""
    shut = r.listings.filter(~F.col("is_active") & (F.col("inactive_reason") == UNKNOWN) & F.col("sold_at").isNull() & ~has_any(F.col("signals"), *CLOSED_SIGNALS))
    now = F.lit(r.now)
    rows = shut.join(present.select("source_id", "item_id").distinct(), ["source_id", "item_id"], "left_semi")
    rows = rows.withColumns({"is_active": F.lit(True), "inactive_at": F.lit(None).cast("timestamp"), "inactive_reason": F.lit(None).cast("string"), "last_seen_at": now})
    return rows, _history(rows, "geri_acildi", F.lit(UNKNOWN), F.lit(None), now)


def reopen(r: Records, ids: DataFrame) -> DataFrame:
    """Adverts (id) whose own page shows them again."""
    none = {"inactive_at": F.lit(None).cast("timestamp"), "inactive_reason": F.lit(None).cast("string"), "signals": F.lit(None).cast("array<string>")}
    return r.listings.join(ids, "id", "left_semi").withColumns({"is_active": F.lit(True), **none})


def expire_unverifiable(r: Records, days: int, platforms: list[str], hosts: list[str], frozen_hosts: list[str], frozen_days: int) -> DataFrame:
    """Old active adverts of sources that never tell what was sold: social ones, some sites, and sites that have not been readable for days."""
    host = link_host(F.col("url"))
    frozen = host.isin(frozen_hosts) & (F.col("last_checked_at") < ago(r, days=frozen_days))
    s = r.sources.filter(F.col("platform").isin(platforms) | host.isin(hosts) | F.coalesce(frozen, F.lit(False))).select(F.col("id").alias("source_id"))
    rows = r.listings.filter(F.col("is_active") & (F.coalesce("posted_at", "first_seen_at") < ago(r, days=days))).join(s, "source_id", "left_semi")
    return rows.withColumns({"is_active": F.lit(False), "inactive_at": F.lit(r.now), "inactive_reason": F.lit(UNKNOWN)})


def set_quarantine(r: Records, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The quarantine written anew from (id, reason): (id, quarantine) of the adverts whose value changes, and the ids that are new in it."""
    now = reasons.select("id", F.col("reason").alias("new"))
    both = r.listings.select("id", "quarantine").join(now, "id", "left").filter("quarantine is not null or new is not null")
    changed = both.filter(~F.col("quarantine").eqNullSafe(F.col("new"))).select("id", F.col("new").alias("quarantine"))
    return changed, both.filter("quarantine is null").select("id")


def apply_keys(r: Records, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected keys (id, new_brand_norm, new_model_norm): (the adverts that change, a history row for each changed field)."""
    rows = r.listings.join(keys, "id")
    pairs = [("brand_norm", "new_brand_norm"), ("model_norm", "new_model_norm")]
    differs = [~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]
    rows = rows.filter(differs[0] | differs[1])
    one = F.array_compact(F.array(*[F.when(d, F.struct(F.lit(a).alias("field"), F.col(a).alias("old_value"), F.col(b).alias("new_value"))) for d, (a, b) in zip(differs, pairs, strict=True)]))
    log = rows.select(F.col("id").alias("listing_id"), F.explode(one).alias("c")).select("listing_id", "c.*", F.lit(r.now).alias("changed_at"))
    return rows.withColumns({a: F.col(b) for a, b in pairs}).drop(*[b for _, b in pairs]), log


def fill_page_fields(r: Records, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields read from an advert's page (id, page_km, page_posted_at, page_handle) where the advert has none: (rows, history rows of new mileages)."""
    rows = r.listings.join(pages, "id")
    new_km = rows.filter("km is null and page_km is not null")
    log = _history(new_km, "km", F.lit(None), F.col("page_km"), F.lit(r.now))
    filled = {"km": F.coalesce("km", "page_km"), "posted_at": F.coalesce("posted_at", "page_posted_at"), "seller_handle": F.coalesce("seller_handle", "page_handle")}
    return rows.withColumns(filled).drop("page_km", "page_posted_at", "page_handle"), log


def note_km_attempts(r: Records, ids: DataFrame) -> DataFrame:
    return _history(ids, "km_deneme", F.lit(None), F.lit(None), F.lit(r.now))


def mark_checked(r: Records, read: DataFrame) -> DataFrame:
    """Sources after a read (id, new_cursor, new_week): the instant, and cursor and weekly number where the read gave one."""
    got = r.sources.join(read, "id")
    return got.withColumns({"last_checked_at": F.lit(r.now), "cursor": F.coalesce("new_cursor", "cursor"), "listings_7d": F.coalesce("new_week", "listings_7d")}).drop("new_cursor", "new_week")


def mark_alive(r: Records, seen: DataFrame) -> DataFrame:
    """Ids of known active adverts that a list shows again (source_id, item_id), with the instant."""
    rows = r.listings.filter("is_active").join(seen.select("source_id", "item_id").distinct(), ["source_id", "item_id"], "left_semi")
    return rows.select("id", F.lit(r.now).alias("last_alive_at"))


def touch(r: Records, ids: DataFrame) -> DataFrame:
    return r.listings.join(ids, "id", "left_semi").withColumn("last_seen_at", F.lit(r.now))


def set_duplicates(r: Records, links: DataFrame) -> DataFrame:
    """Adverts with their canonical advert (id, canonical) set."""
    return r.listings.join(links, "id").withColumn("duplicate_of", F.col("canonical")).drop("canonical")


def link_first_posts(r: Records, pairs: DataFrame, platform: str = "facebook") -> DataFrame:
    """(id, canonical) for posts whose text a reader has seen before (source_id, item_id, first_item_id): the canonical advert of the earliest post
    of that number in any group. Both are no copies and not the same, car, amount and currency are the same with the model known, an active post
    only follows an active advert, and a shadow source's advert only leads other shadow adverts."""
    s = r.sources.select(F.col("id").alias("source_id"), "platform", (F.col("alert_level") == "golge").alias("shadow"))
    rows = r.listings.join(s, "source_id")
    first = rows.filter(F.col("platform") == platform).groupBy(F.col("item_id").alias("first_item_id")).agg(F.min_by(F.coalesce("duplicate_of", "id"), F.struct("first_seen_at", "id")).alias("c_id"))
    cols = ["id", "brand_norm", "model_norm", "year", "price_amount", "currency", "is_active", "shadow"]
    alone = rows.filter("duplicate_of is null")
    post = alone.join(pairs.join(first, "first_item_id"), ["source_id", "item_id"]).select(*cols, "c_id")
    c = alone.select([F.col(x).alias(f"c_{x}") for x in cols])
    same = [F.col(x) == F.col(f"c_{x}") for x in ("brand_norm", "model_norm", "year")]
    money = F.col("price_amount").eqNullSafe(F.col("c_price_amount")) & F.col("currency").eqNullSafe(F.col("c_currency"))
    got = post.join(c, ["c_id"]).filter(same[0] & same[1] & same[2] & money & (F.col("id") != F.col("c_id")))
    got = got.filter((F.col("c_is_active") | ~F.col("is_active")) & (~F.col("c_shadow") | F.col("shadow")))
    return got.select("id", F.col("c_id").alias("canonical")).distinct()


def mark_sold(r: Records, ids: DataFrame) -> DataFrame:
    """Adverts that a user calls sold: closed, with the reason, and the signal added once."""
    now, sig = F.lit(r.now), F.coalesce("signals", F.array().cast("array<string>"))
    rows = r.listings.join(ids, "id", "left_semi")
    return rows.withColumns({
        "is_active": F.lit(False), "inactive_at": F.coalesce("inactive_at", now), "inactive_reason": F.lit("satildi"),
        "signals": F.when(F.array_contains(sig, "satildi"), F.col("signals")).otherwise(F.array_append(sig, "satildi")),
    })


def close_by_number(r: Records, texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """Active adverts whose text (listing_id, raw_text) names an advert number that its page now calls sold (source_id, number), and that do not say
    so themselves. The numbers of a text are extracted once and joined by equality."""
    found = F.regexp_extract_all("raw_text", F.lit(r"[iİIı]lan\s*(?:[nN]umaras[ıiİI]|[nN][oO])\s*[:.]?\s*[^\p{L}\p{N}_]{0,4}([0-9]{3,8})(?![\p{L}\p{N}_])"), F.lit(1))
    said = F.col("raw_text").rlike(r"(?iu)sat[ıiİI]ld[ıiİI]")
    t = texts.filter(~said).select(F.col("listing_id").alias("id"), F.explode(found).alias("number")).distinct()
    rows = r.listings.filter("is_active").join(t, "id").join(numbers, ["source_id", "number"], "left_semi").drop("number").dropDuplicates(["id"])
    return rows.withColumns({"is_active": F.lit(False), "signals": F.array(F.lit("satildi")), "inactive_at": F.lit(r.now), "inactive_reason": F.lit(UNKNOWN)})


def block_sellers(r: Records, blocked: DataFrame, asked: DataFrame) -> DataFrame:
    """Phones to block (phone, reason) for adverts (id, reason) that have one, without those blocked already; the first advert's reason stands."""
    rows = r.listings.filter("seller_phone is not null and seller_phone <> ''").join(asked, "id")
    new = rows.groupBy(F.col("seller_phone").alias("phone")).agg(F.min_by("reason", "id").alias("reason"))
    return new.join(blocked.select("phone"), "phone", "left_anti")


def append_evaluations(r: Records, new: DataFrame) -> DataFrame:
    """The decision log with new rows behind it; columns that a row lacks are null."""
    return r.evaluations.unionByName(new, allowMissingColumns=True)


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The key-value state after changes (key, value, at): the newest change of a key wins, keys without a change stay."""
    new = changes.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    return state.join(new, "key", "left_anti").unionByName(new)


def mark_alerted(state: DataFrame, keys: DataFrame, now: Column, forget: bool = False) -> DataFrame:
    """The state with the owner's alarms (key) set to now, or reset so that the next one goes out at once."""
    value = F.lit("") if forget else F.date_format(now, "yyyy-MM-dd HH:mm:ss")
    return upsert_state(state, keys.select(F.concat(F.lit("alert:"), "key").alias("key"), value.alias("value"), now.alias("at")))


def set_alert_level(r: Records, ids: DataFrame, level: str) -> DataFrame:
    return r.sources.join(ids, "id", "left_semi").withColumn("alert_level", F.lit(level))


def add_sources(r: Records, new: DataFrame) -> DataFrame:
    """(url, name, platform, status, priority) to merge for new sources (url, name, platform, status): an unknown address comes behind its
    platform's last priority, a known one is opened again and keeps its own."""
    known = r.sources.select("url", F.col("priority").alias("own"))
    top = r.sources.groupBy("platform").agg(F.max("priority").alias("top"))
    rows = new.dropDuplicates(["url"]).join(known, "url", "left").join(top, "platform", "left")
    order = F.row_number().over(Window.partitionBy("platform", F.col("own").isNull()).orderBy("url"))
    return rows.withColumn("priority", F.coalesce("own", F.coalesce("top", F.lit(0)) + order)).drop("own", "top")


def disabled_models(disabled: DataFrame, failing: DataFrame) -> DataFrame:
    """Models (key: brand|model) without estimates after those that were voted down too often (brand_norm, model_norm) joined them."""
    return disabled.select("key").union(failing.select(F.concat_ws("|", "brand_norm", "model_norm"))).distinct()


def tightened(votes: DataFrame, current: float, window: int = 10, min_bad: int = 5, step: float = 0.05, floor: float = 0.60) -> DataFrame:
    """(share): the stricter threshold if enough of the last `window` voted estimates (bad, newest first by at) were bad; no row otherwise."""
    last = votes.orderBy(F.desc("at"), "listing_id").limit(window)
    new = round(max(current - step, floor), 2)
    got = last.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad_n")).filter((F.col("n") == window) & (F.col("bad_n") >= min_bad))
    return got.select(F.lit(new).alias("share")).filter(F.lit(new) < current)


def learning_open(votes: DataFrame, least: int = 10) -> DataFrame:
    """(open): whether there are enough votes for automatic steps; votes: (n)."""
    return votes.select((F.col("n") >= least).alias("open"))


def demote_sources(r: Records, failing: DataFrame, level: str = "sari") -> DataFrame:
    """Sources (id) whose alerts were voted down too often lose their level; those below it already stay."""
    return set_alert_level(r, failing.join(r.sources.filter("alert_level = 'yesil'").select("id"), "id", "left_semi"), level)
