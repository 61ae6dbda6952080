"""Reads over the record tables: work-lists, reviews, counts, look-ups and history, each as one plan over whole tables.

What the application asks for one advert, seller or key is answered for all of them at once: a lookup is a join with the rows of interest.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertlake.functions.text import canonical_link, link_host
from advertlake.sources.records import Records

# fixed values: tiers of alerts, votes and closing reasons
SENT_ONCE = ["guclu", "tahmini"]
URGENT = "acil"
REVIEW = [*SENT_ONCE, "pazarlik", URGENT]
VOTES = ["ilgilendim", "pas", "yanlis_fiyat", "kusurlu"]
BAD_VOTES = ["yanlis_fiyat", "kusurlu"]
UNKNOWN, RETRACTED, SHADOW = "belirsiz", "geri_cekildi", "golge"
CLOSED_SIGNALS = ["satildi", "kaldirildi"]
UNSAVED = "sent:unsaved:"


def ago(r: Records, **span: float) -> Column:
    return F.lit(r.now - dt.timedelta(**span))


def blocking_tiers(tier: str) -> list[str]:
    """Tiers whose alert stops another alert of this tier."""
    if tier == "pazarlik":
        return [*SENT_ONCE, URGENT, tier]
    return SENT_ONCE if tier in SENT_ONCE else [tier]


def unsaved_key(listing: Column, chat: Column, tier: str | None = None) -> Column:
    """The state key of an alert that was sent but not recorded."""
    head = UNSAVED if tier is None or tier in SENT_ONCE else f"{UNSAVED}{tier}:"
    return F.concat(F.lit(head), listing.cast("string"), F.lit(":"), chat)


def has_any(signals: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(signals, F.array(*map(F.lit, names))), F.lit(False))


def plain(r: Records) -> DataFrame:
    """Adverts that are neither copies nor in quarantine."""
    return r.listings.filter("duplicate_of is null and quarantine is null")


def with_source(r: Records, rows: DataFrame) -> DataFrame:
    s = r.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "platform", "alert_level", F.col("url").alias("source_url"))
    return rows.join(s, "source_id")


def last_evaluation(r: Records) -> DataFrame:
    """The newest evaluation of each advert, ties to the larger id."""
    cols = [c for c in r.evaluations.columns if c != "listing_id"]
    one = F.max_by(F.struct(*cols), F.struct("evaluated_at", "id"))
    return r.evaluations.groupBy("listing_id").agg(one.alias("e")).select("listing_id", *[F.col(f"e.{c}").alias(f"e_{c}") for c in cols])


def price_changed(r: Records) -> DataFrame:
    """The instant of the last price change of each advert."""
    return r.history.filter("field = 'price_gbp'").groupBy("listing_id").agg(F.max("changed_at").alias("price_changed_at"))


def owner_votes(r: Records) -> DataFrame:
    """Feedback of the owner or of nobody known: rows that no subscriber but the owner has signed."""
    others = r.subscribers.filter("not is_owner").select(F.concat(F.lit("chat:"), "chat_id").alias("note"))
    return r.feedback.join(others, "note", "left_anti")


def alerted(r: Records, tiers: list[str], *by: str) -> DataFrame:
    """(id, *by): adverts that were alerted in one of the tiers themselves, or one of whose copies was."""
    a = r.alerts.filter(F.col("tier").isin(tiers)).select("listing_id", *by)
    d = r.listings.select(F.col("id").alias("listing_id"), "duplicate_of")
    return a.join(d, "listing_id").select(F.explode(F.array_compact(F.array("listing_id", "duplicate_of"))).alias("id"), *by).distinct()


def reviewable(r: Records, since: Column) -> DataFrame:
    """Alerts that are reviewed: negotiable ones only from the day on that they have been sent at once."""
    return r.alerts.filter(F.col("tier").isin(REVIEW) & ((F.col("tier") != "pazarlik") | (F.col("sent_at") >= since)))


def best_tier(tier: Column) -> Column:
    """Of the tiers of a group the one that comes first in REVIEW."""
    return F.min_by(tier, F.array_position(F.array(*map(F.lit, REVIEW)), tier))


# sources


def sources_of(r: Records, platform: str, statuses: list[str]) -> DataFrame:
    return r.sources.filter((F.col("platform") == platform) & F.col("status").isin(statuses)).orderBy("priority", "name", "id")


def alarm_sources(r: Records) -> DataFrame:
    """Active sources that were read once, and the hours since."""
    hours = (F.unix_micros(F.lit(r.now)) - F.unix_micros("last_checked_at")) / 3.6e9
    return r.sources.filter("status = 'aktif' and last_checked_at is not null").select("id", "name", "platform", "url", hours.alias("hours_since_check"))


def stale_sources(r: Records, web_hosts: list[str]) -> DataFrame:
    """Sources that are watched for staleness: groups and accounts in use, and active sites of the given hosts."""
    social = F.col("platform").isin("instagram", "facebook") & F.col("status").isin("aktif", "deneme") & ((F.col("platform") == "instagram") | F.col("url").contains("/groups/"))
    web = (F.col("platform") == "web") & (F.col("status") == "aktif") & link_host(F.col("url")).isin(web_hosts)
    hours = (F.unix_micros(F.lit(r.now)) - F.unix_micros(F.coalesce("last_checked_at", "created_at"))) / 3.6e9
    return r.sources.filter(social | web).select("id", "name", "platform", "status", "listings_7d", hours.alias("hours_since_check"))


def scanned_sites(r: Records) -> DataFrame:
    """(host, name, last_checked_at): the source of each web host that was read last."""
    s = r.sources.filter("platform = 'web' and last_checked_at is not null").withColumn("host", link_host(F.col("url")))
    return s.groupBy("host").agg(F.max_by(F.struct("name", "last_checked_at"), F.struct("last_checked_at", "id")).alias("s")).select("host", "s.*")


def source_handles(r: Records, platform: str) -> DataFrame:
    """The last part of the address of each source of a platform, in lower case."""
    return r.sources.filter(F.col("platform") == platform).select(F.lower(F.element_at(F.split(F.rtrim("url", F.lit("/")), "/"), -1)).alias("handle")).distinct()


def names_of(r: Records, ids: DataFrame) -> DataFrame:
    return r.sources.join(ids, r.sources["id"].cast("string") == ids["source_key"], "left_semi").select("name").orderBy("name")


# work-lists of adverts


def known_items(r: Records) -> DataFrame:
    """(source_id, item_id) of all adverts."""
    return r.listings.select("source_id", "item_id").distinct()


def for_quality(r: Records, days: int = 120) -> DataFrame:
    """Adverts that the nightly quarantine judges: active ones of any age, others as long as they count as comparables."""
    ref = F.coalesce("posted_at", "first_seen_at")
    return r.listings.filter(F.col("brand_norm").isNotNull() & F.col("duplicate_of").isNull() & (F.col("is_active") | (ref > ago(r, days=days)))).select("id", "brand_norm", "model_norm", "year", "km", "price_gbp")


def first_seen_since(r: Records, days: int) -> DataFrame:
    """Priced adverts first seen lately, and not posted long before."""
    fresh = F.col("posted_at").isNull() | (F.col("posted_at") > F.col("first_seen_at") - F.expr("interval 4 days"))
    return with_source(r, plain(r)).filter((F.col("first_seen_at") > ago(r, days=days)) & F.col("price_gbp").isNotNull() & F.col("brand_norm").isNotNull() & fresh)


def of_phones(r: Records, phones: DataFrame, limit: int = 30) -> DataFrame:
    """For each phone its adverts that are no copies, active ones first, newest first, at most `limit` of each (a report's length)."""
    w = Window.partitionBy("seller_phone").orderBy(F.desc("is_active"), F.desc("first_seen_at"), "id")
    rows = r.listings.filter("duplicate_of is null").join(phones, "seller_phone", "left_semi")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def stale_active(r: Records, hours: int, limit: int) -> DataFrame:
    """Per source the `limit` active adverts that were looked at longest ago."""
    w = Window.partitionBy("source_id").orderBy("last_seen_at", "id")
    rows = r.listings.filter(F.col("is_active") & F.col("url").isNotNull() & (F.col("last_seen_at") < ago(r, hours=hours)))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def stale_archived(r: Records, days: int, hours: int, limit: int) -> DataFrame:
    """Per source adverts that closed lately for an unknown reason and may have come back, longest unseen first."""
    w = Window.partitionBy("source_id").orderBy("last_seen_at", "id")
    gone = ~F.col("is_active") & (F.col("inactive_reason") == UNKNOWN) & F.col("sold_at").isNull() & F.col("url").isNotNull() & ~has_any(F.col("signals"), *CLOSED_SIGNALS)
    rows = r.listings.filter(gone & (F.col("inactive_at") > ago(r, days=days)) & (F.col("last_seen_at") < ago(r, hours=hours)))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def km_backfill(r: Records, days: int, limit: int = 3) -> DataFrame:
    """Per source the oldest new adverts without mileage and date whose page has not been tried."""
    tried = r.history.filter("field = 'km_deneme'").select(F.col("listing_id").alias("id"))
    rows = r.listings.filter(F.col("is_active") & F.col("duplicate_of").isNull() & F.col("km").isNull() & F.col("posted_at").isNull() & (F.col("first_seen_at") > ago(r, days=days)))
    w = Window.partitionBy("source_id").orderBy("first_seen_at", "id")
    return rows.join(tried, "id", "left_anti").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def priceless_recent(r: Records, hours: int, platform: str = "facebook") -> DataFrame:
    """New social adverts with brand and year whose price is missing or was read from the photo."""
    none = F.col("price_gbp").isNull() & has_any(F.col("signals"), "fiyatsiz") | has_any(F.col("signals"), "foto_fiyat")
    rows = with_source(r, r.listings.filter(F.col("is_active") & none & F.col("duplicate_of").isNull() & F.col("brand_norm").isNotNull() & F.col("year").isNotNull()))
    return rows.filter((F.col("platform") == platform) & (F.col("first_seen_at") > ago(r, hours=hours)))


def priced_recent(r: Records, days: int, limit: int = 200) -> DataFrame:
    """Per source the newest priced adverts, as the sample that its region is judged by."""
    w = Window.partitionBy("source_id").orderBy(F.desc("first_seen_at"), "id")
    rows = r.listings.filter(F.col("price_gbp").isNotNull() & (F.col("first_seen_at") > ago(r, days=days)))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def new_in_group(r: Records, hours: int) -> DataFrame:
    """All adverts of the (brand, model, year) groups in which an advert is new; an unknown model is a group of its own."""
    keys = ["brand_norm", "model_norm", "year"]
    rows = r.listings.filter("brand_norm is not null and year is not null")
    new = rows.filter(F.col("first_seen_at") > ago(r, hours=hours)).select(*[F.col(k).alias(f"n_{k}") for k in keys]).distinct()
    on = (F.col("brand_norm") == F.col("n_brand_norm")) & F.col("model_norm").eqNullSafe(F.col("n_model_norm")) & (F.col("year") == F.col("n_year"))
    return rows.join(new, on, "left_semi")


def twin_candidates(r: Records, window_hours: int, hosts: tuple[str, str], days: int) -> DataFrame:
    """Adverts of two sites with the same car, amount and currency that the other site also has, first seen within the window of each other.

    The window is cut into buckets of its own length: a row meets the rows of three buckets, so the join is by equality."""
    keys = ["brand_norm", "model_norm", "year", "price_amount", "currency"]
    t = with_source(r, r.listings).withColumn("site", link_host(F.col("source_url"))).filter(F.col("site").isin(list(hosts)) & (F.col("first_seen_at") > ago(r, days=days)))
    t = t.dropna(subset=keys)
    at = F.unix_micros("first_seen_at")
    wide = window_hours * 3_600_000_000
    t = t.select("id", "site", "first_seen_at", *keys, at.alias("at"), F.floor(at / wide).alias("bucket"))
    o = t.select(F.col("site").alias("o_site"), F.col("at").alias("o_at"), *keys, F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)])).alias("bucket"))
    got = t.join(o, [*keys, "bucket"]).filter((F.col("o_site") != F.col("site")) & (F.abs(F.col("o_at") - F.col("at")) <= wide))
    return got.select("id", "site", *keys, "first_seen_at").distinct()


def by_link(r: Records, links: DataFrame) -> DataFrame:
    """For each link (link, item_id) the advert of that address, else the one of that number on the same site; active first, last seen first."""
    asked = links.select("link", canonical_link(F.col("link")).alias("canon"), link_host(F.col("link")).alias("host"), F.col("item_id").alias("asked"))
    rows = r.listings.filter("url is not null").select("id", canonical_link(F.col("url")).alias("l_canon"), link_host(F.col("url")).alias("l_host"), "item_id", "is_active", "last_seen_at")
    exact = asked.join(rows, F.col("canon") == F.col("l_canon")).withColumn("exact", F.lit(True))
    number = asked.join(rows, (F.col("host") == F.col("l_host")) & (F.col("asked") == F.col("item_id"))).withColumn("exact", F.col("canon") == F.col("l_canon"))
    best = F.max_by("id", F.struct("exact", "is_active", "last_seen_at", -F.col("id")))
    return exact.unionByName(number).groupBy("link").agg(best.alias("id"))


# evaluations, alerts and votes


def recent_opportunities(r: Records, since: Column, limit: int = 10) -> DataFrame:
    """The newest alerts per advert and tier, with the advert's last market and the owner's last vote."""
    x = reviewable(r, since).groupBy("listing_id", "tier").agg(F.min("sent_at").alias("sent_at"))
    x = x.join(r.listings.select(F.col("id").alias("listing_id"), "price_gbp"), "listing_id").orderBy(F.desc("sent_at"), "listing_id", "tier").limit(limit)
    vote = owner_votes(r).filter(~F.col("action").startswith("audit_")).groupBy("listing_id").agg(F.max_by("action", F.struct("created_at", "id")).alias("feedback"))
    return x.join(last_evaluation(r).select("listing_id", "e_median_gbp"), "listing_id", "left").join(vote, "listing_id", "left")


def current_decisions(r: Records, limit: int = 3) -> DataFrame:
    """Per (brand, model, year) the first adverts by tier and newness with their last decision, and the number of all."""
    keys = ["brand_norm", "model_norm", "year"]
    rows = plain(r).filter(F.col("is_active") & F.col("price_gbp").isNotNull()).dropna(subset=keys)
    rows = rows.join(last_evaluation(r), F.col("id") == F.col("listing_id"))
    order = F.when(F.col("e_tier") == "guclu", 0).when(F.col("e_tier") == "pazarlik", 1).otherwise(2)
    w = Window.partitionBy(*keys)
    got = rows.withColumns({"total": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(order, F.desc("first_seen_at"), "id"))})
    return got.filter(F.col("rank") <= limit).withColumn("method", F.coalesce("e_method", F.lit("A")))


def _seen_or_repriced(r: Records, rows: DataFrame, at: Column) -> DataFrame:
    """rows with price_changed_at, that were first seen or repriced after `at`."""
    rows = rows.join(price_changed(r), rows["id"] == F.col("listing_id"), "left").drop("listing_id")
    return rows.filter((F.col("first_seen_at") > at) | F.coalesce(F.col("price_changed_at") > at, F.lit(False)))


def _judged(r: Records) -> DataFrame:
    """Active plain adverts with source and last evaluation."""
    rows = with_source(r, plain(r).filter("is_active"))
    return rows.join(last_evaluation(r), rows["id"] == F.col("listing_id")).drop("listing_id")


def pending_negotiable(r: Records, chat_id: str, hours: int) -> DataFrame:
    """Adverts for a chat's digest: negotiable ones, strong ones of slower sources, and strong social ones that are not fresh."""
    level, social = F.col("alert_level"), F.col("platform").isin("instagram", "facebook")
    late = (F.col("e_tier") == "guclu") & (level == "yesil") & social & (F.col("posted_at") < ago(r, hours=48))
    fits = ((F.col("e_tier") == "pazarlik") & level.isin("yesil", "sari")) | ((F.col("e_tier") == "guclu") & (level == "sari")) | late
    rows = _judged(r).filter(fits & F.col("e_confidence").isin("yuksek", "orta", "dusuk") & (F.col("e_evaluated_at") > ago(r, hours=hours)))
    rows = rows.filter(F.col("posted_at").isNull() | (F.col("posted_at") > F.col("first_seen_at") - F.expr("interval 4 days")))
    sent = r.alerts.filter((F.col("chat_id") == chat_id) & (F.col("tier") == "pazarlik")).select(F.col("listing_id").alias("id"))
    return _seen_or_repriced(r, rows, ago(r, hours=hours)).join(sent, "id", "left_anti")


def unnotified_strong(r: Records, rules_version: str, days: int) -> DataFrame:
    """Strong adverts of this version of the rules of which no chat knows: neither they nor copies were alerted, nor sent without a record."""
    rows = _judged(r).filter((F.col("e_tier") == "guclu") & (F.col("e_rules_version") == rules_version) & (F.col("e_evaluated_at") > ago(r, days=days)) & (F.col("alert_level") == "yesil"))
    lost = r.state.filter(F.col("key").startswith(UNSAVED)).select(F.split_part(F.substring("key", len(UNSAVED) + 1, 1 << 20), F.lit(":"), F.lit(1)).alias("key_id"))
    rows = _seen_or_repriced(r, rows, ago(r, days=days)).join(alerted(r, SENT_ONCE), "id", "left_anti")
    return rows.join(lost, F.col("id").cast("string") == F.col("key_id"), "left_anti")


def near_misses(r: Records, rules_version: str, days: int, min_comparables: int = 8, skip: tuple[str, ...] = ()) -> DataFrame:
    """Negotiable adverts with enough comparables, none of the reasons to skip, and never alerted."""
    rows = _judged(r).filter((F.col("e_tier") == "pazarlik") & (F.col("e_rules_version") == rules_version) & (F.col("e_comparables_n") >= min_comparables) & (F.col("alert_level") == "yesil"))
    if skip:
        rows = rows.filter(~has_any(F.col("e_reasons"), *skip))
    return _seen_or_repriced(r, rows, ago(r, days=days)).join(alerted(r, SENT_ONCE), "id", "left_anti")


def alerted_votes(r: Records, days: int, since: Column, chat_id: str | None = None) -> DataFrame:
    """Alerted adverts of the last days, by the first tier in REVIEW, with the market at their first alert ever and whether the owner voted."""
    a = reviewable(r, since).filter((F.col("sent_at") > ago(r, days=days)) & ~F.col("kind").eqNullSafe(F.lit(RETRACTED)))
    if chat_id:
        a = a.filter(F.col("chat_id") == chat_id)
    x = a.groupBy(F.col("listing_id").alias("id")).agg(best_tier(F.col("tier")).alias("tier"), F.min("sent_at").alias("sent_at"))
    e = r.evaluations.select(F.col("id").alias("evaluation_id"), "median_gbp")
    first = r.alerts.join(e, "evaluation_id").groupBy(F.col("listing_id").alias("id")).agg(F.min_by("median_gbp", F.struct("sent_at", "evaluation_id")).alias("median_gbp"))
    voted = owner_votes(r).filter(~F.col("action").startswith("audit_")).select(F.col("listing_id").alias("id"), F.lit(True).alias("voted")).distinct()
    rows = x.join(r.listings.select("id", "price_gbp", "is_active", "km"), "id").join(first, "id", "left").join(voted, "id", "left")
    return rows.withColumn("voted", F.coalesce("voted", F.lit(False)))


def vote_queue(r: Records, chat_id: str, since: Column, urgent: DataFrame) -> DataFrame:
    """What the owner has not voted on: adverts alerted to the chat, and old urgent ones (urgent: id) that have no alert row; neither the advert nor
    what it is a copy of has the owner's vote."""
    mine = reviewable(r, since).filter(F.col("chat_id") == chat_id)
    order = F.struct("sent_at", "evaluation_id")
    sent = mine.filter(~F.col("kind").eqNullSafe(F.lit(RETRACTED))).groupBy("listing_id").agg(
        best_tier(F.col("tier")).alias("tier"), F.min("sent_at").alias("sent_at"), F.min_by("price_sent", order).alias("price_sent"), F.min_by("evaluation_id", order).alias("ev_id"))
    old = r.listings.join(urgent, "id", "left_semi").join(mine.select(F.col("listing_id").alias("id")), "id", "left_anti")
    old = old.select(F.col("id").alias("listing_id"), F.lit(URGENT).alias("tier"), F.col("first_seen_at").alias("sent_at"))
    x = sent.unionByName(old, allowMissingColumns=True)
    rows = x.join(r.listings.filter("is_active and price_gbp is not null").select(F.col("id").alias("listing_id"), F.coalesce("duplicate_of", "id").alias("canon"), "price_gbp"), "listing_id")
    votes = owner_votes(r).filter(~F.col("action").startswith("audit_")).select(F.col("listing_id").alias("v_id")).distinct()
    rows = rows.join(votes, F.col("listing_id") == F.col("v_id"), "left_anti").join(votes, F.col("canon") == F.col("v_id"), "left_anti")
    e = r.evaluations.select(F.col("id").alias("ev_id"), F.col("median_gbp").alias("at_alert"))
    before = r.evaluations.select("listing_id", "evaluated_at", F.col("id").alias("b_id"), F.col("median_gbp").alias("before"))
    past = rows.select("listing_id", "sent_at").join(before, "listing_id").filter(F.col("evaluated_at") <= F.col("sent_at") + F.expr("interval 1 hour"))
    past = past.groupBy("listing_id").agg(F.max_by("before", F.struct("evaluated_at", "b_id")).alias("before"))
    rows = rows.withColumn("k_ev", dealt(F.col("ev_id"), F.col("listing_id"))).join(e.withColumnRenamed("ev_id", "k_ev"), "k_ev", "left")
    at_alert = F.when(F.col("ev_id").isNotNull(), F.col("at_alert"))
    return rows.join(past, "listing_id", "left").withColumn("median_gbp", F.coalesce(at_alert, "before"))


def urgent_sent(r: Records, ids: DataFrame, days: int) -> DataFrame:
    """Fingerprints of adverts (id) handled as urgent in the last days: price and instant of their first urgent alert, else of the advert."""
    a = r.alerts.filter(F.col("tier") == URGENT).groupBy(F.col("listing_id").alias("id")).agg(F.min_by(F.struct("price_sent", "sent_at"), F.struct("sent_at", "evaluation_id")).alias("a"))
    rows = r.listings.join(ids, "id", "left_semi").join(a, "id", "left")
    got = rows.select("id", "brand_norm", "model_norm", "year", "seller_phone", F.coalesce("a.price_sent", "price_gbp").alias("price_gbp"), F.coalesce("a.sent_at", "first_seen_at").alias("sent_at"))
    return got.filter(F.col("sent_at") > ago(r, days=days))


def twins(r: Records, days: int = 7, limit: int = 5) -> DataFrame:
    """For each active plain advert the same car elsewhere: linked as a copy, or alike in model, year, price, mileage and first sight. Linked pairs
    and likely pairs are two joins by equality; the likely ones are bucketed by the window of days."""
    cols = ["id", "source_id", "brand_norm", "model_norm", "year", "km", "price_gbp", "price_amount", "duplicate_of", "first_seen_at"]
    left = plain(r).filter("is_active and price_gbp is not null").select(*cols)
    other = with_source(r, r.listings.filter("is_active")).filter(~F.col("alert_level").eqNullSafe(F.lit(SHADOW)))
    other = other.select(*[F.col(c).alias(f"t_{c}") for c in cols])
    linked = left.join(other, F.col("t_duplicate_of") == F.col("id")).withColumn("linked", F.lit(True))
    wide = days * 86_400_000_000
    keyed = left.dropna(subset=["brand_norm", "model_norm", "year"]).withColumn("bucket", F.floor(F.unix_micros("first_seen_at") / wide))
    near = other.filter("t_duplicate_of is null").withColumn("t_bucket", F.explode(F.array(*[F.floor(F.unix_micros("t_first_seen_at") / wide) + k for k in (-1, 0, 1)])))
    on = [F.col(c) == F.col(f"t_{c}") for c in ("brand_norm", "model_norm", "year", "bucket")]
    price = (F.abs(F.col("t_price_gbp") - F.col("price_gbp")) <= 0.03 * F.col("price_gbp")) | (F.abs(F.col("t_price_amount") - F.col("price_amount")) <= 0.03 * F.col("price_amount"))
    km = F.col("t_km").isNull() | F.col("km").isNull() | (F.abs(F.col("t_km") - F.col("km")) <= F.greatest(F.lit(500.0), 0.03 * F.col("km")))
    time = F.abs(F.unix_micros("t_first_seen_at") - F.unix_micros("first_seen_at")) <= wide
    alike = keyed.join(near, on).filter(F.coalesce(price, F.lit(False)) & km & time & (F.col("id") != F.col("t_id"))).drop("bucket", "t_bucket").withColumn("linked", F.lit(False))
    pairs = linked.unionByName(alike).filter(F.col("source_id") != F.col("t_source_id"))
    sent = r.alerts.filter(F.col("tier").isin(SENT_ONCE)).groupBy(F.col("listing_id").alias("t_id")).agg(F.min("sent_at").alias("alerted_at"))
    w = Window.partitionBy("id").orderBy("t_first_seen_at", "t_id")
    got = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).join(sent, "t_id", "left")
    return got.select("id", "t_id", "rank", "linked", "alerted_at")


def resurfaced(r: Records, host: str, gap_minutes: int = 10) -> DataFrame:
    """Undated adverts of a site whose number is below a number that an earlier round had already seen. The running maximum of the numbers goes by
    day: over the days before (one row each), and within the day up to the gap before the advert."""
    day, gap = 86_400_000_000, gap_minutes * 60_000_000
    rows = with_source(r, r.listings).filter(link_host(F.col("source_url")) == host)
    number = F.regexp_extract("item_id", "^[0-9]{1,15}", 0).try_cast("bigint")
    rows = rows.select("id", "posted_at", F.unix_micros("first_seen_at").alias("at"), number.alias("number"))
    seen = rows.groupBy("at").agg(F.max("number").alias("m")).select("at", "m", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("number"))
    asked = rows.filter("posted_at is null").select((F.col("at") - gap).alias("at"), F.lit(None).cast("long").alias("m"), "id", "number")
    both = seen.unionByName(asked).withColumn("day", F.floor(F.col("at") / day))
    days = both.groupBy("day").agg(F.max("m").alias("m")).withColumn("earlier", F.max("m").over(Window.orderBy("day").rangeBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("day").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    got = both.withColumn("today", F.max("m").over(within)).filter("id is not null").join(days.select("day", "earlier"), "day")
    return got.withColumn("before", F.greatest("today", "earlier")).filter(F.col("before") > F.col("number")).select("id", "number", "before")


# counts


def recent_counts(r: Records, days: int = 7) -> DataFrame:
    """Adverts first seen in the last days per source."""
    return r.listings.filter(F.col("first_seen_at") > ago(r, days=days)).groupBy("source_id").agg(F.count("*").alias("n"))


def pass_counts(r: Records, days: int) -> DataFrame:
    """Adverts that the owner passed on in the last days per (brand, model)."""
    f = owner_votes(r).filter((F.col("action") == "pas") & (F.col("created_at") > ago(r, days=days))).select(F.col("listing_id").alias("id"))
    return r.listings.dropna(subset=["brand_norm", "model_norm"]).join(f, "id", "left_semi").groupBy("brand_norm", "model_norm").agg(F.count("*").alias("n"))


def dealt(key: Column, by: Column) -> Column:
    """A key to join by in which nulls, that match nothing, have a text of their own each: else a left join sends all of them to one task."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\0"), by.cast("string")))


def seller_counts(r: Records, prefix: str = "site:") -> DataFrame:
    """Per advert with a known seller the other active adverts of that seller: the same phone, or the same account of the site. Counted by groups
    and inclusion and exclusion, without pairs; the advert itself and what it is a copy of do not count."""
    own = F.when(F.col("seller_handle").startswith(prefix) & (F.length("seller_handle") > len(prefix)), F.col("seller_handle"))
    rows = r.listings.select("id", "duplicate_of", "source_id", "seller_phone", own.alias("handle"), (F.col("is_active") & F.col("duplicate_of").isNull()).alias("live"))
    live = rows.filter("live")
    phone, account = F.col("seller_phone"), F.when(F.col("source_id").isNotNull(), F.col("handle"))
    both = F.when(phone.isNotNull() & account.isNotNull(), phone)
    by_phone = live.filter(phone.isNotNull()).groupBy(phone.alias("k_phone")).agg(F.count("*").alias("n_phone"))
    by_handle = live.filter(account.isNotNull()).groupBy("source_id", F.col("handle").alias("k_handle")).agg(F.count("*").alias("n_handle"))
    by_both = live.filter(both.isNotNull()).groupBy("source_id", F.col("handle").alias("k_handle"), both.alias("k_both")).agg(F.count("*").alias("n_both"))
    of_id = F.col("id")
    got = rows.filter("seller_phone is not null or handle is not null").withColumns(
        {"k_phone": dealt(phone, of_id), "k_handle": dealt(account, of_id), "k_both": dealt(both, of_id), "k_copied": dealt(F.col("duplicate_of"), of_id)})
    got = got.join(by_phone, "k_phone", "left").join(by_handle, ["source_id", "k_handle"], "left").join(by_both, ["source_id", "k_handle", "k_both"], "left")
    canon = live.select(F.col("id").cast("string").alias("k_copied"), F.col("seller_phone").alias("c_phone"), F.col("handle").alias("c_handle"), F.col("source_id").alias("c_source"))
    got = got.join(canon, "k_copied", "left")
    same = F.coalesce(F.col("c_phone") == F.col("seller_phone"), F.lit(False)) | F.coalesce((F.col("c_handle") == F.col("handle")) & (F.col("c_source") == F.col("source_id")), F.lit(False))
    some = lambda known, n: F.when(known.isNotNull(), F.coalesce(n, F.lit(0))).otherwise(0)
    n = some(phone, F.col("n_phone")) + some(account, F.col("n_handle")) - some(both, F.col("n_both")) - (F.col("live") & (phone.isNotNull() | account.isNotNull())).cast("int") - (same & F.col("duplicate_of").isNotNull()).cast("int")
    return got.select("id", n.alias("n"))


def social_similar(r: Records, days: int) -> DataFrame:
    """Per (brand, model, year) the active social adverts within a year of it, first seen lately: each row is counted for three years."""
    rows = with_source(r, r.listings.filter("is_active and duplicate_of is null and brand_norm is not null and year is not null"))
    rows = rows.filter((F.col("platform") == "facebook") & (F.col("first_seen_at") > ago(r, days=days)))
    return rows.select("brand_norm", "model_norm", F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1)).alias("year")).groupBy("brand_norm", "model_norm", "year").agg(F.count("*").alias("n"))


def alerts_sent(r: Records, hours: int) -> DataFrame:
    """Distinct adverts alerted in the last hours per tier and kind."""
    return r.alerts.filter(F.col("sent_at") > ago(r, hours=hours)).groupBy("tier", "kind").agg(F.count_distinct("listing_id").alias("n"))


def vote_count(r: Records) -> DataFrame:
    return owner_votes(r).filter(F.col("action").isin(VOTES)).agg(F.count("*").alias("n"))


def week_alerts(r: Records, days: int, since: Column) -> DataFrame:
    a = reviewable(r, since).filter(F.col("tier").isin(*SENT_ONCE, "pazarlik") & (F.col("sent_at") > ago(r, days=days)))
    return a.groupBy("tier").agg(F.count_distinct("listing_id").alias("n"))


def week_feedback(r: Records, days: int) -> DataFrame:
    f = r.feedback.filter(~F.col("action").startswith("audit_") & (F.col("created_at") > ago(r, days=days)))
    return f.groupBy("action").agg(F.count("*").alias("n"))


def canonical_counts(r: Records) -> DataFrame:
    """Per source its copies, and how many of them are copies of an advert of another source."""
    c = r.listings.select(F.col("id").alias("duplicate_of"), F.col("source_id").alias("c_source"))
    rows = r.listings.filter("duplicate_of is not null").join(c, "duplicate_of", "left")
    return rows.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("c_source").isNotNull() & (F.col("c_source") != F.col("source_id"))).alias("elsewhere"))


def tier_status(r: Records) -> DataFrame:
    """Active adverts per tier of their last evaluation; '-' where there is none."""
    rows = r.listings.filter("is_active").join(last_evaluation(r), F.col("id") == F.col("listing_id"), "left")
    return rows.groupBy(F.coalesce("e_tier", F.lit("-")).alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("e_comparables_n") >= 8).alias("rich"))


# state


def price_history(r: Records) -> DataFrame:
    """The price changes of each advert in order."""
    w = Window.partitionBy("listing_id").orderBy("changed_at", "old_value", "new_value")
    return r.history.filter("field = 'price_gbp'").select("listing_id", "changed_at", "old_value", "new_value", F.row_number().over(w).alias("step"))


def state_with_prefix(r: Records, prefix: str) -> DataFrame:
    return r.state.filter(F.col("key").startswith(prefix)).select(F.substring("key", len(prefix) + 1, 1 << 20).alias("rest"), "value")


def marks_since(r: Records, prefix: str, days: int) -> DataFrame:
    """The rest of the keys alert:<prefix> that were set in the last days; values that are no instant do not count."""
    at = F.when(F.col("value").rlike("^[0-9]{4}-"), F.col("value").try_cast("timestamp"))
    return state_with_prefix(r, f"alert:{prefix}").filter(at > ago(r, days=days)).select("rest")


def recently_alerted(r: Records, hours: int) -> DataFrame:
    """(key, recent) of the owner's alarms: whether each was sent within the hours."""
    at = F.when(F.col("value") != "", F.col("value").try_cast("timestamp"))
    return state_with_prefix(r, "alert:").select(F.col("rest").alias("key"), F.coalesce(at > ago(r, hours=hours), F.lit(False)).alias("recent"))


def approved(r: Records) -> DataFrame:
    return r.subscribers.filter("status = 'onayli'")


def alert_exists(r: Records, asked: DataFrame, tier: str) -> DataFrame:
    """asked (id, chat_id) with hit: the advert or a copy of it went to the chat in a tier that blocks this one, or went without a record."""
    sent = alerted(r, blocking_tiers(tier), "chat_id").withColumn("sent", F.lit(True))
    out = asked.join(sent, ["id", "chat_id"], "left")
    if tier in SENT_ONCE:
        lost = r.state.select(F.col("key").alias("lost"))
        out = out.join(lost, unsaved_key(F.col("id"), F.col("chat_id")) == F.col("lost"), "left")
    else:
        out = out.withColumn("lost", F.lit(None))
    return out.select("id", "chat_id", (F.col("sent").isNotNull() | F.col("lost").isNotNull()).alias("hit"))
