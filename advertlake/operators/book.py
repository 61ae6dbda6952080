"""The price book: weighted ridge curves from sums, book rows, quarantine of odd rows, and greedy duplicate marking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertlake.functions.rules import effective_km
from advertlake.settings import Settings
from advertlake.sources.shared import persisted

KEYS = ["brand_norm", "model_norm"]


def closed_form(points: DataFrame, s: Settings) -> DataFrame:
    """Per model y = my + b_age * (a - ma) + b_km * (k - mk), weighted and centred ridge in closed form from nine sums: one aggregate with partial sums
    before the shuffle. A mileage slope above the limit is refitted with the fixed slope. points carry year, y, a, k and weight w."""
    cols = {"sw": F.col("w")} | {n: F.col("w") * e for n, e in {
        "sa": F.col("a"), "sk": F.col("k"), "sy": F.col("y"), "saa": F.col("a") * F.col("a"), "skk": F.col("k") * F.col("k"),
        "sak": F.col("a") * F.col("k"), "say": F.col("a") * F.col("y"), "sky": F.col("k") * F.col("y")}.items()}
    g = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_distinct("year").alias("years"), *[F.sum(e).alias(n) for n, e in cols.items()])
    g = g.filter((F.col("n") >= s.curve_min_rows) & (F.col("years") >= s.curve_min_years))
    g = g.selectExpr(*KEYS, "n", "sa / sw as ma", "sk / sw as mk", "sy / sw as my", f"saa - sa * sa / sw + {s.ridge_lambda}D as vaa",
                     f"skk - sk * sk / sw + {s.ridge_lambda}D as vkk", "sak - sa * sk / sw as vak", "say - sa * sy / sw as vay", "sky - sk * sy / sw as vky")
    free = g.withColumn("det", F.expr("vaa * vkk - vak * vak")).withColumns({"fa": F.expr("(vay * vkk - vky * vak) / det"), "fk": F.expr("(vky * vaa - vay * vak) / det")})
    fixed = F.col("fk") > s.km_slope_limit
    b_km = F.when(fixed, s.km_slope_fixed).otherwise(F.col("fk"))
    b_age = F.when(fixed, (F.col("vay") - s.km_slope_fixed * F.col("vak")) / F.col("vaa")).otherwise(F.col("fa"))
    return free.select(*KEYS, "n", "ma", "mk", "my", b_age.alias("b_age"), b_km.alias("b_km"), fixed.alias("km_fixed"))


def ridge_curves(rows: DataFrame, s: Settings) -> DataFrame:
    """closed_form() of ln(price) over age and km / 10000; a seller's rows of a model weigh max_per_seller together. rows carry price_gbp, year, km and seller."""
    per_seller = Window.partitionBy(*KEYS, "seller")
    x = rows.filter("price_gbp > 0 and year is not null and km is not null")
    x = x.select(*KEYS, "year", F.ln("price_gbp").alias("y"), (s.as_of.year - F.col("year")).cast("double").alias("a"), (F.col("km") / 10000).alias("k"),
                 F.least(F.lit(1.0), s.max_per_seller / F.count("*").over(per_seller)).alias("w"))
    return closed_form(x, s).select(*KEYS, "n", "b_age", "b_km", F.expr("my - b_age * ma - b_km * mk").alias("intercept"), "km_fixed")


def next_status(prev: DataFrame, new: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """Tonight's book after yesterday's: a change beyond the limit keeps the old value as suspect, until the same candidate (within the
    confirming share) has come book_confirm_nights nights running. An old value of 0 or less is replaced at once.
    prev: keys, value, candidate, nights (candidates only of suspect rows); new: keys, value, n, sellers."""
    p = prev.select(*keys, F.col("value").alias("old"), "candidate", F.col("nights").alias("waited"))
    d = new.join(p, keys, "left")
    jump = F.coalesce((F.col("old") > 0) & (F.abs(F.col("value") - F.col("old")) > s.book_change_limit * F.col("old")), F.lit(False))
    again = F.coalesce((F.col("candidate") != 0) & (F.abs(F.col("value") - F.col("candidate")) <= s.book_confirm_limit * F.abs("candidate")), F.lit(False))
    nights = F.when(again, F.coalesce("waited", F.lit(0)) + 1).otherwise(1)
    held = jump & ~(again & (nights >= s.book_confirm_nights))
    thin = (F.col("n") < s.book_settled_min_n) | (F.col("sellers") < s.book_settled_min_sellers)
    return d.select(
        *keys, F.when(held, F.col("old")).otherwise(F.col("value")).alias("value"), F.when(held, F.col("value")).alias("candidate"),
        F.when(held, nights).otherwise(0).alias("nights"), F.when(held, "supheli").when(thin, "ince").otherwise("oturmus").alias("status"),
    )


def row_reason(s: Settings) -> Column:
    """Why a row is odd by itself, else null: placeholder price, model year, mileage; the first that holds."""
    age = F.greatest(F.lit(1), s.as_of.year - F.col("year"))
    km = (F.col("km") > 600_000) | ((age >= 2) & (F.col("km") / age > 80_000))
    return F.when(F.col("price_gbp") <= 10, "fiyat_yer_tutucu").when(~F.col("year").between(1970, s.as_of.year + 1), "yil_supheli").when(km, "km_supheli")


def _middle(sound: DataFrame, peers: int) -> DataFrame:
    """(model, year, n, a, b, c): of the prices of a model within two years of each year their number, where it is above peers, and the values at places
    n // 2 to n // 2 + 2. Prices are counted in cells by their logarithm, about half the square root of a model's rows; only counts are repeated for
    the five years, and only the distinct prices of the cells that hold the three places are sorted."""
    x = sound.select(*KEYS, "year", "price_gbp")
    finite = F.col("price_gbp") < float("inf")
    ln = F.ln(F.when(finite, F.col("price_gbp")))
    cells = F.greatest(F.lit(8), F.floor(F.sqrt(F.count("*")) / 2)).cast("int")
    ends = persisted(x.groupBy(*KEYS).agg(F.min(ln).alias("least"), F.max(ln).alias("most"), cells.alias("cells")))
    wide = F.col("most") - F.col("least")
    cell = F.when(~finite, F.col("cells")).when(wide > 0, F.floor((ln - F.col("least")) / wide * F.col("cells"))).otherwise(0).cast("int")
    placed = x.join(ends, KEYS).select(*KEYS, "year", "price_gbp", cell.alias("cell"))
    around = F.explode(F.sequence(F.col("year") - 2, F.col("year") + 2))
    counted = placed.groupBy(*KEYS, "year", "cell").agg(F.count("*").alias("m"))
    near = counted.select(*KEYS, around.alias("target"), "cell", "m").groupBy(*KEYS, "target", "cell").agg(F.sum("m").alias("m"))
    w = Window.partitionBy(*KEYS, "target")
    near = near.withColumns({"upto": F.sum("m").over(w.orderBy("cell")), "n": F.sum("m").over(w)}).withColumn("lo", F.floor(F.col("n") / 2))
    held = near.filter((F.col("n") > peers) & (F.col("upto") >= F.col("lo")) & (F.col("upto") - F.col("m") < F.col("lo") + 2))
    held = persisted(held.select(*KEYS, "target", "cell", "n", "lo", (F.col("upto") - F.col("m")).alias("start")))
    wanted = held.select("*", F.explode(F.sequence(F.col("target") - 2, F.col("target") + 2)).alias("year"))
    inside = placed.join(wanted, [*KEYS, "year", "cell"]).groupBy(*KEYS, "target", "cell", "n", "lo", "start", "price_gbp").agg(F.count("*").alias("m"))
    inside = inside.withColumn("upto", F.col("start") + F.sum("m").over(Window.partitionBy(*KEYS, "target", "cell").orderBy("price_gbp")))
    at = lambda k: F.max(F.when((F.col("upto") >= F.col("lo") + k) & (F.col("upto") - F.col("m") < F.col("lo") + k), F.col("price_gbp")))
    return inside.groupBy(*KEYS, F.col("target").alias("year")).agg(F.first("n").alias("n"), at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))


def quarantine(rows: DataFrame, s: Settings, low: float = 0.40, high: float = 2.50, peers: int = 8) -> DataFrame:
    """(id, reason, peers, mid): rows odd by themselves, and rows below low or above high times the median of the other rows of their model within
    two years, where there are enough of those. The three middle values of each year's neighbourhood come from counts; which two of them are the
    middle without the row follows from the row's own price."""
    judged = rows.withColumn("reason", row_reason(s))
    odd = judged.filter("reason is not null").select("id", "reason", F.lit(None).cast("long").alias("peers"), F.lit(None).cast("double").alias("mid"))
    sound = judged.filter("reason is null and price_gbp > 0 and year is not null and brand_norm is not null and model_norm is not null")
    mids = persisted(_middle(sound, peers))
    x = F.col("price_gbp")
    first, second = F.when(x <= F.col("a"), F.col("b")).otherwise(F.col("a")), F.when(x <= F.col("b"), F.col("c")).otherwise(F.col("b"))
    got = sound.join(mids, [*KEYS, "year"]).withColumn("mid", F.when(F.col("n") % 2 == 0, first).otherwise((first + second) / 2))
    reason = F.when(x < F.col("mid") * low, "fiyat_ucuz_supheli").when(x > F.col("mid") * high, "fiyat_pahali_supheli")
    return odd.unionByName(got.select("id", reason.alias("reason"), (F.col("n") - 1).alias("peers"), "mid").filter("reason is not null"))


KM_STEP, KM_SHARE, KM_TURN = 500, 0.02, 25_000
PRICE_SHARE, ROUND_PRICE_SHARE, ROUND_KM = 0.15, 0.03, 1000
_ATTRS = [*KEYS, "year", "km", "price_gbp", "seller", "active"]


def _log_cell(x: Column, share: float) -> Column:
    """Cells so wide that two values within a share of the larger one lie in the same or in neighbouring cells."""
    return F.floor(F.ln(x) / (-math.log(1 - share) * 1.0001)).cast("long")


def _cells() -> tuple[Column, Column]:
    """(own, reach) of a row: the cells that it lies in, and those in which the rows lie that it may match. Kinds: near mileage and same seller; near mileage
    and near price, apart for two round mileages; same seller and near price, for unknown mileages."""
    known, priced, sold_by = F.col("km") != 0, F.col("price_gbp") != 0, F.col("seller") != ""
    km = F.when(F.col("km") <= KM_TURN, F.floor(F.col("km") / KM_STEP)).otherwise(1000 + _log_cell(F.col("km") / KM_TURN, KM_SHARE))
    km = F.when(km >= 1000, km - 1000 + KM_TURN // KM_STEP).otherwise(km).cast("long")
    even = F.col("km") % ROUND_KM == 0
    wide, tight = _log_cell(F.col("price_gbp"), PRICE_SHARE), _log_cell(F.col("price_gbp"), ROUND_PRICE_SHARE)
    group = [F.col(c) for c in (*KEYS, "year")]

    def cell(kind: str, *at: Column) -> Column:
        return F.xxhash64(F.lit(kind), *group, *at)

    around = [F.lit(k).cast("long") for k in (-1, 0, 1)]
    by_seller, by_price = known & sold_by, known & priced & F.col("model_norm").isNotNull()
    own = [F.when(by_seller, cell("ks", km, F.col("seller"))), F.when(sold_by & priced, cell("sp", F.col("seller"), wide))]
    own += [F.when(by_price & even, cell("kr", km, tight)), F.when(by_price & even, cell("ke", km, wide)), F.when(by_price & ~even, cell("kn", km, wide))]
    reach = [F.when(by_seller, cell("ks", km + i, F.col("seller"))) for i in around] + [F.when(sold_by & priced, cell("sp", F.col("seller"), wide + i)) for i in around]
    for i in around:
        reach += [F.when(by_price & even, cell("kr", km + i, tight + j)) for j in around]
        reach += [F.when(by_price, cell("kn", km + i, wide + j)) for j in around] + [F.when(by_price & ~even, cell("ke", km + i, wide + j)) for j in around]
    return F.array_compact(F.array(*own)), F.array_compact(F.array(*reach))


def _same_car() -> Column:
    """Whether the head (h_ columns) is surely the row's car and may stand for it."""
    h = {c: F.col(f"h_{c}") for c in _ATTRS}
    same = F.col("brand_norm").eqNullSafe(h["brand_norm"]) & F.col("model_norm").eqNullSafe(h["model_norm"]) & (F.col("year") == h["year"])
    ours = (F.col("seller") != "") & (F.col("seller") == h["seller"])
    both = (F.col("km") != 0) & (h["km"] != 0)
    near = F.abs(F.col("km") - h["km"]) <= F.greatest(F.lit(float(KM_STEP)), KM_SHARE * F.greatest(F.col("km"), h["km"]))
    even = (F.col("km") % ROUND_KM == 0) & (h["km"] % ROUND_KM == 0)
    share = F.when(both & even, ROUND_PRICE_SHARE).otherwise(PRICE_SHARE)
    close = (F.col("price_gbp") != 0) & (h["price_gbp"] != 0) & (F.abs(F.col("price_gbp") - h["price_gbp"]) <= share * F.greatest(F.col("price_gbp"), h["price_gbp"]))
    return same & (~F.col("active") | h["active"]) & F.when(both, near & (ours | (close & F.col("model_norm").isNotNull()))).otherwise(ours & close)


def greedy_duplicates(rows: DataFrame, s: Settings = Settings(), most: int = 500_000) -> DataFrame:
    """(id, canonical) of every row: the first earlier advert of the same model and year that is itself canonical and surely the same car, else
    the row itself. Order (first_seen_at, unknown last, then id) decides: A~B and B~C do not join C to A unless C matches A. With both mileages
    believed (effective_km), they must be within 500 or 2 %, and the seller the same or the price within 15 % (3 % where both mileages are round);
    otherwise the same seller and a price within 15 %. Without a model only the same seller counts, without a brand or year nothing does. seller
    (the contact) and is_active may be missing; an active advert is a copy of active ones only.

    The adverts of a model and year are shuffled once and walked in numpy (first_heads), where a block of rows meets only heads of near mileage and price or
    of its seller. Of models and years with more than `most` adverts, which need not fit a task, the heads are found by joins in rounds (_in_rounds)."""
    km = F.coalesce(effective_km(F.col("km"), F.col("year"), s.as_of).cast("double"), F.lit(0.0))
    seller = F.coalesce(F.col("seller").cast("string"), F.lit("")) if "seller" in rows.columns else F.lit("")
    active = F.coalesce("is_active", F.lit(False)) if "is_active" in rows.columns else F.lit(False)
    base = rows.select("id", *KEYS, "year", km.alias("km"), F.coalesce(F.col("price_gbp").cast("double"), F.lit(0.0)).alias("price_gbp"), seller.alias("seller"), active.alias("active"),
                       F.struct(F.col("first_seen_at").isNull().alias("none"), F.col("first_seen_at").alias("at"), F.col("id").alias("id")).alias("o"))
    sold_by, priced = F.col("seller") != "", F.col("price_gbp") != 0
    can = F.col("brand_norm").isNotNull() & F.col("year").isNotNull() & F.when(F.col("km") != 0, sold_by | (priced & F.col("model_norm").isNotNull())).otherwise(sold_by & priced)
    base = persisted(base.withColumn("can", can))
    group = [*KEYS, "year"]
    large = base.filter("can").groupBy(*group).count().filter(F.col("count") > most).select(*group, F.lit(True).alias("large"))
    large = large.sparkSession.createDataFrame(large.collect(), large.schema)  # at most one row per `most` adverts
    alike = [base[c].eqNullSafe(large[c]) for c in group]
    marked = base.join(F.broadcast(large), alike[0] & alike[1] & alike[2], "left").select(*[base[c] for c in base.columns], F.coalesce("large", F.lit(False)).alias("large"))
    walked = marked.filter("can and not large").select("id", *_ATTRS, F.col("o.none").alias("none"), F.col("o.at").alias("at"))
    kind = base.schema["id"].dataType.simpleString()
    out = walked.groupBy(*group).applyInArrow(first_heads, f"id {kind}, canonical {kind}").unionByName(base.filter("not can").select("id", F.col("id").alias("canonical")))
    return out if large.isEmpty() else out.unionByName(_in_rounds(marked.filter("can and large").drop("large")))


BLOCK, FAR = 2048, 1 << 20


def first_heads(t: pa.Table) -> pa.Table:
    """(id, canonical) of the adverts of one model and year, by the sequential rule. A block of rows meets the heads so far, then what is left of it itself.
    Heads lie by (mileage cell, log price) and by (seller, mileage cell): heads do not match each other, so there are few in the reach of a row."""
    t = t.sort_by([("none", "ascending"), ("at", "ascending"), ("id", "ascending")])
    km, price, active = (t[c].to_numpy(zero_copy_only=False) for c in ("km", "price_gbp", "active"))
    sellers = pc.dictionary_encode(t["seller"].combine_chunks())
    seller, none = sellers.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.index(sellers.dictionary, "").as_py()
    model, n = t["model_norm"][0].is_valid, len(km)
    cell = np.where(km <= KM_TURN, np.floor(km / KM_STEP), KM_TURN // KM_STEP + np.floor(np.log(np.maximum(km, 1) / KM_TURN) / (-math.log(1 - KM_SHARE) * 1.0001)))
    cell = np.where(km == 0, FAR - 2, cell).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_price = np.where(price > 0, np.log(price), np.nan)
    spot, shop, wide = cell * 2048.0 + log_price, seller * FAR + cell, -math.log(1 - PRICE_SHARE) + 1e-6
    priced = (km != 0) & (price > 0) & model
    first, even = np.arange(n), km % ROUND_KM == 0

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = (km[i] != 0) & (km[j] != 0)
        near = np.abs(km[i] - km[j]) <= np.maximum(KM_STEP, KM_SHARE * np.maximum(km[i], km[j]))
        ours = (seller[i] == seller[j]) & (seller[i] != none)
        share = np.where(both & even[i] & even[j], ROUND_PRICE_SHARE, PRICE_SHARE)
        close = (price[i] != 0) & (price[j] != 0) & (np.abs(price[i] - price[j]) <= share * np.maximum(price[i], price[j]))
        return (~active[i] | active[j]) & np.where(both, near & (ours | (close & model)), ours & close)

    def met(rows: np.ndarray, by_spot: np.ndarray, by_shop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, head) that match, among the heads within reach."""
        some, sold = rows[priced[rows]], rows[seller[rows] != none]
        known, bare = sold[km[sold] != 0], sold[km[sold] == 0]
        spots, shops = spot[by_spot], shop[by_shop]
        reach = [(some, by_spot, np.searchsorted(spots, spot[some] + 2048.0 * c - wide), np.searchsorted(spots, spot[some] + 2048.0 * c + wide, "right")) for c in (-1, 0, 1)]
        reach += [(known, by_shop, np.searchsorted(shops, shop[known] - 1), np.searchsorted(shops, shop[known] + 1, "right"))]
        reach += [(known, by_shop, np.searchsorted(shops, seller[known] * FAR + FAR - 2), np.searchsorted(shops, seller[known] * FAR + FAR - 1))]
        reach += [(bare, by_shop, np.searchsorted(shops, seller[bare] * FAR), np.searchsorted(shops, seller[bare] * FAR + FAR - 1))]
        found = []
        for r, heads, lo, hi in reach:
            many = hi - lo
            i = np.repeat(r, many)
            j = heads[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            ok = (j < i) & same(i, j)
            found.append((i[ok], j[ok]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def placed(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = heads[priced[heads]]
        return own[np.argsort(spot[own], kind="stable")], heads[np.argsort(shop[heads], kind="stable")]

    heads = np.zeros(0, np.int64)
    a, step = 0, 64  # the first rows have few heads to meet, and meet each other
    while a < n:
        rows, step = np.arange(a, min(n, a + step)), min(BLOCK, 2 * step)
        a += len(rows)
        i, j = met(rows, *placed(heads))
        np.minimum.at(first, i, j)
        left = rows[first[rows] == rows]
        i, j = met(left, *placed(left))
        new = dict.fromkeys(left.tolist(), True)
        order = np.lexsort((j, i))  # in the rows' order; the first of a row's earlier heads is its head
        for r, h in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if new[h] and new[r]:
                first[r], new[r] = h, False
        heads = np.concatenate([heads, [r for r in left.tolist() if new[r]]]).astype(np.int64)
    return pa.table({"id": t["id"], "canonical": t["id"].take(pa.array(first))})


def _in_rounds(base: DataFrame) -> DataFrame:
    """(id, canonical) by joins only, for models and years of any size. Rows of equal attributes are one. Heads are found in rounds: rows lie in cells of
    mileage, price and seller, wide enough that matches lie in neighbouring cells; the earliest undecided row of all cells that it reaches is a head, for no
    earlier row can match it, and undecided rows that match a new head are copies. So rows meet heads only, and no pairs of a model are made. In the end
    every copy gets the first head that it matches."""
    own, reach = _cells()
    kinds = persisted(base.filter("can").groupBy(*_ATTRS).agg(F.min("o").alias("o")).withColumns({"own": own, "reach": reach}))
    left, heads = kinds, None

    def met(some: DataFrame, by: DataFrame) -> DataFrame:
        """Rows of `some` with the heads that they match, by their order."""
        h = by.select(*[F.col(c).alias(f"h_{c}") for c in _ATTRS], F.col("o").alias("h"), F.explode("reach").alias("cell"))
        return some.select(*_ATTRS, "o", F.explode("own").alias("cell")).join(h, "cell").filter((F.col("h") < F.col("o")) & _same_car())

    while not left.isEmpty():
        least = left.select("o", F.explode("reach").alias("cell")).groupBy("cell").agg(F.min("o").alias("m"))
        first = left.select("o", F.explode("own").alias("cell")).join(least, "cell").groupBy("o").agg(F.min("m").alias("m")).filter("m = o").select("o")
        new = persisted(left.join(first, "o", "left_semi"))
        heads = new if heads is None else heads.unionByName(new)
        done = met(left, new).select("o").unionByName(new.select("o")).distinct()
        left = persisted(left.join(done, "o", "left_anti"))
    if heads is None:
        return base.select("id", F.col("id").alias("canonical"))
    copies = met(kinds.join(heads.select("o"), "o", "left_anti"), heads).groupBy("o").agg(F.min("h").alias("h"))
    found = kinds.select(*_ATTRS, F.col("o").alias("rep")).join(copies.withColumnRenamed("o", "rep"), "rep", "left")
    same = [base[c].eqNullSafe(found[c]) for c in _ATTRS]
    got = base.join(found, same[0] & same[1] & same[2] & same[3] & same[4] & same[5] & same[6], "left").select(base["id"], "can", "rep", "h")
    return got.select("id", F.when(F.col("can"), F.coalesce(F.col("h.id"), F.col("rep.id"))).otherwise(F.col("id")).alias("canonical"))
