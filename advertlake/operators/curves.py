"""Robust price curves of models and the estimates that they give for single adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertlake.functions.rules import effective_km
from advertlake.operators.book import KEYS, closed_form, next_status
from advertlake.operators.market import trimmed, usable_pool
from advertlake.settings import Settings
from advertlake.sources.shared import persisted

# fixed values: outliers lie beyond so many robust deviations; the mileage slope of a prediction is at most this
ROBUST_K, KM_SLOPE_FLOOR = 2.5, -0.005
# fixed values: slopes of age and mileage where a model has no curve
AGE_SLOPE, KM_SLOPE = -0.08, -0.03


def curve_points(rows: DataFrame, s: Settings, weighted: bool = True) -> DataFrame:
    """Rows that a curve may use: not left-hand drive, price, year and believable mileage known; weight min(1, cap / rows of the seller), or 1. The
    sellers' row counts come from an aggregate and are joined back, so that a hot seller is no window in one task."""
    m = rows.groupBy(*KEYS, "seller").agg(F.count("*").alias("m"))
    x = rows.withColumn("km", effective_km(F.col("km"), F.col("year"), s.as_of)).join(m, [*KEYS, "seller"])
    x = x.filter((F.col("price_gbp") > 0) & F.col("year").isNotNull() & F.col("km").isNotNull() & ~F.col("steering").eqNullSafe("LHD"))
    return x.select(*KEYS, "id", "seller", "year", F.ln("price_gbp").alias("y"), (s.as_of.year - F.col("year")).cast("double").alias("a"), (F.col("km") / 10000).alias("k"),
                    (F.least(F.lit(1.0), s.max_per_seller / F.col("m")) if weighted else F.lit(1.0)).alias("w"))


def _residual() -> Column:
    return F.col("y") - F.col("my") - F.col("b_age") * (F.col("a") - F.col("ma")) - F.col("b_km") * (F.col("k") - F.col("mk"))


def medians(rows: DataFrame, keys: list[str], value: str, name: str, cells: int = 1024) -> DataFrame:
    """(keys, name): the exact median of a value per group, as F.median gives it, for groups of any size. Values are counted in cells between the group's
    least and greatest one; only the distinct values of the cells that hold the middle are sorted, so no task holds a group."""
    x = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    ends = persisted(x.groupBy(*keys).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n")))
    wide = F.col("most") - F.col("least")
    cell = F.when(wide > 0, F.floor((F.col("v") - F.col("least")) / wide * cells)).otherwise(0).cast("int")
    placed = x.join(ends, keys).withColumn("cell", cell)
    before = Window.partitionBy(*keys).orderBy("cell")
    # the middle places, from 1
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    held = placed.groupBy(*keys, "n", "cell").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(before))
    held = held.filter((F.col("upto") >= low) & (F.col("upto") - F.col("c") < high)).select(*keys, "cell", (F.col("upto") - F.col("c")).alias("start"))
    held = persisted(held)
    inside = placed.join(held, [*keys, "cell"]).groupBy(*keys, "n", "cell", "start", "v").agg(F.count("*").alias("c"))
    inside = inside.withColumn("upto", F.col("start") + F.sum("c").over(Window.partitionBy(*keys, "cell").orderBy("v")))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place), F.col("v")))

    return inside.groupBy(*keys).agg((at(low) * 0.5 + at(high) * 0.5).alias(name))


def used_points(pts: DataFrame, s: Settings) -> DataFrame:
    """The points that the curves of their models rest on, with the fit (ma, mk, my, b_age, b_km) and the residual r; see robust_curves. The points and the
    one row per model of each step are written, so that no step works out those before it again."""
    fitted = ["ma", "mk", "my", "b_age", "b_km"]
    pts = persisted(pts)
    first = persisted(closed_form(pts, s).select(*KEYS, *fitted))
    res = pts.join(first, KEYS).withColumn("r", _residual()).drop(*fitted)
    mid = persisted(medians(res, KEYS, "r", "mid"))
    off = res.join(mid, KEYS).withColumn("off", F.abs(F.col("r") - F.col("mid"))).drop("mid", "r")
    mad = persisted(medians(off, KEYS, "off", "mad"))
    marked = off.join(mad, KEYS).withColumn("near", (F.col("mad") <= 0) | (F.col("off") <= ROBUST_K * 1.4826 * F.col("mad"))).drop("off", "mad")
    second = closed_form(marked.filter("near"), s).select(*KEYS, F.struct(*fitted).alias("again"))
    curve = persisted(first.join(second, KEYS, "left").select(*KEYS, F.col("again").isNotNull().alias("refit"), *[F.coalesce(f"again.{c}", c).alias(c) for c in fitted]))
    return marked.join(curve, KEYS).filter("near or not refit").withColumn("r", _residual()).drop("near", "refit")


def robust_curves(rows: DataFrame, s: Settings) -> DataFrame:
    """One curve per model: a fit, one pass that drops points beyond ROBUST_K robust deviations of the median residual, a second fit where enough points
    remain, and the weighted spread of what was used. Curves of too wide a spread or rising with age are refused. The points stay distributed;
    what is joined back to them is one row per model."""
    fitted = ["ma", "mk", "my", "b_age", "b_km"]
    used = used_points(curve_points(rows, s).drop("id"), s)
    usual = medians(used.withColumn("of_age", F.col("k") * 10000 / F.greatest(F.col("a"), F.lit(1.0))), KEYS, "of_age", "km_per_year")
    g = used.groupBy(*KEYS, *fitted).agg(
        F.sqrt(F.sum(F.col("w") * F.col("r") * F.col("r")) / F.greatest(F.sum("w") - 3, F.lit(1.0))).alias("sigma"), F.count("*").alias("n"), F.count_distinct("seller").alias("sellers"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.floor(F.max("k") * 10000 + 1e-6).alias("max_km"))
    return g.filter((F.col("sigma") <= s.curve_max_sigma) & (F.col("b_age") <= s.curve_max_age_slope)).join(usual, KEYS)


def curves_without(rows: DataFrame, s: Settings) -> DataFrame:
    """Per row of a model with a curve (id, keys): the curve that the other rows give. Ten sums, the years, the sellers and the two greatest mileages of each
    model are aggregated once; a row's own part is taken away from them in closed form, so there is no fit per row. Points weigh 1. What the robust
    pass has dropped with the row present stays dropped; a row that the curve does not rest on has the model's curve."""
    used = persisted(used_points(curve_points(rows, s, weighted=False), s).select("id", *KEYS, "seller", "year", "y", "a", "k"))
    x = {"a": F.col("a"), "k": F.col("k"), "y": F.col("y")}
    sums = {f"s{p}": F.sum(x[p]) for p in "aky"} | {f"s{p}{q}": F.sum(x[p] * x[q]) for p, q in ("aa", "kk", "yy", "ak", "ay", "ky")}
    model = used.groupBy(*KEYS).agg(F.count("*").alias("n0"), F.count_distinct("seller").alias("sellers0"), F.max("k").alias("k1"), *[e.alias(c) for c, e in sums.items()])
    years = used.groupBy(*KEYS, "year").agg(F.count("*").alias("c")).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("year", "c"))).alias("ys"))
    tops = used.join(model.select(*KEYS, "k1"), KEYS).groupBy(*KEYS).agg(F.count_if(F.col("k") == F.col("k1")).alias("at_k1"), F.max(F.when(F.col("k") < F.col("k1"), F.col("k"))).alias("k2"))
    model = persisted(model.join(years, KEYS).join(tops, KEYS))
    own = used.groupBy(*KEYS, "seller").agg(F.count("*").alias("of_seller"))
    mine = used.join(own, [*KEYS, "seller"]).select("id", *[F.col(c).alias(f"o_{c}") for c in ("year", "y", "a", "k")], "of_seller")
    d = rows.select("id", *KEYS).join(mine, "id", "left").join(model, KEYS)  # the wide rows of the models come after what is dealt by id
    here = F.col("o_y").isNotNull()

    def less(total: str, part: str) -> Column:
        return F.col(total) - F.coalesce(F.expr(part), F.lit(0.0))

    parts = {f"s{p}": f"o_{p}" for p in "aky"} | {f"s{p}{q}": f"o_{p} * o_{q}" for p, q in ("aa", "kk", "yy", "ak", "ay", "ky")}
    d = d.withColumns({c: less(c, e) for c, e in parts.items()} | {"n": F.col("n0") - here.cast("int"), "sellers": F.col("sellers0") - F.coalesce(F.col("of_seller") == 1, F.lit(False)).cast("int")})
    left = F.filter("ys", lambda y: ~F.coalesce((y["c"] == 1) & (y["year"] == F.col("o_year")), F.lit(False)))
    last_of_top = F.coalesce((F.col("o_k") == F.col("k1")) & (F.col("at_k1") == 1), F.lit(False))
    d = d.withColumn("ys", left).withColumn("max_k", F.when(last_of_top, F.col("k2")).otherwise(F.col("k1")))
    d = d.filter((F.col("n") >= s.curve_min_rows) & (F.size("ys") >= s.curve_min_years))
    d = d.withColumns({"ma": F.expr("sa / n"), "mk": F.expr("sk / n"), "my": F.expr("sy / n")} | {f"c{p}{q}": F.expr(f"s{p}{q} - s{p} * s{q} / n") for p, q in ("aa", "kk", "yy", "ak", "ay", "ky")})
    d = d.withColumns({"vaa": F.col("caa") + s.ridge_lambda, "vkk": F.col("ckk") + s.ridge_lambda}).withColumn("det", F.expr("vaa * vkk - cak * cak"))
    free = F.expr("(cky * vaa - cay * cak) / det")
    d = d.withColumn("b_km", F.when(free > s.km_slope_limit, F.lit(s.km_slope_fixed)).otherwise(free))
    d = d.withColumn("b_age", F.when(free > s.km_slope_limit, (F.col("cay") - s.km_slope_fixed * F.col("cak")) / F.col("vaa")).otherwise(F.expr("(cay * vkk - cky * cak) / det")))
    rest = F.expr("cyy - 2 * (b_age * cay + b_km * cky) + b_age * b_age * caa + 2 * b_age * b_km * cak + b_km * b_km * ckk")
    d = d.withColumn("sigma", F.sqrt(F.greatest(rest, F.lit(0.0)) / F.greatest(F.col("n") - 3, F.lit(1))))
    d = d.filter((F.col("sigma") <= s.curve_max_sigma) & (F.col("b_age") <= s.curve_max_age_slope))
    return d.select(
        "id", *KEYS, "ma", "mk", "my", "b_age", "b_km", "sigma", "n", "sellers", F.get("ys", F.lit(0))["year"].alias("min_year"), F.element_at("ys", -1)["year"].alias("max_year"),
        F.floor(F.col("max_k") * 10000 + 1e-6).alias("max_km"),
    )


def estimates_without(targets: DataFrame, rows: DataFrame, s: Settings, least: int = 3) -> DataFrame:
    """estimates() of each target by the curve of the other rows of its model, so that no advert confirms itself: the dry run of an alarm."""
    per_year = curve_points(rows, s, weighted=False).select("id", *KEYS, "year")
    near = per_year.groupBy(*KEYS, "year").agg(F.count("*").alias("c")).withColumn("year", F.explode(F.sequence(F.col("year") - 2, F.col("year") + 2))).groupBy(*KEYS, "year").agg(F.sum("c").alias("c"))
    t = targets.filter(~F.col("steering").eqNullSafe("LHD")).select("id", *KEYS, "year", "price_gbp", effective_km(F.col("km"), F.col("year"), s.as_of).alias("km")).filter("km is not null")
    d = t.join(near, [*KEYS, "year"]).join(per_year.select("id", F.lit(1).alias("own")), "id", "left").filter(F.col("c") - F.coalesce("own", F.lit(0)) >= least)
    d = d.join(curves_without(rows, s).drop(*KEYS), "id")
    d = d.filter(F.col("year").between(F.col("min_year") - 1, F.col("max_year") + 1) & (F.col("km") <= F.col("max_km") * 1.1) & (F.col("sellers") >= s.est_min_curve_sellers))
    value = predict(F.col("year"), F.col("km"), s)
    return d.select("id", "price_gbp", value.alias("value"), (value * F.exp(-s.est_z * F.col("sigma"))).alias("lower"), "n", "sellers", "sigma")


def dense_years(rows: DataFrame, s: Settings, least: int = 3) -> DataFrame:
    """(model, year) with at least so many usable points within two years."""
    per_year = curve_points(rows, s).groupBy(*KEYS, "year").agg(F.count("*").alias("c"))
    near = per_year.withColumn("year", F.explode(F.sequence(F.col("year") - 2, F.col("year") + 2)))
    return near.groupBy(*KEYS, "year").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).drop("c")


def predict(year: Column, km: Column, s: Settings) -> Column:
    """Price that a curve gives for a year and a mileage."""
    slope = F.least(F.col("b_km"), F.lit(KM_SLOPE_FLOOR))
    return F.exp(F.col("my") + F.col("b_age") * ((s.as_of.year - year) - F.col("ma")) + slope * (km / 10000 - F.col("mk")))


def estimates(targets: DataFrame, curves: DataFrame, dense: DataFrame, s: Settings) -> DataFrame:
    """Value and lower bound of adverts whose model has a curve, where all guards hold: not left-hand drive, believable mileage, year and mileage
    within the curve's range and a little beyond, enough sellers on the curve, and data around the year."""
    t = targets.filter(~F.col("steering").eqNullSafe("LHD")).select("id", *KEYS, "year", "price_gbp", effective_km(F.col("km"), F.col("year"), s.as_of).alias("km")).filter("km is not null")
    d = t.join(curves, KEYS).join(dense, [*KEYS, "year"], "left_semi")
    d = d.filter(F.col("year").between(F.col("min_year") - 1, F.col("max_year") + 1) & (F.col("km") <= F.col("max_km") * 1.1) & (F.col("sellers") >= s.est_min_curve_sellers))
    value = predict(F.col("year"), F.col("km"), s)
    return d.select("id", "price_gbp", value.alias("value"), (value * F.exp(-s.est_z * F.col("sigma"))).alias("lower"), "n", "sellers", "sigma")


def curve_rows(curves: DataFrame, dense: DataFrame, s: Settings) -> DataFrame:
    """Book rows by method B: every dense year of a curve's range, at the usual mileage of that age, with bounds est_z deviations away."""
    y = curves.withColumn("year", F.explode(F.sequence("min_year", "max_year"))).join(dense, [*KEYS, "year"], "left_semi")
    return at_usual_mileage(y, s)


def at_usual_mileage(y: DataFrame, s: Settings) -> DataFrame:
    """Book rows of curves (with keys and year): the price at the usual mileage of that age, and bounds est_z deviations away."""
    ref = F.floor(F.least(F.col("km_per_year") * F.greatest(s.as_of.year - F.col("year"), F.lit(0.5)), F.col("max_km")) + 1e-6)
    y = y.withColumn("ref_km", ref).withColumn("value", predict(F.col("year"), F.col("ref_km"), s))
    return y.select(*KEYS, "year", "ref_km", "value", (F.col("value") * F.exp(-s.est_z * F.col("sigma"))).alias("low"), (F.col("value") * F.exp(s.est_z * F.col("sigma"))).alias("high"), "n", "sellers")


def comparable_rows(rows: DataFrame, curves: DataFrame, s: Settings) -> DataFrame:
    """Book rows by method A: for each model and year with adverts, those within a year of it (the newest max_per_seller of a seller), brought to that
    year and the group's usual mileage by the model's slopes, trimmed as a market is; median, inclusive quartiles, mileage, rows and sellers."""
    d = usable_pool(rows, s).dropna(subset=KEYS).filter(F.coalesce("steering", F.lit("RHD")) == "RHD")
    years = d.select(*KEYS, "year").distinct()
    d = d.withColumn("of", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1))).join(years.withColumnRenamed("year", "of"), [*KEYS, "of"], "left_semi")
    newest = Window.partitionBy(*KEYS, "of", "seller").orderBy(F.desc("first_seen_at"), "id")
    d = d.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= s.max_per_seller)
    group = Window.partitionBy(*KEYS, "of")
    known = F.when(F.col("km") != 0, F.col("km"))
    d = d.withColumn("ref_km", F.when(F.count(known).over(group) >= 3, F.floor(F.median(known).over(group))))
    d = d.join(curves.select(*KEYS, "b_age", "b_km"), KEYS, "left")
    age = F.coalesce(F.least(F.col("b_age"), F.lit(0.0)), F.lit(AGE_SLOPE))
    km = F.coalesce(F.least(F.col("b_km"), F.lit(KM_SLOPE_FLOOR)), F.lit(KM_SLOPE))
    moved = F.ln("price_gbp") + age * (F.col("year") - F.col("of")) + F.coalesce(km * (F.col("ref_km") - known) / 10000, F.lit(0.0))
    d = trimmed(d.withColumns({"adj": F.exp(moved), "t_id": F.concat_ws("|", *KEYS), "step": F.col("of")}), s)
    g = d.groupBy(*KEYS, F.col("of").alias("year")).agg(
        F.percentile("adj", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("ref_km").alias("ref_km"), F.count("*").alias("n"), F.count_distinct("seller").alias("sellers"))
    g = g.filter(F.col("n") >= s.min_comparables)
    return g.select(*KEYS, "year", "ref_km", F.get("q", F.lit(1)).alias("value"), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(2)).alias("high"), "n", "sellers")


def sales_info(book: DataFrame, sales: DataFrame) -> DataFrame:
    """Book rows with the number and median price of the sales (keys, year, price_gbp) within a year of theirs."""
    near = sales.select(*KEYS, F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("year"), "price_gbp")
    got = near.groupBy(*KEYS, "year").agg(F.count("*").alias("sales_n"), F.median("price_gbp").alias("sales_median"))
    return book.join(got, [*KEYS, "year"], "left").withColumn("sales_n", F.coalesce("sales_n", F.lit(0)))


def self_check(recent: DataFrame, curves: DataFrame, s: Settings, most: float = 0.25, least: int = 5) -> DataFrame:
    """Per model with a curve: recent adverts that can be judged, the curve's median error, and whether it is too large to be relied on."""
    t = recent.filter(~F.col("steering").eqNullSafe("LHD") & (F.col("price_gbp") > 0)).select(*KEYS, "year", "price_gbp", effective_km(F.col("km"), F.col("year"), s.as_of).alias("km"))
    t = t.dropna(subset=["km", "year"]).join(curves, KEYS)
    off = F.abs(F.ln("price_gbp") - F.ln(predict(F.col("year"), F.col("km"), s)))
    g = t.groupBy(*KEYS).agg(F.count("*").alias("judged"), (F.exp(F.median(off)) - 1).alias("error"))
    return g.withColumn("unreliable", (F.col("judged") >= least) & (F.col("error") > most))


def build_book(rows: DataFrame, sales: DataFrame, s: Settings, prev: DataFrame | None = None) -> DataFrame:
    """The nightly book: rows of comparables (A); of the model's curve (B) for its dense years that have no settled or suspect row; and of the brand's
    curve (C), for the adverts' years of models that have neither. prev: last night's keys, year, value, candidate, nights. Rows carry method, status
    and the sales near their year."""
    keys = [*KEYS, "year"]
    curves = persisted(robust_curves(rows, s))
    if prev is None:
        prev = rows.select(*keys, F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("candidate"), F.lit(0).alias("nights")).limit(0)

    def judged(new: DataFrame, method: str) -> DataFrame:
        st = next_status(prev, new, keys, s).select(*keys, F.col("value").alias("kept"), "candidate", "nights", "status")
        return new.join(st, keys).withColumns({"value": F.col("kept"), "method": F.lit(method)}).drop("kept")

    a = persisted(judged(comparable_rows(rows, curves, s), "A"))
    b = judged(curve_rows(curves, dense_years(rows, s), s), "B").join(a.filter("status <> 'ince'"), keys, "left_anti")
    few = (F.col("status") == "oturmus") & (F.col("sellers") < s.est_min_curve_sellers)
    b = b.withColumn("status", F.when(few, "ince").otherwise(F.col("status")))
    both = persisted(a.join(b, keys, "left_anti").unionByName(b))
    brand = robust_curves(rows.withColumn("model_norm", F.lit("*")), s.but(curve_max_sigma=s.brand_max_sigma)).drop("model_norm")
    bare = usable_pool(rows, s).dropna(subset=KEYS).select(*keys).distinct().join(both.select(*KEYS).distinct(), KEYS, "left_anti").join(brand, "brand_norm")
    c = at_usual_mileage(bare, s).withColumns({"method": F.lit("C"), "status": F.lit("ince"), "candidate": F.lit(None).cast("double"), "nights": F.lit(0)})
    return sales_info(both.unionByName(c), sales)
