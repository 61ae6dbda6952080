"""Prices and templated captions of adverts as columns.

A text is cut at its numbers; a number's currency is the one that follows it, else the one before it, with no more than a few marks between them. All
steps are array functions over the numbers of a row and look at neighbours only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.functions.numbers import let
from advertlake.functions.rules import placeholder_amount
from advertlake.functions.text import mentions, normalize_phone, tr_lower

# fixed values: spellings of currencies (Turkish copula endings may follow the first two), and the least amount in lira that can be a car's price
_ENDING = r"(?:(?![a-z])|(?=[dt][ıiuü]r(?![a-zçğıöşü])))"
CURRENCIES = [
    ("TRY", rf"(?<![a-z])(?:tl|try){_ENDING}|₺"),
    ("GBP", rf"(?<![a-z])(?:stg|gbp|sterlin|sterling|str|pound|pounds|paund){_ENDING}|£"),
    ("EUR", r"(?<![a-z])(?:eur|euro)(?![a-z])|€"),
    ("USD", r"(?<![a-z])(?:usd|dolar)(?![a-z])|\$"),
]
TRY_CAR_LEAST = 50_000
_NUMBER = r"(?iu)(?<![\d,])(?:(?<=\p{L}\.)|(?<!\.))(?>\d(?:[\d.,]*\d)?)(?>\s*(?:bin|k)(?![a-zçğıöşü]))?"
_MARKS = r"(?:\.-)?[\s()\[\]:=/–-]*"
_ANY = "|".join(f"(?:{p})" for _, p in CURRENCIES)


def joined_thousands(text: Column) -> Column:
    """'6 500', '12/800' and '5 bin 500' with a point: a space or a slash between groups of three digits is no border between numbers. A leading
    number of three digits before two or more groups is a model's name and stays apart."""
    gap = "[ \\u00a0\\u202f\\u2009/]"
    may = text.rlike(rf"(?iu)\d(?:[^\S\n]*bin|{gap}\d{{3}})")  # what every pattern below holds
    t = F.regexp_replace(text, r"(?iu)(?<![\d.,])(\d{1,3})[^\S\n]*bin[^\S\n]*(\d{3})(?![\d.,]?\d)", "$1.$2")
    free, end = r"(?<![\d.,/])", r"(?![\d.,/]?\d)"
    # from the longest run of groups to the shortest; what a longer pattern has joined is no longer free
    for groups in (4, 3, 2):
        body = "".join(rf"{gap}(\d{{3}})" for _ in range(groups))
        keep = "".join(f".${k + 2}" for k in range(1, groups))
        t = F.regexp_replace(t, rf"{free}(\d{{3}}){body}{end}", "$1 $2" + keep)
        t = F.regexp_replace(t, rf"{free}(\d{{1,2}}){body}{end}", "$1.$2" + keep)
    return F.when(may, F.regexp_replace(t, rf"{free}(\d{{1,3}}){gap}(\d{{3}}){end}", "$1.$2")).otherwise(text)


def amount_of(token: Column) -> Column:
    """The number of a token: groups of three digits are thousands, else a comma is a decimal point; null if it is no number."""
    digits = F.regexp_extract(token, r"^[\d.,]+", 0)
    whole = digits.rlike(r"^\d{1,3}([.,]\d{3})+$")
    n = F.when(whole, F.regexp_replace(digits, "[.,]", "")).otherwise(F.replace(digits, F.lit(","), F.lit("."))).try_cast("double")
    scaled = token.rlike(r"(?iu)(bin|k)$") & (n < 1000)
    return F.when(scaled, n * 1000).otherwise(n)


def _currency_at(text: Column, pattern: str) -> Column:
    """The currency whose spelling the pattern has in place of {}."""
    return F.coalesce(*[F.when(text.rlike("(?iu)" + pattern.replace("{}", f"(?:{p})")), code) for code, p in CURRENCIES])


def price_tokens(text: Column, reach: int = 14) -> Column:
    """Array of (amount, currency, tight, yearish, box, before, after) of a text's numbers in order, the last two being the `reach` characters around it;
    ordinals ("1. el", "2. sahibinden") are left out. Of two numbers on both sides of one currency it belongs to the one without a gap, else to
    the one that is no year, else to both. box: the form TRY5,200 of a sales box."""

    def read(m: Column) -> Column:
        stuck = m["hit"].rlike(r"(?iu)^(?:\d{4,}|\d{1,3}[.,]\d{3}).*(?:bin|k)$")  # "1500 bin": the scale is no scale, and no currency follows
        sides = F.struct(F.when(~stuck, _currency_at(m["right"], f"^{_MARKS}{{}}")).alias("follows"), _currency_at(m["left"], f"{{}}{_MARKS}$").alias("leads"))

        def of(v: Column) -> Column:
            follows, leads = v["follows"], v["leads"]
            tight = F.when(follows.isNotNull(), m["right"].rlike(f"(?iu)^(?:{_ANY})")).when(leads.isNotNull(), m["left"].rlike(f"(?iu)(?:{_ANY})$")).otherwise(False)
            # the text up to the next number is one currency with its marks: it may be that number's, too
            passes = follows.isNotNull() & m["right"].rlike(f"(?iu)^{_MARKS}(?:{_ANY}){_MARKS}$")
            keep = ~F.concat(F.left(m["right"], F.lit(12)), F.lit(" ")).rlike(r"(?iu)^\.?\s*(?:el\b|sahib)")
            return F.struct(
                amount_of(m["hit"]).alias("amount"), F.coalesce(follows, leads).alias("currency"), tight.alias("tight"), m["hit"].rlike(r"^(19[89]\d|20[0-3]\d)$").alias("yearish"),
                (follows.isNull() & m["left"].rlike(r"(?<![A-Za-z])TRY$")).alias("box"), m["before"].alias("before"), m["after"].alias("after"),
                follows.isNotNull().alias("follows"), passes.alias("passes"), keep.alias("keep"),
            )

        return let(sides, of)

    def resolved(found: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before, after = F.get(found, i - 1), F.get(found, i + 1)
            with_after = t["passes"] & after["currency"].isNotNull() & ~after["follows"] & after["keep"] & (after["amount"] > 0)
            with_before = before["passes"] & t["currency"].isNotNull() & ~t["follows"] & before["keep"] & (before["amount"] > 0)
            rival = F.when(F.coalesce(with_after, F.lit(False)), after).when(F.coalesce(with_before, F.lit(False)), before)
            loses = F.coalesce(F.when(t["tight"] | rival["tight"], ~t["tight"]).when(~t["yearish"] | ~rival["yearish"], t["yearish"]), F.lit(False))
            return F.struct(
                t["amount"].alias("amount"), F.when(~loses, t["currency"]).alias("currency"), (t["tight"] & ~loses).alias("tight"), t["yearish"].alias("yearish"), (t["box"] & ~loses).alias("box"),
                t["before"].alias("before"), t["after"].alias("after"), t["keep"].alias("keep"),
            )

        return F.filter(F.transform(found, one), lambda t: t["keep"] & (t["amount"] > 0))

    return let(F.transform(mentions(text, _NUMBER, reach), read), resolved)


def parse_price(text: Column) -> Column:
    """Struct (amount, currency, guess): the first number with a currency; else the first that is no year, in a currency that the text names anywhere,
    or a guess (lira from 60,000 on, pounds below). Null without a number."""

    def chosen(v: Column) -> Column:
        def first(keep) -> Column:
            return F.get(F.filter(v["found"], keep), F.lit(0))

        priced, plain = first(lambda x: x["currency"].isNotNull()), first(lambda x: ~x["yearish"])
        named = F.coalesce(*[F.when(v["t"].rlike(f"(?iu){p}"), code) for code, p in CURRENCIES])
        amount = F.coalesce(priced["amount"], plain["amount"], F.get(v["found"], F.lit(0))["amount"])
        currency = F.coalesce(priced["currency"], named, F.when(amount >= 60000, "TRY").otherwise("GBP"))
        return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency"), (priced.isNull() & named.isNull()).alias("guess")))

    return let(joined_thousands(text), lambda t: let(F.struct(t.alias("t"), price_tokens(t).alias("found")), chosen))


def implausible(amount: Column, currency: Column) -> Column:
    """Amounts that are no car's price: placeholders, and too few lira."""
    return F.coalesce(placeholder_amount(amount) | ((currency == "TRY") & (amount < TRY_CAR_LEAST)), F.lit(False))


# fixed values: words of a caption's labels and the field that each stands for, in the order in which they are tried
LABELS = [
    ("marka", "model_line"), ("yıl", "year"), ("yakıt", "fuel"), ("vites", "transmission"), ("kilometre", "km"), ("dümen", "steering"), ("direksiyon", "steering"),
    ("konum", "location"), ("telefon", "phone"), ("iletişim", "phone"), ("fiyat", "price"), ("takas", "swap"),
]


def year_in(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def km_in(text: Column) -> Column:
    """The mileage of a field; hidden digits make it unknown."""
    digits = F.regexp_replace(F.regexp_replace(text, "(?i)km", ""), r"[.,\s]", "")
    n = F.when(digits.rlike(r"^\d+$"), digits.try_cast("int"))
    return F.when(~F.contains(text, F.lit("*")) & (n > 0), n)


def steering_in(text: Column) -> Column:
    t = tr_lower(text)
    return F.when(t.contains("sağ") | t.contains("sag"), "RHD").when(t.contains("sol"), "LHD")


def parse_caption(caption: Column) -> Column:
    """The fields of a templated caption (lines 'label: value'); null unless it has a make, a year and a price."""
    lines = F.transform(F.split(caption, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda line: F.trim(line))
    pattern = r"(?u)^[^\p{L}\p{N}_]*([^:\n]{2,40}?)\s*:\s*(.*)$"

    def parsed(line: Column) -> Column:
        label = tr_lower(F.regexp_extract(line, pattern, 1))
        field = F.coalesce(*[F.when(label.contains(w), f) for w, f in LABELS])
        return F.when(line.rlike(pattern), F.struct(field.alias("field"), F.trim(F.regexp_extract(line, pattern, 2)).alias("value")))

    rows = F.filter(F.transform(lines, parsed), lambda x: x["field"].isNotNull())
    names = sorted({f for _, f in LABELS})

    def values(found: Column) -> Column:
        return F.struct(*[F.get(F.filter(found, lambda x: x["field"] == n), F.lit(0))["value"].alias(n) for n in names])  # noqa: B023

    def read(v: Column) -> Column:
        def blank(c: Column) -> Column:
            return F.nullif(c, F.lit(""))

        make, swap = v["model_line"], tr_lower(v["swap"])

        def fields(p: Column) -> Column:
            return F.struct(
                blank(F.initcap(F.regexp_extract(make, r"^(\S+)", 1))).alias("brand"), blank(F.trim(F.regexp_extract(make, r"^\S+\s+(.*)$", 1))).alias("model"), year_in(v["year"]).alias("year"),
                km_in(v["km"]).alias("km"), blank(tr_lower(v["fuel"])).alias("fuel"), blank(tr_lower(v["transmission"])).alias("transmission"), steering_in(v["steering"]).alias("steering"),
                blank(v["location"]).alias("location"), normalize_phone(F.regexp_extract(F.coalesce(v["phone"], F.lit("")), r"^[\d\s+()-]*", 0)).alias("phone"), v["price"].alias("price_raw"),
                p["amount"].alias("price_amount"), p["currency"].alias("currency"), F.coalesce(p["guess"], F.lit(False)).alias("currency_guess"),
                caption.rlike(r"(?iu)pazarl[ıi]k\s+pay[ıi]\s+var|pazarl[ıi]k\s+var|pazarl[ıi]k\s+mevcut").alias("negotiable"),
                F.when(swap.startswith("var") | swap.startswith("evet"), True).when(swap.startswith("yok") | swap.startswith("hayır") | swap.startswith("hayir"), False).alias("swap"),
                v["year"].rlike(r"(19|20)\d{2}\s*[/(]").alias("year_unsure"),
            )

        return F.when(make.isNotNull() & v["year"].isNotNull() & v["price"].isNotNull(), let(parse_price(v["price"]), fields))

    return let(let(rows, values), read)


def is_sold_post(caption: Column) -> Column:
    return F.coalesce(caption.rlike(r"(?iu)sat[ıi]ld[ıi]|sat[ıi]lm[ıi][şs]"), F.lit(False))
