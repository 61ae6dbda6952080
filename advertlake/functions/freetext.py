"""Adverts that people write freely (posts of groups) as columns: make, model, year, mileage, price and the rest, or the reason why a post is none.

A post is taken only if it names a make, a year and exactly one price with its currency; rather no advert than a wrong one. Every number is judged
by the few characters around it (see mentions): what stands before and after tells prices from instalments, deposits, former prices and repairs,
and a car's mileage from that of a service. Amounts that stay rivals after this leave the post without a price. All rules are built-in functions; a
null text is no post, and the work grows with the length of a text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.functions.numbers import let
from advertlake.functions.price import TRY_CAR_LEAST, joined_thousands, price_tokens
from advertlake.functions.rules import placeholder_amount
from advertlake.functions.text import mentions, normalize_phone, tr_lower

# fixed values: makes as they are written, misspellings and what they stand for, makes in capitals
MAKES = [
    "toyota", "honda", "nissan", "mazda", "suzuki", "hyundai", "kia", "ford", "opel", "vauxhall", "renault", "peugeot", "citroen", "fiat", "bmw", "mercedes-benz", "mercedes",
    "audi", "volkswagen", "vw", "skoda", "seat", "volvo", "mitsubishi", "subaru", "lexus", "jeep", "land rover", "range rover", "mini", "mg", "dacia", "chevrolet", "daihatsu",
    "isuzu", "porsche", "tesla", "alfa romeo", "jaguar", "saab", "ssangyong", "cupra", "byd", "chery",
]
MISSPELT = {
    "mersedes": "mercedes", "mersedez": "mercedes", "mercedez": "mercedes", "suziki": "suzuki", "wolkswagen": "volkswagen", "mersedes-benz": "mercedes-benz",
    "mersedez-benz": "mercedes-benz", "mercedez-benz": "mercedes-benz", "wolswagen": "volkswagen", "volswagen": "volkswagen", "toyoto": "toyota", "toyata": "toyota",
    "suzik": "suzuki", "lander rover": "land rover",
}
IN_CAPITALS = ["bmw", "mg", "vw", "byd"]
# fixed values: words behind "smart" that make it a feature and no make
_SMART_FEATURE = r"(?:stop|start|key|keyless|entry|giri[şs]|kart|card|anahtar|park|cruise|sens[oö]r|sensor|ekran|tv|phone|telefon|mode|mod|charge|[şs]arj)"
_LETTER, _NO_LETTER = "a-zçğıöşü", "(?![a-zçğıöşü0-9])"
_MAKE = (
    r"(?<![a-zçğıöşü0-9])(?:(?:" + "|".join(sorted([*MAKES, *MISSPELT], key=len, reverse=True)) + f"){_NO_LETTER}|mazda(?=[2356]{_NO_LETTER})"
    rf"|fort(?=[^\S\n]+(?:focus|fiesta){_NO_LETTER})|smart(?![^\S\n]*[/&-]?[^\S\n]*{_SMART_FEATURE}{_NO_LETTER}){_NO_LETTER})"
)
# fixed values: posts that let, seek or buy; words of a first line that sells no car; trades that are no purchase
_SEEKS = r"kiral[ıi]k|aran[ıi]yor|al[ıi]n[ıi]r|al[ıi]yoruz|almak\s+istiyorum"
_NO_CAR = r"jant|lastik|tekne|bisiklet|motosiklet|yedek\s+par[çc]a|bah[çc]e"
_TRADE_IN = (
    r"(?:takas[a-zçğıöşü]*|[iİı]ç[iİı]ne|[iİı]çer[iİı]s[iİı]ne|[üÜuU]st[üÜuU]ne|[üÜuU]zer[iİı]ne)(?![a-zçğıöşü])[^\n.!?]{0,40}?al[ıi]n[ıi]r|kiral[ıi]k\s+ge[çc]mi[şs]"
)
HEAD = 150
# fixed values: words beside amounts of money
_NO_PRICE = r"tramer|boya|kredi|taksit|pe[şs]inat|komisyon|depozito|kapora|vergi|muayene|sigorta|[öo]deme|masraf|bak[ıi]m"
_HINT = r"fiyat|nakit|nakite|pe[şs]in|sat[ıi][şs]"
_FORMER = r"(?<![a-z])(?:eski|onceki|old|was)\s*(?:fiyat|price)|uzeri\s*cizili"
_ADVANCE = r"advance|installment|down\s*payment|monthly|per\s*month|deposit"
LEAST, MOST = 300, 2_000_000
BOX_LEAST = 1_000
# fixed values: numbers of mobiles, model years
_SEP = r"(?:[^\S\n]|[.-])"
_MOBILE = rf"(?<!\d)(?:\+?[^\S\n]*9?0{_SEP}*)?\(?5\d{{2}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{2}}{_SEP}?\d{{2}}(?!\d)"
_YEAR = (
    r"(?<![\d.,£€$])(?<!(?<![A-Za-zÇĞİÖŞÜçğıöşü])[A-Za-zÇĞİÖŞÜçğıöşü])(?:19[89]\d|20[0-3]\d)(?![\d.,]?\d)"
    r"(?![ \t]*(?:£|₺|€|\$|tl\b|stg\b|gbp\b|sterlin\b|str\b)(?![ \t]*\d))(?![ \t]*(?:cc|c\.c|cm3|hp|ps|bg|kw)\b)"
)
# fixed values: mileages, their labels, hidden digits, and words of services and parts
_KM_NUMBER = r"(?:\d{1,3}(?:[.,]\d{3})+|\d{4,6}|\d{1,3}[^\S\n]*(?:bin|k)(?![a-zçğıöşü]))"
_KM = rf"(?<![\d.,]){_KM_NUMBER}[^\S\n]*(?:km|mil(?!eage)\w*)\b"
_KM_WORD = r"\b(?:km|kilometre(?:si)?|kilometer|mileage)(?:[^\S\n]*[:\-]\s*|[^\S\n]*)"
_KM_LABEL = rf"{_KM_WORD}({_KM_NUMBER})(?![\d.,]?\d)(?![^\S\n]*(?:£|₺|€|\$|(?:tl|try|stg|gbp|sterlin|sterling|str|eur|euro|usd|dolar)(?![a-z])))"
_HIDDEN = [(r"(\d{1,3})[^\S\n]?[.,][^\S\n]?[*x]{3}", "000"), (r"(\d{1,3})[^\S\n]?[*x]{3}", "000"), (r"(\d{1,3})[^\S\n]?[*x]{4}", "0000")]
_CLAUSE_END = r"[.!?;,(\n|]"
_SERVICE = r"bak[ıi]m(?!l[ıi])|servis|ya[gğ][ıi]?(?![a-zçğıöşü])|ya[gğ]lar|de[gğ]i[sş]|pompa|lastik"
_PART = r"tak[ıi]l|s[öo]k[üu]l|getir|al[ıi]nm[ıi][sş]"
_SERVICE_AFTER = r"^(?:['’][a-zçğıöşü]+)?[^\S\n]*(?:[dt][ae][^\S\n]+bir\b|bir\b|[öo]nce\b|sonra\b|kala\b|kadar\b)"
SERVICE_MOST, KM_LEAST, KM_MOST = 20_000, 1_000, 600_000
# fixed values: words behind a make that are no model, codes of chassis, models of several words
_NO_MODEL = [
    "il", "ilk", "ilan", "sahibinden", "galeriden", "yeni", "temiz", "hasarsiz", "hatasiz", "boyasiz", "tek", "motor", "arac", "otomobil", "arabasi", "araba", "marka", "model",
    "aracimiz", "gunluk", "satilik", "benz",
]
_CHASSIS = r"^(?:[efgu]\d{2}|w\d{3})$"
LONG_MODELS = [
    (r"c[\s-]*h[\s-]*r(?![a-z0-9])", "C-HR"), (r"(cx|cr|hr|zr)[\s-]+(v|\d{1,2})(?![a-z0-9])", "{1}-{2}"), (r"(yaris|corolla)[^\S\n]*-?[^\S\n]*cross(?![a-z0-9])", "{1t} Cross"),
    (r"rav[^\S\n]*-?[^\S\n]*4(?![a-z0-9])", "RAV4"), (r"wr[^\S\n]*-?[^\S\n]*v(?![a-z0-9])", "WR-V"), (r"land[^\S\n]*-?[^\S\n]*cruiser[^\S\n]+prado(?![a-z0-9])", "Land Cruiser Prado"),
    (r"land[^\S\n]*-?[^\S\n]*cruiser(?![a-z0-9])", "Land Cruiser"), (r"grand[^\S\n]+(cherokee|vitara)(?![a-z0-9])", "Grand {1t}"),
]
# fixed values: words of gears, fuels and steering, places
GEARS = [("otomatik", r"otomatik|automatic|\bauto\b|dsg|tiptronic"), ("manuel", r"manuel|manual|düz vites|duz vites")]
FUELS = [("dizel", r"dizel|diesel|tdi|cdi"), ("hibrit", r"hybrid|hibrit"), ("elektrikli", r"elektrik(?:li)?\s*(?:araç|arac|motor)|\bev\b"), ("benzin", r"benzin|petrol")]
_ELECTRIC_PART = r"elektrikli (?:cam|ayna|bagaj|koltuk|park)"
STEERING = [("LHD", r"sol\s+direksiyon|\blhd\b"), ("RHD", r"sağ\s+direksiyon|sag\s+direksiyon|\brhd\b")]
PLACES = [
    "girne", "lefkoşa", "lefkosa", "gazimağusa", "gazimagusa", "mağusa", "magusa", "güzelyurt", "guzelyurt", "iskele", "lefke", "alsancak", "lapta", "karpaz", "dikmen",
    "yeni boğaziçi", "boğaz", "bogaz", "ercan",
]
_NEGOTIABLE, _SWAP = r"pazarl[ıi]k", r"takas\s+(?:olur|var|yap[ıi]l[ıi]r|kabul)|takasa\s+uygun"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

PLACEHOLDER = "yer_tutucu"
NO_SALE, NO_MAKE, NO_YEAR, NO_PRICE, GOOD = "arac_degil", "marka_yok", "yil_yok", "fiyat_yok", "ok"
CUT_TAIL = 30


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU)(?:{pattern})")


def _first_of(text: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(_has(text, p), v) for v, p in table])


def plain_letters(text: Column) -> Column:
    """Lower case without the accents of Turkish; enough for words inside a row's array functions, where fold() can't run."""
    return F.regexp_replace(F.lower(F.translate(text, "ıİÇçĞğÖöŞşÜüÂâÎîÛû", "iiccggoossuuaaiiuu")), r"\p{M}+", "")


def without_mobiles(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){_MOBILE}", " ")


def is_no_sale(text: Column) -> Column:
    """The post lets, seeks or buys, or its first line sells something else: a wheel is no car unless a make and a year stand before it."""
    head = F.regexp_replace(F.left(text, F.lit(HEAD)), f"(?iU){_TRADE_IN}", " ")
    first = F.split_part(F.regexp_replace(text, r"(?U)^\s+", ""), F.lit("\n"), F.lit(1))
    before = F.regexp_extract(first, f"(?siU)^(.*?)(?:{_NO_CAR})", 1)
    return _has(head, _SEEKS) | (_has(first, _NO_CAR) & ~(_has(before, _MAKE) & _has(before, _YEAR)))


def _candidates(line: Column, skip_box: bool) -> Column:
    """Array of (amount, currency, start, hint, swap, guess, small) of a line's amounts that may be the price; start: the line's first characters. small:
    too few lira, which no price may equal."""

    def of(v: Column) -> Column:
        def one(t: Column) -> Column:
            marks = F.struct(
                _has(t["before"], _HINT).alias("hint"), (placeholder_amount(t["amount"]) | ((t["currency"] == "TRY") & t["box"] & (t["amount"] <= BOX_LEAST))).alias("held"),
            )
            return let(marks, lambda m: judged(t, m["hint"], m["held"]))

        def judged(t: Column, hint: Column, held: Column) -> Column:
            lira = t["currency"] == "TRY"
            guessed = lira & t["box"] & (t["amount"] < TRY_CAR_LEAST)
            few = lira & ~t["box"] & (t["amount"] < TRY_CAR_LEAST) & ~held
            near = F.concat(t["before"], F.lit(" "), t["after"])
            other = _has(plain_letters(t["before"]), _FORMER) | _has(near, _ADVANCE) | ((_has(t["before"], _NO_PRICE) | _has(t["after"], _NO_PRICE)) & ~hint)
            if skip_box:
                other = other | t["box"]
            use = t["currency"].isNotNull() & F.when(few, t["amount"] >= LEAST).otherwise(t["amount"].between(LEAST, MOST) & ~other)
            return F.struct(
                t["amount"].alias("amount"), F.when(held, PLACEHOLDER).when(guessed, "GBP").otherwise(t["currency"]).alias("currency"), v["start"].alias("start"),
                (hint | (v["hint"] & ~v["other"])).alias("hint"), v["swap"].alias("swap"), (guessed & ~held).alias("guess"), few.alias("small"), use.alias("use"),
            )

        tokens = F.filter(F.transform(v["tokens"], one), lambda t: F.coalesce(t["use"], F.lit(False)))
        return F.when(v["repairs"] & ~v["hint"], F.slice(tokens, 1, 0)).otherwise(tokens)

    said = [_has(line, p).alias(n) for n, p in (("hint", _HINT), ("other", _NO_PRICE), ("swap", "takas"), ("repairs", "tramer|boya"))]
    return let(F.struct(F.left(line, F.lit(80)).alias("start"), *said, price_tokens(joined_thousands(line)).alias("tokens")), of)


def price_of(text: Column, skip_box: bool = False) -> Column:
    """Struct (amount, currency, line, guess): the one price of a text without mobiles; null if there is none or more than one."""
    lines = F.filter(F.transform(F.split(text, _LINE_END), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), lambda line: line.rlike(r"\d"))  # a line without a digit has no amount

    def without_echoes(all_: Column) -> Column:
        small = F.array_distinct(F.transform(F.filter(all_, lambda t: t["small"]), lambda t: t["amount"]))
        real = F.filter(all_, lambda t: ~t["small"])

        def left(v: Column) -> Column:
            rest = F.filter(v["real"], lambda t: ~F.exists(v["small"], lambda s: F.abs(t["amount"] - s) <= 0.01 * s))
            # a sales box repeats in euro what the post says in pounds or lira
            own = F.transform(F.filter(rest, lambda t: t["currency"].isin("GBP", "TRY")), lambda t: t["amount"])
            return let(own, lambda amounts: F.filter(rest, lambda t: ~((t["currency"] == "EUR") & F.array_contains(amounts, t["amount"]))))

        return let(F.struct(small.alias("small"), real.alias("real")), left)

    def kinds(found: Column) -> Column:
        return F.array_distinct(F.transform(found, lambda t: F.struct(t["amount"].alias("amount"), t["currency"].alias("currency"))))

    def chosen(found: Column) -> Column:
        def of(v: Column) -> Column:
            best = F.when(F.size(v["all"]) == 1, v["all"]).when(F.size(v["hinted"]) > 1, v["cash"]).otherwise(v["hinted"])

            def priced(b: Column) -> Column:
                one = F.get(b, F.lit(0))
                same = F.filter(found, lambda t: (t["amount"] == one["amount"]) & (t["currency"] == one["currency"]))
                price = F.struct(one["amount"].alias("amount"), one["currency"].alias("currency"), F.get(same, F.lit(0))["start"].alias("line"), F.forall(same, lambda t: t["guess"]).alias("guess"))
                return F.when((F.size(b) == 1) & (one["currency"] != PLACEHOLDER), price)

            return let(best, priced)

        hinted = F.filter(found, lambda t: t["hint"])
        cash = F.filter(found, lambda t: t["hint"] & ~t["swap"])
        return let(F.struct(kinds(found).alias("all"), kinds(hinted).alias("hinted"), kinds(cash).alias("cash")), of)

    return let(let(F.flatten(F.transform(lines, lambda line: _candidates(line, skip_box))), without_echoes), chosen)


def body_price(text: Column) -> Column:
    """The price that the text itself gives, without amounts in the form of a sales box."""
    return let(without_mobiles(F.coalesce(text, F.lit(""))), lambda t: price_of(t, skip_box=True))


def price_in_cut_tail(text: Column, tail: int = CUT_TAIL, whole: Column | None = None) -> Column:
    """Whether the body's price hangs on the last characters of a text that may have been cut: without them it goes or changes. whole: body_price(text)."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", "")
    cut = body_price(F.left(body, F.greatest(F.lit(0), F.length(body) - tail)))

    def hangs(w: Column) -> Column:
        return F.when(w.isNull(), False).otherwise(let(cut, lambda c: ~(w["amount"].eqNullSafe(c["amount"]) & w["currency"].eqNullSafe(c["currency"]))))

    return let(body_price(text) if whole is None else whole, hangs)


def _km_value(token: Column) -> Column:
    # an empty text is not cast: each failure of a cast is an exception
    short = F.nullif(F.regexp_extract(token, r"(?iU)^(\d{1,3})[^\S\n]*(?:bin|k)$", 1), F.lit("")).try_cast("int") * 1000
    n = F.coalesce(short, F.nullif(F.regexp_replace(token, "[.,]", ""), F.lit("")).try_cast("int"))
    return F.when(n.between(KM_LEAST, KM_MOST), n)


def km_of(text: Column) -> Column:
    """The car's mileage: the first number with its unit that is no model year before a label and no mileage of a service or part, unknown if it is in
    miles; else that of the first label."""

    def judged(m: Column) -> Column:
        number = F.regexp_extract(m["hit"], f"(?iU)^({_KM_NUMBER})[^\\S\\n]*(?:km|mil)", 1)
        before = F.regexp_extract(m["before"], rf"(?s)([^.!?;,(\n|]*)$", 1)
        after = F.regexp_extract(m["after"], rf"(?s)^([^.!?;,(\n|]*)", 1)
        value, near = _km_value(number), F.concat(before, F.lit(" "), after)
        year = _has(number, r"^(?:19[89]\d|20[0-3]\d)$") & _has(m["hit"], "km$") & _has(m["after"], r"^[^\S\n]*[:\-]?[^\S\n]*\d")
        service = _has(before, r"\bher[^\S\n]+$") | _has(m["after"], _SERVICE_AFTER) | _has(near, _PART) | ((value < SERVICE_MOST) & _has(near, _SERVICE))
        return F.struct(value.alias("value"), _has(m["hit"], r"\d[^\S\n]*(?:bin|k)?[^\S\n]*mil\w*$").alias("miles"), (year | (value.isNotNull() & service)).alias("other"))

    def read(v: Column) -> Column:
        first = F.get(F.filter(v["said"], lambda m: ~m["other"]), F.lit(0))
        labelled = F.when(~_has(v["behind"], r"^[^\S\n]*mil"), _km_value(v["label"]))
        return F.when(first.isNotNull(), F.when(~first["miles"], first["value"])).otherwise(labelled)

    label = F.nullif(F.regexp_extract(text, f"(?iU){_KM_LABEL}", 1), F.lit(""))
    behind = F.regexp_extract(text, f"(?siU){_KM_LABEL}(.{{0,12}})", 2)
    return let(F.struct(F.transform(mentions(text, f"(?iU){_KM}", 40), judged).alias("said"), label.alias("label"), behind.alias("behind")), read)


def km_read(text: Column) -> Column:
    """Struct (km, least): digits hidden by three or four stars or x beside a unit or a label count as zeros; the mileage is then a least value."""
    free, end = r"(?<![\w.,*])", r"(?![*x\d])"
    shown = text
    for body, zeros in _HIDDEN:
        shown = F.regexp_replace(shown, rf"(?iU){free}{body}{end}(?=[^\S\n]*km\b)", "$1" + zeros)
    for body, zeros in _HIDDEN:
        shown = F.regexp_replace(shown, rf"(?iU)({_KM_WORD}){free}{body}{end}(?![^\S\n]*[*x]{{2}})", "$1$2" + zeros)

    def read(v: Column) -> Column:
        least = v["shown"].isNotNull() & ~v["shown"].eqNullSafe(v["plain"])
        return F.struct(F.when(least, v["shown"]).otherwise(v["plain"]).alias("km"), least.alias("least"))

    hidden = F.when(text.rlike("[*xX]{3}"), km_of(joined_thousands(shown)))
    return let(F.struct(km_of(joined_thousands(text)).alias("plain"), hidden.alias("shown")), read)


def _model_after(after: Column) -> Column:
    """The model among the first four words behind the make."""
    pattern = r"(?siU)([£€$₺]?)(?=[A-ZÇĞİÖŞÜ0-9-])([A-ZÇĞİÖŞÜ]*\d*[A-ZÇĞİÖŞÜ0-9\-]*)(?=([.,]\d{3}(?!\d))?)(?=(.{0,40}))"
    head = F.left(after, F.lit(100))
    groups = [F.regexp_extract_all(head, F.lit(pattern), F.lit(k)) for k in (1, 2, 3, 4)]
    words = F.slice(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("sign", "word", "thousands", "rest"), strict=True)]), 1, 5)

    def named(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            following = F.coalesce(F.get(ws, i + 1)["word"], F.lit(""))
            money = (w["sign"] != "") | (w["thousands"] != "")
            skip = _has(w["word"], r"^(?:(?:19|20)\d{2}|modeli?|otomatik|manuel|full)$") | plain_letters(w["word"]).isin(_NO_MODEL) | ~_has(w["word"], "[A-Z0-9ÇĞİÖŞÜ]")
            skip = skip | (~money & _has(w["word"], _CHASSIS) & _has(following, r"^(?:\d{3}[a-zçğıöşüİ]{0,2}|[a-z]{1,3}\d{2,3}[a-z]?)$"))
            whole = F.concat(w["word"], w["rest"])
            longer = F.coalesce(*[F.when(_has(whole, f"^(?:{p})"), _filled(whole, p, name)) for p, name in LONG_MODELS])
            single = F.when((plain_letters(w["word"]) == "i") & _has(following, r"^\d+$"), F.concat(F.lit("i"), following)).otherwise(w["word"])
            return F.struct(skip.alias("skip"), money.alias("money"), F.coalesce(longer, single).alias("name"))

        return F.filter(F.slice(F.transform(ws, one), 1, 4), lambda w: ~w["skip"])

    return let(let(words, named), lambda ws: F.when(~F.get(ws, F.lit(0))["money"], F.get(ws, F.lit(0))["name"]))


def _filled(text: Column, pattern: str, name: str) -> Column:
    """A name with parts of the match in it: {n} in capitals, {nt} as a title."""
    out = []
    for piece in name.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece.startswith("{"):
            part = F.regexp_extract(text, f"(?iU)^(?:{pattern})", int(piece[1]))
            out.append(F.initcap(F.lower(part)) if piece.endswith("t}") else F.upper(part))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)


def _make_of(word: Column) -> Column:
    """The make's name: misspellings undone, a title or capitals; Range Rover is a model of Land Rover."""
    known = F.create_map(*[F.lit(x) for pair in MISSPELT.items() for x in pair])
    key = F.regexp_replace(plain_letters(word), r"\s+", " ")
    key = F.when(key == "fort", "ford").otherwise(F.coalesce(F.try_element_at(known, key), key))
    title = F.array_join(F.transform(F.regexp_extract_all(key, F.lit("[a-z]+|[^a-z]+"), F.lit(0)), lambda p: F.initcap(p)), "")
    return F.when(key == "range rover", "Land Rover").when(key.isin(IN_CAPITALS), F.upper(key)).otherwise(title)


def years_of(text: Column, newest: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?iU){_YEAR}"), F.lit(0)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y <= newest)


def _where(text: Column) -> Column:
    """Struct (before, make, after) around the first make; make is empty without one."""

    def of(before: Column) -> Column:
        rest = F.substring(text, F.length(before) + 1, F.length(text))
        make = let(F.regexp_extract(rest, f"(?siU)^{_MAKE}", 0), lambda m: F.struct(m.alias("make"), F.when(m != "", F.substring(rest, F.length(m) + 1, F.length(text))).otherwise("").alias("after")))
        return let(make, lambda m: F.struct(before.alias("before"), m["make"].alias("make"), m["after"].alias("after")))

    return let(F.regexp_extract(text, f"(?siU)^(.*?){_MAKE}", 1), of)


def _facts(text: Column, newest_year: Column, known: Column | None = None) -> Column:
    """Struct of what both the advert of a post and the reason why it is none rest on; null for a post that sells no car."""

    def seen(bare: Column) -> Column:
        price = price_of(bare) if known is None else F.when(known.isNull(), price_of(bare))
        return F.struct(bare.alias("bare"), _where(bare).alias("at"), years_of(bare, newest_year).alias("years"), price.alias("price"))

    return F.when(F.coalesce((text != "") & ~is_no_sale(text), F.lit(False)), let(without_mobiles(text), seen))


def _reason(v: Column) -> Column:
    return F.when(v.isNull(), NO_SALE).when(v["at"]["make"] == "", NO_MAKE).when(F.size(v["years"]) == 0, NO_YEAR).when(v["price"].isNull(), NO_PRICE).otherwise(GOOD)


def diagnose(text: Column, newest_year: Column) -> Column:
    """Why a post is no advert, or ok."""
    return let(_facts(text, newest_year), _reason)


def advert_and_reason(text: Column, newest_year: Column) -> Column:
    """Struct (advert, reason): parse_freetext() and diagnose() with what they share worked out once."""
    return let(_facts(text, newest_year), lambda v: F.struct(_advert(text, v, newest_year, None, None, False).alias("advert"), _reason(v).alias("reason")))


def parse_freetext(text: Column, newest_year: Column, default_steering: Column | None = None, known_price: Column | None = None, allow_no_price: bool = False) -> Column:
    """The advert of a post as a struct, null if it is none. known_price: a struct (amount, currency) that a site gives for sure, null where it gives none.
    allow_no_price: make and year are enough."""
    return let(_facts(text, newest_year, known_price), lambda v: _advert(text, v, newest_year, default_steering, known_price, allow_no_price))


def _advert(text: Column, facts: Column, newest_year: Column, default_steering: Column | None, known_price: Column | None, allow_no_price: bool) -> Column:
    known = F.lit(None).cast("struct<amount:double,currency:string>") if known_price is None else known_price

    def read(v: Column) -> Column:
        bare, at, found = v["bare"], v["at"], v["price"]
        amount = F.coalesce(known["amount"], found["amount"])
        whole_year = F.when(known.isNull(), amount)  # an amount that looks like a year is the price where another year stands
        others = F.filter(v["years"], lambda y: ~(y == whole_year))
        years = F.when(whole_year.isNotNull() & (F.size(others) > 0), others).otherwise(v["years"])
        line = F.concat(F.regexp_extract(at["before"], r"([^\n]*)$", 1), at["make"], F.regexp_extract(at["after"], r"^([^\n]*)", 1))
        near = F.filter(years_of(line, newest_year), lambda y: F.array_contains(years, y))
        range_rover = plain_letters(at["make"]).rlike(r"^range\s+rover$")
        low, km, model = tr_lower(bare), km_read(bare), _model_after(at["after"])
        fuel = _first_of(low, FUELS)
        no_part = F.when((fuel == "elektrikli") & _has(low, _ELECTRIC_PART), F.when(_has(low, "benzin|petrol"), "benzin")).otherwise(fuel)
        mobiles = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?U){_MOBILE}"), F.lit(0)), normalize_phone), lambda p: p.isNotNull())
        place = F.coalesce(*[F.when(F.contains(low, F.lit(c)), F.array_join(F.transform(F.split(F.lit(c), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 99))), " ")) for c in PLACES])
        steering = F.coalesce(_first_of(low, STEERING), *([] if default_steering is None else [default_steering]))
        raw = F.when(known.isNotNull(), F.concat_ws(" ", F.regexp_replace(known["amount"].cast("string"), r"\.0$", ""), known["currency"])).otherwise(found["line"])

        def fields(x: Column) -> Column:
            full = F.when(range_rover, F.concat_ws(" ", F.lit("Range Rover"), x["model"])).otherwise(x["model"])
            return F.struct(
                _make_of(at["make"]).alias("brand"), full.alias("model"), F.coalesce(F.get(near, F.lit(0)), F.get(years, F.lit(0))).alias("year"),
                x["km"]["km"].alias("km"), x["km"]["least"].alias("km_least"), no_part.alias("fuel"), _first_of(low, GEARS).alias("transmission"), steering.alias("steering"),
                place.alias("location"), F.get(mobiles, F.lit(0)).alias("phone"), raw.alias("price_raw"), amount.alias("price_amount"), F.coalesce(known["currency"], found["currency"]).alias("currency"),
                F.coalesce(F.when(known.isNotNull(), False).otherwise(found["guess"]), F.lit(False)).alias("currency_guess"), _has(low, _NEGOTIABLE).alias("negotiable"), F.when(_has(low, _SWAP), True).alias("swap"),
            )

        good = (at["make"] != "") & (F.size(v["years"]) > 0) & (amount.isNotNull() | F.lit(allow_no_price))
        return F.when(good, let(F.struct(km.alias("km"), model.alias("model")), fields))

    return F.when(facts.isNotNull(), read(facts))
