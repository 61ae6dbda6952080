"""Adverts of the sites' own pages as columns: one reader per kind of page, over the page's visible lines, its elements by class, or its embedded data. A
page that a reader does not know gives null, so that a changed template is seen and not taken for a removed advert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.functions import html as H
from advertlake.functions.advert_text import steering
from advertlake.functions.freetext import parse_freetext, without_mobiles
from advertlake.functions.numbers import let
from advertlake.functions.price import parse_price
from advertlake.functions.text import GEARS, canon, engine_liters, normalize_phone, tr_lower

KINDS = {
    "brand": "string", "model": "string", "year": "int", "km": "int", "fuel": "string", "transmission": "string", "engine_l": "double", "steering": "string", "location": "string",
    "price_raw": "string", "price_amount": "double", "currency": "string", "currency_guess": "boolean", "posted": "date", "negotiable": "boolean", "swap": "boolean",
    "seller_handle": "string", "seller_phone": "string", "seller_type": "string", "is_active": "boolean", "signals": "array<string>", "sold_at": "timestamp", "raw_text": "string",
}
# fixed values: words of fuels and gears on the sites
FUEL = {"dizel": "dizel", "benzin": "benzin", "hibrit": "hibrit", "hybrid": "hibrit", "elektrik": "elektrikli", "elektrikli": "elektrikli", "lpg": "lpg"}
GEAR = {"otomatik": "otomatik", "automatic": "otomatik", "manuel": "manuel", "manual": "manuel", "düz": "manuel", "yarı otomatik": "yarı otomatik"}
DATA_FUEL = [("hybrid", "hibrit"), ("diesel", "dizel"), ("gasoline", "benzin"), ("petrol", "benzin"), ("electric", "elektrikli"), ("lpg", "lpg"), ("autogas", "lpg")]
DATA_GEAR = {"automatictransmission": "otomatik", "manualtransmission": "manuel"}
MONTHS = ["ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık"]
# fixed values: headings, labels and phrases of the pages
ASK_PRICE = ["Fiyat Sorunuz", "Fiyatı satıcıya sor"]
DETAILS, FEATURES, TEXT, EXPLORE, SELLER = "Araç Detayları", "Özellikler", "Açıklama", "Keşfet", "Satıcı"
ARCHIVE, LAST_PRICE, SOLD_MARK, ARCHIVE_MARK = "Arşivdeki araç bilgileri", "Son ilan fiyatı", "Bu araç satıldı.", "Bu ilan artık aktif değil."
FEATURES_END = r"^(No \d|Bilgiler ilanın|Arşive alınma|Keşfet$)"
_TITLE_PRICE = r"-\s*([\d.,]+\s*[£€$₺]|[£€$₺]\s*[\d.,]+)\s*-"
_ARCHIVED_AT = r'(?is)Arşive alınma tarihi.{0,400}?<time[^>]*dateTime="([^"]+)"'
# fixed values: a line that is a price
_LINE_PRICE = r"^(?:[£₺$€]\s*[\d.,]+|[\d.,]+\s*[£₺$€])$"
# fixed values: when a whole archive was made at once, which is no time of a sale
BULK = ("2026-09-22 19:00:00", "2026-09-22 19:30:00")
_BARGAIN = r"(?iU)pazarl[ıi]k"
UNPRICED, SOLD, ARCHIVED = "fiyatsiz", "satildi", "arsiv"


def advert(**values: Column) -> Column:
    """The struct of an advert; what a page does not have is null."""
    return F.struct(*[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in KINDS.items()])


def _digits(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("int")


def _known(table: dict[str, str], word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(word))


def _place(ls: Column, label: str, after: Column | int = 0) -> Column:
    """1-based place of a line behind `after`, 0 if there is none."""
    after = F.greatest(after, F.lit(0)) if isinstance(after, Column) else F.lit(after)
    at = F.array_position(F.slice(ls, after + 1, F.greatest(F.size(ls), F.lit(0))), label)
    return F.when(at > 0, at + after).otherwise(0).cast("int")


def _value(ls: Column, label: str, after: Column | int = 0) -> Column:
    """The line behind a label."""
    at = _place(ls, label, after)
    return F.when(at > 0, F.get(ls, at))


def _between(ls: Column, start: Column, end: Column) -> Column:
    """Lines start + 1 to end - 1 (1-based), as one text."""
    return F.array_join(F.slice(ls, start + 1, F.greatest(end - start - 1, F.lit(0))), "\n")


def _block_end(ls: Column, start: Column, labels: list[str], most: int) -> Column:
    """The first of the labels behind start, at most `most` lines on."""
    last = F.least(F.size(ls) + 1, start + 1 + most)
    return F.least(last, *[F.when(p > 0, p).otherwise(last) for p in (_place(ls, label, start) for label in labels)])


def _price_fields(p: Column, raw: Column) -> dict[str, Column]:
    return {"price_raw": F.when(p.isNotNull(), raw), "price_amount": p["amount"], "currency": p["currency"], "currency_guess": F.coalesce(p["guess"], F.lit(False))}


def _signals(priced: Column, *first: str) -> Column:
    own = [F.lit(x) for x in first]
    without = F.array(*own, F.lit(UNPRICED))
    return F.when(~priced, without).otherwise(F.array(*own) if own else F.lit(None).cast("array<string>"))


def _bargain(text: Column, pattern: str = _BARGAIN) -> Column:
    return F.when(text != "", text.rlike(pattern))


def _day(text: Column, pattern: str) -> Column:
    """A date from the groups (day, month, year) of a pattern; the month by number or name."""
    d, m, y = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    names = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS, 1) for x in (name, i)])
    month = F.coalesce(m.try_cast("int"), F.try_element_at(names, tr_lower(m)))
    return F.try_to_date(F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def archived_at(html: Column) -> Column:
    """When a sold advert was put into the archive; null for the minute in which all old ones were."""
    t = F.regexp_extract(html, _ARCHIVED_AT, 1).try_cast("timestamp")
    return F.when(~t.between(F.lit(BULK[0]).cast("timestamp"), F.lit(BULK[1]).cast("timestamp")), t)


def _fuel(word: Column) -> Column:
    return F.coalesce(_known(FUEL, word), F.nullif(F.lower(word), F.lit("")))


def _features(ls: Column, start: Column) -> Column:
    """The lines of the block of features, up to what ends it."""
    rest = F.slice(ls, start + 1, F.greatest(F.size(ls), F.lit(0)))
    end = F.array_position(F.transform(rest, lambda line: line.rlike(FEATURES_END)), True)
    return F.when(end > 0, F.slice(rest, 1, end.cast("int"))).otherwise(rest)


def asks_for_price(ls: Column) -> Column:
    """The part of the page above the description asks to ask."""
    at = _place(ls, TEXT)
    return F.arrays_overlap(F.when(at > 0, F.slice(ls, 1, F.greatest(at - 1, F.lit(0)))).otherwise(ls), F.array(*[F.lit(x) for x in ASK_PRICE]))


def seller_of(html: Column, prefix: str) -> Column:
    handle = F.lower(F.regexp_extract(html, r"""(?i)<a\b[^>]*\bhref\s*=\s*["']/seller/([0-9a-fA-F-]{8,64})/?["']""", 1))
    return F.when(handle != "", F.concat(F.lit(prefix), handle))


def posted_phrase(ls: Column, today: Column) -> Column:
    """The day of "1 Ağustos eklendi", "3 gün önce eklendi", "dün eklendi" or "bugün eklendi": a month that is still to come was last year's."""
    line = F.get(F.filter(ls, lambda x: x.endswith("eklendi")), F.lit(0))
    dated = rf"(?iU)(\d{{1,2}}) ({'|'.join(MONTHS)}) eklendi$"
    this, last = (_day(F.concat_ws(" ", F.regexp_extract(line, dated, 1), F.regexp_extract(line, dated, 2), (F.year(today) - k).cast("string")), r"^(\d+) (\S+) (\d+)$") for k in (0, 1))
    ago = F.coalesce(F.regexp_extract(line, r"(\d+) gün önce eklendi$", 1).try_cast("int"), F.when(tr_lower(line).endswith("bugün eklendi"), 0), F.when(tr_lower(line).endswith("dün eklendi"), 1))
    return F.when(line.rlike(dated), F.when(this > today, last).otherwise(this)).otherwise(F.date_sub(today, ago))


# What a page is read from, in columns that later steps share: _title, _lines, _tokens, _h1, _node, then layout, _raw (the price as written), _p (what it says),
# _text and _free (an advert in free words).


class _Layout:
    """One layout of a site's pages: when it is that of a page, the price as the page writes it, and the advert."""

    def __init__(self, name: str, when: Column, raw: Column, read: Callable[[Column, Column], Column]):
        self.name, self.when, self.raw, self.read = name, when, raw, read


def _sold(mark: str, signal: str, word: str) -> list[_Layout]:
    """Sold or archived adverts, in the old layout (block of archived data) and the new one (block of features). The last price asked is no price of a sale."""
    title, ls, html = F.col("_title"), F.col("_lines"), F.col("_html")
    at, archive, last = _place(ls, mark), _place(ls, ARCHIVE), _place(ls, LAST_PRICE)
    newer = (archive == 0) & (last > 0) & (last < at) & (_place(ls, FEATURES, at) > 0)

    def shown(f: Column, heads: Column, names: tuple[str, str], where: Column) -> Callable[[Column, Column], Column]:
        year = F.regexp_replace(F.coalesce(_value(f, "Yıl"), F.lit("")), "[^0-9]", "")

        def read(p: Column, raw: Column) -> Column:
            got = advert(
                brand=F.get(heads, F.lit(0)), model=F.get(heads, F.lit(1)), year=year.try_cast("int"), km=_digits(_value(f, "Kilometre")), fuel=_fuel(_value(f, names[0])),
                transmission=F.nullif(canon(_value(f, names[1]), GEARS), F.lit("")), location=where, raw_text=title, is_active=F.lit(False), signals=_signals(p.isNotNull(), signal),
                sold_at=archived_at(html) if signal == SOLD else F.lit(None), **_price_fields(p, raw),
            )
            return F.when(year != "", got)

        return read

    block, features = F.when(archive > 0, F.slice(ls, F.greatest(archive, F.lit(1)), F.size(ls))).otherwise(F.slice(ls, 1, 0)), _features(ls, _place(ls, FEATURES, at - 1))
    old_place = F.when((at > 5) & F.get(ls, at - 5).rlike(r"^\d+$"), F.get(ls, at - 6))
    mine, raw = title.contains(word) & (at > 2), F.get(ls, last)
    raw = F.when(last > 0, raw)
    new = mine & newer & (last > 2) & F.regexp_replace(_value(features, "Yıl"), "[^0-9]", "").rlike(r"^\d{4}$")
    return [
        _Layout(f"{signal}_features", new, raw, shown(features, F.slice(ls, F.greatest(last - 2, F.lit(1)), 2), ("Yakıt", "Vites"), _value(features, "Yer"))),
        _Layout(f"{signal}_block", mine & ~newer, raw, shown(block, F.slice(ls, F.greatest(at - 2, F.lit(1)), 2), ("Yakıt Tipi", "Vites"), old_place)),
    ]


def _labelled() -> _Layout:
    """Active adverts by labels; the price is that of the title, where no former price stands."""
    title, ls, html = F.col("_title"), F.col("_lines"), F.col("_html")
    start = F.greatest(_place(ls, DETAILS) - 1, F.lit(0))
    at = _place(ls, TEXT)
    explore = _place(ls, EXPLORE, at)
    desc = F.when(at > 0, _between(ls, at, F.when(explore > 0, explore).otherwise(F.least(F.size(ls) + 1, at + 41)))).otherwise("")
    swap = tr_lower(_value(ls, "Takaslı", start))
    day = F.get(F.filter(ls, lambda line: line.rlike(r"^\d{2}\.\d{2}\.\d{4}$")), F.lit(0))
    whole = F.concat(title, F.lit("\n"), desc)

    def read(p: Column, raw: Column) -> Column:
        got = advert(
            seller_handle=seller_of(html, "site:"), brand=_value(ls, "Marka", start), model=_value(ls, "Model", start), year=_digits(_value(ls, "Yıl", start)), km=_digits(_value(ls, "Kilometre", start)),
            fuel=_fuel(_value(ls, "Yakıt Tipi", start)), transmission=F.nullif(canon(_value(ls, "Vites", start), GEARS), F.lit("")), engine_l=engine_liters(_value(ls, "Motor Hacmi", start)),
            location=_value(ls, "Konum", start), steering=steering(whole), signals=_signals(p.isNotNull()), raw_text=whole, posted=_day(day, r"^(\d{2})\.(\d{2})\.(\d{4})$"), negotiable=_bargain(desc),
            swap=F.when(swap != "", ~(swap.startswith("takas edilemez") | swap.startswith("hayır"))), **_price_fields(p, raw),
        )
        return F.when(p.isNotNull() | asks_for_price(ls), got)

    labels = _value(ls, "Marka", start).isNotNull() & _value(ls, "Yıl", start).isNotNull()
    return _Layout("labels", labels, _price_in_title(title), read)


def _price_in_title(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, _TITLE_PRICE, 1), F.lit(""))


def _data() -> _Layout:
    """Adverts in the page's linked data only (a Vehicle): in stock, or without an offer where the page asks to ask for the price."""
    title, ls, v = F.col("_title"), F.col("_lines"), F.col("_node")
    offer = F.coalesce(F.get(H.field(v, "offers", "array<variant>"), F.lit(0)), H.field(v, "offers", "variant"))
    brand = F.coalesce(H.field(v, "brand.name"), F.when(~H.field(v, "brand").startswith("{"), H.field(v, "brand")))
    year = F.left(F.regexp_replace(F.coalesce(H.field(v, "vehicleModelDate"), H.field(v, "modelDate"), F.lit("")), "[^0-9]", ""), F.lit(4))
    stock = F.contains(F.coalesce(H.field(offer, "availability"), F.lit("")), F.lit("InStock"))
    km = F.coalesce(H.field(v, "mileageFromOdometer.value", "double"), H.field(v, "mileageFromOdometer", "double"))
    fuel, gear = F.lower(H.field(v, "fuelType")), F.lower(F.regexp_replace(H.field(v, "vehicleTransmission"), "^.*/", ""))
    desc = F.coalesce(F.trim(H.field(v, "description")), F.lit(""))
    whole = F.concat(title, F.lit("\n"), desc)
    day = F.coalesce(F.nullif(H.field(v, "datePosted"), F.lit("")), H.field(offer, "validFrom"))

    def read(p: Column, raw: Column) -> Column:
        amount = F.when(p.isNotNull(), p["amount"]).otherwise(H.field(offer, "price", "double"))
        currency = F.when(p.isNotNull(), p["currency"]).otherwise(H.field(offer, "priceCurrency"))
        good = F.coalesce((amount != 0) & currency.isin("GBP", "TRY", "EUR", "USD"), F.lit(False))
        return advert(
            brand=brand, model=H.field(v, "model"), year=year.try_cast("int"), km=F.when(F.coalesce(H.field(v, "mileageFromOdometer.unitCode") == "KMT", F.lit(True)), km).cast("int"),
            fuel=F.coalesce(*[F.when(F.contains(fuel, F.lit(w)), F.lit(name)) for w, name in DATA_FUEL]), transmission=_known(DATA_GEAR, gear),
            engine_l=engine_liters(F.coalesce(H.field(v, "vehicleEngine.engineDisplacement.value"), H.field(v, "vehicleEngine.engineDisplacement"))), location=H.field(offer, "areaServed.name"),
            steering=steering(whole), price_raw=F.when(good, raw), price_amount=F.when(good, amount), currency=F.when(good, currency), currency_guess=F.coalesce(p["guess"], F.lit(False)),
            signals=_signals(good), raw_text=whole, posted=F.left(day, F.lit(10)).try_cast("date"), negotiable=_bargain(desc),
        )

    shown = v.isNotNull() & (stock | (offer.isNull() & asks_for_price(ls))) & brand.isNotNull() & (F.length(year) == 4)
    return _Layout("data", shown, _price_in_title(title), read)


def _slides(today: Column) -> _Layout:
    """Active adverts in the layout of a slide counter ("1 / 5"), behind which year, make, model and price stand, with a block of features below."""
    title, ls, html = F.col("_title"), F.col("_lines"), F.col("_html")
    year_at = _place(ls, "Yıl")
    slides = F.filter(F.sequence(F.lit(1), F.greatest(year_at - 1, F.lit(1))), lambda i: F.get(ls, i - 1).rlike(r"^\d+ / \d+$"))
    at = F.coalesce(F.get(slides, F.size(slides) - 1), F.lit(0))
    ok = (year_at > 0) & (_place(ls, FEATURES) > 0) & (at > 0) & (year_at - at >= 4) & F.get(ls, at).rlike(r"^\d{4}$")
    head = F.slice(ls, at + 4, F.greatest(year_at - at - 4, F.lit(0)))
    ask = F.arrays_overlap(head, F.array(*[F.lit(x) for x in ASK_PRICE]))
    raw = F.when(~ask, F.get(F.filter(head, lambda line: line.rlike("[1-9]")), F.lit(0)))
    text_at = _place(ls, TEXT)
    desc = F.when(text_at > 0, _between(ls, text_at, _block_end(ls, text_at, [FEATURES, EXPLORE, SELLER], 40))).otherwise("")
    f, whole = _features(ls, _place(ls, FEATURES)), F.concat(title, F.lit("\n"), desc)

    def read(p: Column, raw_: Column) -> Column:
        got = advert(
            seller_handle=seller_of(html, "site:"), brand=F.get(ls, at + 1), model=F.get(ls, at + 2), year=F.left(F.regexp_replace(F.coalesce(_value(f, "Yıl"), F.get(ls, at)), "[^0-9]", ""), F.lit(4)).try_cast("int"),
            km=_digits(_value(f, "Kilometre")), fuel=_fuel(_value(f, "Yakıt")), transmission=F.nullif(canon(_value(f, "Vites"), GEARS), F.lit("")), engine_l=engine_liters(_value(f, "Motor hacmi")),
            location=_value(f, "Yer"), steering=steering(whole), signals=_signals(p.isNotNull()), raw_text=whole, posted=posted_phrase(ls, today), negotiable=_bargain(desc), **_price_fields(p, raw_),
        )
        return F.when(p.isNotNull() | ask, got)

    return _Layout("slides", ok, raw, read)


def _site_b() -> _Layout:
    """Pages with a node of the type Car; visible labels end in a colon. A title's model year below the field's wins: the field is often that of the import."""
    node, ls, html = F.col("_node"), F.col("_lines"), F.col("_html")
    offer = H.field(node, "offers", "variant")
    stated = F.coalesce(H.field(node, "vehicleModelDate", "int"), _digits(_value(ls, "Yıl:")))
    own = F.regexp_extract(F.lower(F.col("_h1")), r"^\s*((?:19|20)\d{2})\s+model\b", 1).try_cast("int")
    year = F.when((own >= 1970) & (own < stated), own).otherwise(stated)
    km = F.coalesce(F.nullif(H.field(node, "mileageFromOdometer.value", "double"), F.lit(0.0)).cast("int"), _digits(_value(ls, "Kilometre:")))
    side = tr_lower(_value(ls, "Direksiyon Tipi:"))
    place_at = _place(ls, "Konum Bilgisi")
    rest = F.slice(ls, place_at + 1, F.greatest(F.size(ls), F.lit(0)))
    others = F.array_position(F.transform(rest, lambda line: line.rlike(r"^\d{4} Model ")), True).cast("int")
    desc = F.when(place_at > 0, F.array_join(F.when(others > 0, F.slice(rest, 1, F.greatest(others - 1, F.lit(0)))).otherwise(rest), "\n")).otherwise("")
    about = F.coalesce(H.field(node, "description"), F.lit(""))
    place = F.coalesce(F.nullif(F.regexp_extract(about, r"(?U)\s–\s*([^.–]+?)\.\s*KKTC", 1), F.lit("")), F.nullif(F.regexp_extract(about, r"(?U)satılık[^(]*\(\s*([^,()\d][^,()]*?)\s*,", 1), F.lit("")))
    amount = F.nullif(H.field(offer, "price", "double"), F.lit(0.0))
    status = F.coalesce(_value(ls, "Araç Durumu:"), F.lit(""))
    galleries = F.exists(ls, lambda line: line.rlike(r"^(Galeri|Kurumsal)( satıcı| üye| Üye)?$"))
    private = F.arrays_overlap(ls, F.array(F.lit("Bireysel Üye"), F.lit("Bireysel satıcı")))
    out = F.contains(F.coalesce(H.field(offer, "availability"), F.lit("")), F.lit("OutOfStock"))

    def read(_p: Column, _raw: Column) -> Column:
        got = advert(
            brand=H.field(node, "brand.name"), model=H.field(node, "model"), year=year, km=km, fuel=_known(FUEL, _value(ls, "Yakıt Türü:")), transmission=_known(GEAR, _value(ls, "Vites Tipi:")),
            engine_l=engine_liters(_value(ls, "Motor Hacmi (cc):")), steering=F.when(side.contains("sağ"), "RHD").when(side.contains("sol"), "LHD"), location=F.trim(place),
            price_raw=F.when(amount.isNotNull(), F.concat_ws(" ", H.field(offer, "price"), H.field(offer, "priceCurrency"))), price_amount=amount, currency=F.nullif(H.field(offer, "priceCurrency"), F.lit("")),
            currency_guess=F.lit(False), signals=_signals(amount.isNotNull()), negotiable=_bargain(desc), seller_handle=F.coalesce(H.field(node, "author.name"), H.field(offer, "seller.name")),
            raw_text=F.array_join(F.filter(F.array(F.coalesce(H.field(node, "name"), F.lit("")), F.when(tr_lower(status).contains("plaka"), status).otherwise(""), desc), lambda x: x != ""), "\n"),
            posted=F.coalesce(_day(_value(ls, "İlan Tarihi:"), r"^(\d{1,2})\s+(\S+)\s+(\d{4})$"), F.left(H.field(node, "datePublished"), F.lit(10)).try_cast("date")),
            seller_phone=F.nullif(F.regexp_extract(html, r"https://wa\.me/(\d{10,15})", 1), F.lit("")), seller_type=F.when(private, "bireysel").when(galleries, "galeri").otherwise("bilinmiyor"),
        )
        return F.when(out, advert(is_active=F.lit(False), signals=F.array(F.lit(SOLD)))).when(stated.isNotNull(), got)

    return _Layout("b", node.isNotNull(), F.lit(None).cast("string"), read)


# fixed values: words at the end of a title that are no model
TITLE_TAIL = ["otomatik", "manual", "manuel", "cvt", "düz", "2", "3", "4"]


def _model_in_title(title: Column, brand: Column, year: Column) -> Column:
    t = F.regexp_replace(title, F.concat(F.lit("^"), year.cast("string"), F.lit(r"\s+")), "")
    cut = t
    for b in (brand, F.replace(brand, F.lit("-"), F.lit(" "))):
        cut = F.when((cut == t) & F.lower(t).startswith(F.concat(F.lower(b), F.lit(" "))), F.substr(t, F.length(b) + 2)).otherwise(cut)
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(cut, t), rf"(?iU)(?:(?:^|\s+)(?:{'|'.join(TITLE_TAIL)}))+$", "")), F.lit(""))


def _named(name: str) -> Column:
    """The value of a page's field (an element with the title, one with the value)."""
    return F.get(F.filter("_fields", lambda f: f["name"] == name), F.lit(0))["value"]


def _plain(amount: Column, currency: Column) -> Column:
    return F.when(amount.isNotNull(), F.concat_ws(" ", F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), r"\.?0+$", ""), currency))


def _site_c() -> _Layout:
    """Pages whose fields are elements (a title and a value each); the make is that of the breadcrumb in the linked data, the model that of the heading."""
    title, node, ts = F.col("_h1"), F.col("_node"), F.col("_tokens")
    item = F.filter(H.field(node, "itemListElement", "array<variant>"), lambda n: F.contains(F.coalesce(H.field(n, "item"), F.lit("")), F.lit("/marka/")))
    brand, year = H.field(F.get(item, F.lit(0)), "name"), _digits(_named("Yıl"))
    desc = F.coalesce(F.col("_desc"), F.lit(""))
    day = F.get(F.filter("_lines", lambda line: line.rlike(r"^\d{2}/\d{2}/\d{4}$")), F.lit(0))

    def read(p: Column, _raw: Column) -> Column:
        return advert(
            brand=brand, model=_model_in_title(title, brand, year), year=year, km=_digits(_named("Kilometre")), fuel=_known(FUEL, _named("Yakıt Tipi")), transmission=_known(GEAR, _named("Vites")),
            engine_l=engine_liters(_named("Motor Hacmi (cc)")), price_raw=_plain(p["amount"], p["currency"]), price_amount=p["amount"], currency=p["currency"], currency_guess=F.lit(False),
            signals=_signals(p.isNotNull()), raw_text=F.array_join(F.filter(F.array(title, desc), lambda x: x != ""), "\n"), posted=_day(day, r"^(\d{2})/(\d{2})/(\d{4})$"), negotiable=_bargain(desc),
            seller_phone=normalize_phone(F.col("_phone")), seller_type=F.lit("bilinmiyor"),
        )

    good = title.isNotNull() & (F.size(H.places(ts, "listing-detail-detail")) > 0) & year.isNotNull()
    return _Layout("c", good, F.regexp_replace(F.col("_price"), r"\s+", ""), read)


def _site_d() -> _Layout:
    """Pages whose labels end in a colon, read beside the card of the list (_card: item_id, title, price, url, label); null if the page bears another number."""
    ls, card = F.col("_lines"), F.col("_card")

    def named(label: str) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1))), lambda i: (F.get(ls, i - 1) == label) & F.get(ls, i).isNotNull() & ~F.get(ls, i).endswith(":"))
        return F.get(ls, F.get(hits, F.lit(0)))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1))), lambda i: F.get(ls, i - 1).isin("2. El Araçlar", "Sıfır Km Araçlar") & F.get(ls, i + 2).isNotNull() & ~F.get(ls, i).startswith("("))
    crumb, safety = F.get(starts, F.lit(0)), _place(ls, "Güvenlik")
    seller = F.when((safety > 0) & F.get(ls, safety + 1).contains(" / "), F.get(ls, safety))
    slashes = F.filter(F.sequence(F.lit(2), F.greatest(F.size(ls), F.lit(2))), lambda i: (F.get(ls, i - 1) == "/") & F.get(ls, i).isNotNull() & F.array_contains(F.slice(ls, i + 2, 2), "İlan No:"))
    slash = F.get(slashes, F.lit(0))
    number, side = F.regexp_replace(F.coalesce(named("İlan No:"), F.lit("")), "[^0-9]", ""), tr_lower(named("Direksiyon Tipi:"))

    def read(p: Column, raw: Column) -> Column:
        return advert(
            brand=F.get(ls, crumb + 1), model=F.get(ls, crumb + 2), year=_digits(named("Yıl:")), km=F.nullif(_digits(named("Kilometre:")), F.lit(0)), fuel=_known(FUEL, named("Yakıt Türü:")),
            transmission=F.nullif(canon(named("Vites Tipi:"), GEARS), F.lit("")), steering=F.when(side.contains("sağ"), "RHD").when(side.contains("sol"), "LHD"),
            location=F.when(slash.isNotNull(), F.concat(F.get(ls, slash - 2), F.lit(" / "), F.get(ls, slash))), raw_text=card["title"], posted=_day(named("İlan Tarihi:"), r"^(\d{1,2}) (\S+) (\d{4})$"),
            seller_handle=seller, seller_type=F.when((seller == F.upper(seller)) & seller.rlike(r"\p{Lu}"), "galeri").otherwise("bilinmiyor"), signals=_card_signals(p), **(_price_fields(p, raw) | {"price_raw": raw}),
        )

    return _Layout("d", named("Yıl:").isNotNull() & ((number == "") | (number == card["item_id"])), card["price"], read)


def _card_signals(p: Column) -> Column:
    return F.when(p.isNull(), F.array(F.lit(UNPRICED))).otherwise(F.array().cast("array<string>"))


# fixed values: places in the addresses of cards
CARD_PLACES = ["lefkosa", "girne", "gazimagusa", "magusa", "iskele", "guzelyurt", "lefke", "lapta", "alsancak", "other"]


def card_advert(card: Column, p: Column) -> Column:
    """The advert that a card alone gives: title "2013 Model Otomatik ...", label "make model", fuel and place from the words of its address. p: what its price says."""
    words = F.split(F.regexp_replace(F.rtrim(card["url"], F.lit("/")), "^.*/", ""), "-")
    pattern = r"(?U)^(\d{4}) Model (\w+) "
    got = advert(
        brand=F.split_part(card["label"], F.lit(" "), F.lit(1)), model=F.nullif(F.regexp_replace(card["label"], r"^\S* ?", ""), F.lit("")), year=F.regexp_extract(card["title"], pattern, 1).try_cast("int"),
        transmission=canon(F.regexp_extract(card["title"], pattern, 2), GEARS), fuel=F.get(F.filter(F.transform(words, lambda w: _known(FUEL, w)), lambda w: w.isNotNull()), F.lit(0)),
        location=F.get(F.filter(words, lambda w: w.isin(CARD_PLACES)), F.lit(0)), raw_text=card["title"], signals=_card_signals(p), seller_type=F.lit("bilinmiyor"), **(_price_fields(p, card["price"]) | {"price_raw": card["price"]}),
    )
    return F.when(card["title"].rlike(pattern) & (card["label"] != ""), got)


def cards(html: Column) -> Column:
    """Array of (item_id, url, title, price, label, photo) of the cards of a list page."""

    def of(ts: Column) -> Column:
        def card(i: Column) -> Column:
            def inner(e: Column) -> Column:
                def text_of(name: str, tag: str | None = None) -> Column:
                    spots = F.filter(H.places(ts, name, i), lambda k: k < e["end"])
                    at = F.get(spots, F.lit(0))
                    if tag:
                        every = F.filter(F.sequence(at, e["end"]), lambda k: F.coalesce((F.get(ts, k)["tag"] == tag) & ~F.get(ts, k)["closes"], F.lit(False)))
                        at = F.when(at.isNotNull(), F.get(every, F.lit(0)))
                    return F.coalesce(F.when(at.isNotNull(), H.element(ts, at)["flat"]), F.lit(""))

                heads = F.filter(F.sequence(i, e["end"]), lambda k: F.coalesce((F.get(ts, k)["tag"] == "h3") & ~F.get(ts, k)["closes"], F.lit(False)))
                head = F.get(heads, F.lit(0))
                url = F.get(ts, i)["raw"]
                link = unescaped_attribute(url, "href")
                photos = F.filter(F.sequence(i, e["end"]), lambda k: F.coalesce(F.get(ts, k)["tag"] == "img", F.lit(False)))
                return F.struct(
                    F.regexp_extract(link, r"/(\d{5,})-", 1).alias("item_id"), link.alias("url"), F.coalesce(F.when(head.isNotNull(), H.element(ts, head)["flat"]), F.lit("")).alias("title"), text_of("fiyat").alias("price"),
                    text_of("resim", "span").alias("label"), unescaped_attribute(F.get(ts, F.get(photos, F.lit(0)))["raw"], "src").alias("photo"),
                )

            return let(H.element(ts, i), inner)

        return F.filter(F.transform(H.places(ts, "ilan"), card), lambda c: c["item_id"] != "")

    return let(H.tokens(html), of)


def unescaped_attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)""", 1)
    return F.nullif(H.unescaped(value), F.lit(""))


def merged(card: Column, page: Column) -> Column:
    """(advert, conflicts): what the card has stays; mileage, day, seller, steering and an unknown place come from the page. Fields in which both differ are named."""
    fill = ["km", "posted", "seller_handle", "steering"]
    out = card
    for f in fill:
        out = out.withField(f, F.coalesce(card[f], page[f]))
    unknown = F.coalesce(card["location"].isin("", "other"), F.lit(True))
    out = out.withField("location", F.when(unknown & (page["location"] != ""), page["location"]).otherwise(card["location"]))

    def low(c: Column) -> Column:
        return F.lower(F.trim(c))

    differ = [F.when(F.coalesce(low(card[f].cast("string")) != low(page[f].cast("string")), F.lit(False)), f) for f in ("year", "brand", "fuel", "transmission")]
    model = F.when(F.coalesce((low(card["brand"]) == low(page["brand"])) & (low(card["model"]) != low(page["model"])), F.lit(False)), "model")
    return F.struct(out.alias("advert"), F.array_compact(F.array(*differ[:2], model, *differ[2:])).alias("conflicts"))


def _site_e() -> _Layout:
    """Pages of a general market: price and currency are those of the Product node, the rest of the advert is free text (_text, read as _free)."""
    node, ls, p = F.col("_node"), F.col("_lines"), F.col("_free")
    offer = H.field(node, "offers", "variant")
    amount, currency = H.field(offer, "price", "double"), H.field(offer, "priceCurrency")
    phones = F.filter(F.transform(F.filter(ls, lambda x: ~x.contains("X")), lambda x: normalize_phone(F.regexp_extract(x, r"\+?90\s*5\d{9}", 0))), lambda x: x.isNotNull())
    good = node.isNotNull() & (amount > 0) & currency.isin("GBP", "TRY", "EUR", "USD")

    def read(_p: Column, _raw: Column) -> Column:
        got = advert(
            **{f: p[f] for f in ("brand", "model", "year", "km", "fuel", "transmission", "steering", "price_raw", "negotiable", "swap")},
            location=F.coalesce(H.field(offer, "availableAtOrFrom.address.addressLocality"), p["location"]), price_amount=amount, currency=currency, currency_guess=F.lit(False),
            seller_phone=F.get(phones, F.lit(0)), raw_text=F.col("_text"), posted=F.left(H.field(offer, "validFrom"), F.lit(10)).try_cast("date"), seller_type=F.lit("bilinmiyor"),
        )
        return F.when(p.isNotNull(), got)

    return _Layout("e", F.coalesce(good, F.lit(False)), F.lit(None).cast("string"), read)


def _site_f() -> _Layout:
    """Pages with a table of attributes (name element, value element behind it); a year, mileage or price that the table lacks is read from the description."""
    title, desc, free = F.col("_h1"), F.coalesce(F.col("_desc"), F.lit("")), F.col("_free")
    low = tr_lower(desc)
    side = F.when(low.rlike(r"d[üu]men\s*:?\s*sa[gğ]|sa[gğ] direksiyon|sa[gğ]dan direksiyon"), "RHD").when(low.rlike(r"d[üu]men\s*:?\s*sol|sol direksiyon|soldan direksiyon"), "LHD")
    phone = normalize_phone(F.regexp_extract(desc, r"(?<!\d)(?:\+?90)?\s?0?5\d{2}[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}(?!\d)", 0))
    said = F.regexp_extract(without_mobiles(F.col("_text")), r"(?<![\d.,])(19[89]\d|20[0-2]\d)(?![\d.,]?\d)", 1)
    year = F.coalesce(_digits(_named("Yılı")), free["year"], said.try_cast("int"))
    km = F.coalesce(_digits(F.replace(F.split_part(_named("Kilometre"), F.lit("."), F.lit(1)), F.lit(","), F.lit(""))), free["km"])

    def read(p: Column, _raw: Column) -> Column:
        amount, currency = F.coalesce(p["amount"], free["price_amount"]), F.when(p.isNotNull(), p["currency"]).otherwise(free["currency"])
        got = advert(
            brand=_named("Marka"), model=_named("Model"), year=year, km=km, fuel=_known(FUEL, _named("Yakıt Türü")), transmission=_known(GEAR, _named("Şanzıman")), engine_l=engine_liters(_named("Motor gücü")),
            steering=side, location=F.nullif(_named("Bölge"), F.lit("Belirtilmemiş")), price_raw=_plain(amount, currency), price_amount=amount, currency=currency, currency_guess=F.lit(False),
            signals=_signals(amount.isNotNull()), raw_text=F.array_join(F.filter(F.array(title, desc), lambda x: x != ""), "\n"), posted=F.left(H.field(F.col("_node"), "datePublished"), F.lit(10)).try_cast("date"),
            negotiable=_bargain(desc, r"(?iU)pazarl[ıi]k\s*(var|pay|yap)"), seller_phone=phone, seller_type=F.when(F.array_contains("_lines", "Özel Satıcı"), "bireysel").otherwise("bilinmiyor"),
        )
        return F.when(year.isNotNull(), got)

    raw = F.when(F.col("_price").rlike(r"\d"), F.regexp_replace(F.col("_price"), r"\s+", ""))
    return _Layout("f", (_named("Marka") != "") & title.isNotNull(), raw, read)


def _fields_of(ts: Column) -> Column:
    """Array of (name, value) of a page's field elements, of either kind."""

    def titled(i: Column) -> Column:
        value = F.get(H.places(ts, "content-value", i), F.lit(0))
        return F.struct(H.element(ts, i)["flat"].alias("name"), F.when(value.isNotNull(), H.element(ts, value)["flat"]).alias("value"))

    def in_table(i: Column) -> Column:
        def value(e: Column) -> Column:
            next_ = F.get(F.filter(F.sequence(e["end"], F.greatest(F.size(ts), e["end"])), lambda k: F.get(ts, k)["tag"].isNotNull() & ~F.get(ts, k)["closes"]), F.lit(0))
            return F.struct(F.rtrim(e["flat"], F.lit(":")).alias("name"), F.when(next_.isNotNull(), H.element(ts, next_)["flat"]).alias("value"))

        return let(H.element(ts, i), value)

    return F.concat(F.transform(H.places(ts, "field-title"), titled), F.transform(H.places(ts, "vehica-car-attributes__name"), in_table))


def _inside(ts: Column, box: str, name: str) -> Column:
    """The text of the first element of a class inside the first element of another."""

    def of(b: Column) -> Column:
        at = F.get(F.filter(H.places(ts, name, b["start"]), lambda i: i < b["end"]), F.lit(0))
        return F.when(at.isNotNull(), H.element(ts, at)["flat"])

    return let(H.first_element(ts, box), of)


# fixed values: the type of the linked data that each site's advert is in (f: the first node with a date)
NODE_TYPES = {"a": "Vehicle", "b": "Car", "c": "BreadcrumbList", "e": "Product"}


def read_pages(pages: DataFrame, today: Column, newest_year: Column, site: str = "site", html: str = "html", card: str | None = None) -> DataFrame:
    """pages with advert (a struct of KINDS, null where no layout of its site fits) and layout. Each step is one projection that the later ones share: texts and
    tags of a page are cut once, its price is read once, whatever its layout."""
    s = F.col(site)
    d = pages.withColumn("_html", F.coalesce(html, F.lit("")))
    d = d.withColumns({"_title": H.title(F.col("_html")), "_lines": H.lines(F.col("_html")), "_tokens": F.when(s.isin("b", "c", "f"), H.tokens(F.col("_html"))), "_nodes": H.embedded(F.col("_html"))})
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair]), s)
    nodes, ts = F.col("_nodes"), F.col("_tokens")
    d = d.withColumns(
        {
            "_node": F.get(F.filter(nodes, lambda n: F.when(s == "f", H.field(n, "datePublished").isNotNull()).otherwise(F.exists(F.coalesce(H.field(n, "@type", "array<string>"), F.array(H.field(n, "@type"))), lambda t: t == wanted))), F.lit(0)),
            "_h1": H.first_tag(ts, "h1"), "_fields": F.when(s.isin("c", "f"), _fields_of(ts)), "_phone": F.when(s == "c", _inside(ts, "agent-phone", "phone")),
            "_price": F.when(s == "c", _inside(ts, "listing-detail-price", "main-price")).when(s == "f", H.first_element(ts, "vehica-car-price")["flat"]),
            "_desc": F.when(s == "c", H.first_text(ts, "listing-detail-description")).when(s == "f", F.coalesce(H.first_text(ts, "vehica-car-description__inner"), H.first_text(ts, "vehica-car-description"))),
            "_card": F.col(card) if card else F.lit(None).cast("struct<item_id:string,url:string,title:string,price:string,label:string>"),
        }
    )
    a = [*_sold(SOLD_MARK, SOLD, "Satıldı"), *_sold(ARCHIVE_MARK, ARCHIVED, "İlan arşivi")]
    closed = F.col("_title").contains("Satıldı") | F.col("_title").contains("İlan arşivi")
    layouts = [(x.when & (s == "a"), x) for x in a] + [(x.when & (s == "a") & ~closed, x) for x in (_labelled(), _data(), _slides(today))]
    layouts += [(x.when & (s == x.name), x) for x in (_site_b(), _site_c(), _site_d(), _site_e(), _site_f())]
    which = F.coalesce(*[F.when(F.coalesce(when, F.lit(False)), x.name) for when, x in layouts])
    d = d.withColumn("layout", which)
    ls, at = F.col("_lines"), _place(F.col("_lines"), "İlan Açıklaması")
    rest = F.slice(ls, at + 1, F.greatest(F.size(ls), F.lit(0)))
    stop = F.array_position(F.transform(rest, lambda line: line.rlike(_LINE_PRICE)), True).cast("int")
    about = F.when(at > 0, F.array_join(F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest), "\n")).otherwise("")
    offer = H.field(F.col("_node"), "offers", "variant")
    d = d.withColumns(
        {
            "_raw": F.coalesce(*[F.when(F.col("layout") == x.name, x.raw) for _, x in layouts]),
            "_text": F.when(F.col("layout") == "e", F.concat(F.trim(F.coalesce(H.field(F.col("_node"), "name"), F.lit(""))), F.lit("\n"), about)).when(F.col("layout") == "f", F.concat(F.col("_h1"), F.lit("\n"), F.coalesce("_desc", F.lit("")))),
            "_known": F.when(F.col("layout") == "e", F.struct(H.field(offer, "price", "double").alias("amount"), H.field(offer, "priceCurrency").alias("currency"))),
        }
    )
    d = d.withColumns({"_p": parse_price(F.col("_raw")), "_free": parse_freetext(F.col("_text"), newest_year, known_price=F.col("_known"))})
    found = F.coalesce(*[F.when(F.col("layout") == x.name, x.read(F.col("_p"), F.col("_raw"))) for _, x in layouts])
    return d.select(*pages.columns, "layout", found.alias("advert"))


def site_g(html: Column) -> Column:
    """Array of (item_id, active, advert): a list page that carries its adverts as JSON in an attribute."""
    page = F.try_parse_json(H.unescaped(F.regexp_extract(html, r'data-page="([^"]*)"', 1)))
    symbols = {"£": "GBP", "₺": "TRY", "$": "USD", "€": "EUR", "GBP": "GBP", "TRY": "TRY", "USD": "USD", "EUR": "EUR"}

    def item(x: Column) -> Column:
        amount = F.when(H.field(x, "price", "double") > 0, H.field(x, "price", "double"))
        phones = F.coalesce(*[normalize_phone(H.field(x, f"contact_info.{k}")) for k in ("mobile", "whatsapp")])
        known = F.create_map(*[F.lit(v) for pair in symbols.items() for v in pair])
        texts = F.filter(F.array(*[F.trim(F.coalesce(H.field(x, k), F.lit(""))) for k in ("title", "headline", "text")]), lambda t: t != "")
        got = advert(
            price_amount=amount, currency=F.when(amount.isNotNull(), F.try_element_at(known, H.field(x, "currency"))), posted=H.field(x, "published_at").try_cast("timestamp").cast("date"), seller_phone=phones,
            raw_text=F.array_join(texts, "\n"), signals=_signals(amount.isNotNull()),
        )
        expired, deleted = F.coalesce(H.field(x, "is_expired_for_search", "boolean"), F.lit(False)), H.field(x, "deleted_at").isNotNull()
        return F.struct(H.field(x, "uuid").alias("item_id"), (F.coalesce(H.field(x, "status") == "approved", F.lit(False)) & ~expired & ~deleted).alias("active"), got.alias("advert"))

    return F.transform(H.field(page, "props.listings.data", "array<variant>"), item)
