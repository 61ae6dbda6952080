"""What the text of an advert says: traps, warnings, plates, customs, urgency, steering, sold posts and unnamed costs, as columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.functions.numbers import let
from advertlake.functions.text import tr_lower

# fixed values: rule tables of name and pattern, for lower-case text
BLOCKING = {
    "pert/ağır hasar": r"\bpert\b(?!\s*(kayd[ıi]\s*)?(yok|de[gğ]il|olmayan))|\ba[gğ][ıi]r hasar(?!s[ıi]z)(?!\s*(kayd[ıi]\s*)?(yok|de[gğ]il))",
    "airbag açık/patlak": r"airbag(ler)?\s*(a[çc][ıi]k|patlak|patlam[ıi][şs]|yok)",
    "vuruk/su basmış": r"\bvuruk\b|su bas(m[ıi][şs]|k[ıi]n)|sel (hasar|bask[ıi]n)",
    "hasarlı": r"hasarl[ıi]|kazal[ıi]|hasar kay[ıi]tl[ıi]",
    "motor/şanzıman sorunlu": r"motor(u)? (sorunlu|ar[ıi]zal[ıi]|bozuk)|[sş]anz[ıi]man(ı)? (sorunlu|ar[ıi]zal[ıi]|bozuk)",
    "as is / parça": r"\bas is\b|par[çc]a ara[çc]|par[çc]alik|[çc][ıi]kma motor|y[üu]r[üu]m[ıi]yor|[çc]al[ıi][şs]m[ıi]yor",
    "kira/taksit": r"\baylik\b|\baylık\b|taksit(le)? (ile )?sat[ıi][şs]|pe[şs]inat",
    "kredi devri/senet": r"kredi\s*dev[ıi]?r|kredi(yi)?\s*devral|devral[ıi]nacak\s*kredi|devir\s*kredi|\bsenet(le|li)?\b(?!\s*(yok|yoktur|de[gğ]il|istenmez|aranmaz))",
    "gümrüksüz/evraksız": r"g[üu]mr[üu]ks[üu]z|g[üu]mr[üu][kğg][üu]?\s*(borc|yok|[öo]denmemi[şs]|[öo]denmedi)|evraks[ıi]z|evrak[ıi]?\s*(yok|eksik)\b|haciz|[iı]cral[ıi]k|mahkeme",
}
PLATE = {"TR/yabancı plaka": r"\btr\s*plaka|t[üu]rkiye\s*plaka|\btc\s*plaka|yabanc[ıi]\s*plaka|\bplaka\s*tr\b"}
CUSTOMS_OK = r"g[üu]mr[üu]kl[üu]|g[üu]mr[üu][kğg][üu]?\s*([öo]dendi|tamam|[öo]denmi[şs])|evrak(lar[ıi])?\s*tam"
WARNING = {
    "değişen var": r"de[gğ]i[şs]en(i)? var|de[gğ]i[şs]enli",
    "ufak masraf var": r"ufak (tefek )?(masraf|tamir)|k[üu][çc][üu]k (masraf|tamir)|masraf[ıi] var",
    "modifiyeli": r"stage ?[123]|chip ?tuning|modifiye|\b\d{3}\+? ?hp\b",
}
COST_UNKNOWN = r"masraf(?:[ıi]|lar[ıi])?\s+(?:var|mevcut)"
COST_MINOR = r"ufak|tefek|k[üu][çc][üu]k|\baz\b|biraz|kozmetik|kaporta|boya|lastik|[öo]n d[üu]zen|\d"
URGENCY = {
    "acil": r"\bacil\b|\bacele\b|ihtiya[çc]tan|\burgent\b|must sell|quick sale|need(s)? gone|срочно",
    "mezun/ayrılıyor": r"mezun|adadan ayr[ıi]l|ayr[ıi]l[ıi]yorum|gidiyorum|kesin d[öo]n[üu][şs]|d[öo]n[üu][şs] (?:nedeniyle|sebebiyle|dolay[ıi]s[ıi]yla)|t[üu]rkiye.{0,3} d[öo]n[üu][şs]|d[öo]n[üu]yorum|yurt ?d[ıi][şs][ıi]na|ta[şs][ıi]n[ıi]yorum|tayin|terhis|leaving|relocat|moving (back|abroad|to)|graduat|уезжаю",
    "nakit/borç": r"nakit ihtiya|bor[çc]tan|borcum|zarar[ıi]na|kelepir",
    "pazarlık": r"pazarl[ıi]k (pay[ıi] )?(var|mevcut)|pazarl[ıi]k yap[ıi]l[ıi]r",
}
LEFT_HAND, RIGHT_HAND = r"\bsol\s+(direksiyon|dumen|dümen)|\blhd\b|left[\s-]*hand", r"\bsa[ğg]\s+(direksiyon|dumen|dümen)|\brhd\b|right[\s-]*hand"
SOLD, ADVERT_NO = r"sat[ıi]ld[ıi]|sat[ıi]lm[ıi][şs]", r"[İIi]lan\s*(?:Numaras[ıi]|No)\s*[:.]?\s*\W{0,4}(\d{3,8})"


# fixed values: by pattern, words of which every match holds at least one; for the case-insensitive ones in the letters of `_plain`
_CUSTOMS = ("gümr", "gumr", "evrak")
STEMS = {
    BLOCKING["pert/ağır hasar"]: ("pert", "r hasar"),
    BLOCKING["airbag açık/patlak"]: ("airbag",),
    BLOCKING["vuruk/su basmış"]: ("vuruk", "su bas", "sel hasar", "sel bask"),
    BLOCKING["hasarlı"]: ("hasarl", "kazal", "hasar kay"),
    BLOCKING["motor/şanzıman sorunlu"]: ("motor ", "motoru ", "anzıman", "anziman"),
    BLOCKING["as is / parça"]: ("as is", "ça ara", "ca ara", "çalik", "calik", "kma motor", "mıyor", "miyor"),
    BLOCKING["kira/taksit"]: ("aylik", "aylık", "taksit", "peşinat", "pesinat"),
    BLOCKING["kredi devri/senet"]: ("kredi", "senet"),
    BLOCKING["gümrüksüz/evraksız"]: (*_CUSTOMS, "haciz", "cral", "mahkeme"),
    PLATE["TR/yabancı plaka"]: ("plaka",),
    CUSTOMS_OK: _CUSTOMS,
    WARNING["değişen var"]: ("eğişen", "eğisen", "egişen", "egisen"),
    WARNING["ufak masraf var"]: ("masraf", "tamir"),
    WARNING["modifiyeli"]: ("stage", "tuning", "modifiye", "hp"),
    COST_UNKNOWN: ("masraf",),
    URGENCY["acil"]: ("acil", "acele", "ihtiyaçtan", "ihtiyactan", "urgent", "must sell", "quick sale", "need gone", "needs gone", "срочно"),
    URGENCY["mezun/ayrılıyor"]: (
        "mezun", "adadan ayr", "yorum", "kesin d", "nedeniyle", "sebebiyle", "dolay", "rkiye", "yurt", "tayin", "terhis", "leaving", "relocat", "moving ", "graduat", "уезжаю",
    ),
    URGENCY["nakit/borç"]: ("nakit ihtiya", "borçtan", "borctan", "borcum", "zarar", "kelepir"),
    URGENCY["pazarlık"]: ("pazarl",),
    LEFT_HAND: ("direksiyon", "dumen", "dümen", "lhd", "left"),
    RIGHT_HAND: ("direksiyon", "dumen", "dümen", "rhd", "right"),
    SOLD: ("satil",),
    ADVERT_NO: ("ilan",),
}


def lowered(text: Column) -> Column:
    """The lower-case text that the rules read; lower case is most of their work, so a caller of several gives them one column of it."""
    return tr_lower(F.coalesce(text, F.lit("")))


def _plain(low: Column) -> Column:
    """A lower-case text in which all letters are one that a pattern without case takes for the same: both kinds of i, and the long s."""
    return F.replace(F.replace(low, F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def _holds(text: Column, pattern: str) -> Column:
    """The text holds a word that every match of the pattern holds: a plain search, so that few texts go through the pattern."""
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in STEMS[pattern]])


def _says(text: Column, pattern: str) -> Column:
    """The pattern occurs in a lower-case text, with letters and word ends of all alphabets."""
    found = text.rlike(f"(?U)(?:{pattern})")
    return _holds(text, pattern) & found if pattern in STEMS else found


def scan(text: Column, table: dict[str, str], low: Column | None = None) -> Column:
    """Names of a rule table that the text matches, in the table's order; a null text matches none."""
    return let(lowered(text) if low is None else low, lambda t: F.array_compact(F.array(*[F.when(_says(t, p), n) for n, p in table.items()])))


def customs_stated(text: Column, low: Column | None = None) -> Column:
    return _says(lowered(text) if low is None else low, CUSTOMS_OK)


def cost_unknown(text: Column, low: Column | None = None) -> Column:
    """A cost is named without its size: in the 25 characters before one of its mentions nothing makes it small or definite. A mention has ten characters
    at least, so that three of them and what lies between fill the 25."""

    def open_(v: Column) -> Column:
        def before(k: Column) -> Column:
            first = F.greatest(F.lit(0), k - 3)
            near = F.transform(F.slice(v["parts"], first + 1, k + 1 - first), lambda p, i: F.when(first + i < k, F.concat(p, F.get(v["said"], first + i))).otherwise(p))
            return F.right(F.array_join(near, ""), F.lit(25))

        places = F.filter(F.sequence(F.lit(0), F.size(v["parts"]) - 1), lambda k: k < F.size(v["parts"]) - 1)
        return F.exists(places, lambda k: ~_says(before(k), COST_MINOR))

    def cut(t: Column) -> Column:
        return F.struct(F.split(t, f"(?U){COST_UNKNOWN}", -1).alias("parts"), F.regexp_extract_all(t, F.lit(f"(?U){COST_UNKNOWN}"), F.lit(0)).alias("said"))

    return let(lowered(text) if low is None else low, lambda t: F.when(_holds(t, COST_UNKNOWN), let(cut(t), open_)).otherwise(False))


def steering(text: Column, low: Column | None = None) -> Column:
    """LHD or RHD where the text says one of them, null where it says none or both."""
    left, right = (text.rlike(f"(?iU)(?:{x})") for x in (LEFT_HAND, RIGHT_HAND))
    if low is not None:
        held = let(_plain(low), lambda p: F.struct(_holds(p, LEFT_HAND).alias("left"), _holds(p, RIGHT_HAND).alias("right")))
        left, right = held["left"] & left, held["right"] & right
    return let(F.struct(left.alias("left"), right.alias("right")), lambda v: F.when(v["left"] & ~v["right"], "LHD").when(v["right"] & ~v["left"], "RHD"))


def sold_number(text: Column, low: Column | None = None) -> Column:
    """Advert number that a sold post closes."""
    n = F.nullif(F.regexp_extract(text, f"(?iU){ADVERT_NO}", 1), F.lit(""))
    sold = text.rlike(f"(?iU)(?:{SOLD})")
    return F.when(sold if low is None else let(_plain(low), lambda p: _holds(p, SOLD) & _holds(p, ADVERT_NO)) & sold, n)
