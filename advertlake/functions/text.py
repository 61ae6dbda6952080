"""Text rules as columns: phones, links, masks, engine size, steering, flags and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.functions.numbers import let

# fixed values: a number as an advert gives it, any number that may be one, and an address of mail
_PHONE = r"(?<![\d+])(?:(?:\+|00)?\s*90[\s.\-]*)?\(?0?(?:5\d\d|392)\)?[\s.\-]*\d{3}[\s.\-]*\d{2}[\s.\-]*\d{2}(?!\d)"
_ANY_PHONE = r"(?<!\d)(?:\+|00)?\d(?:[\s.\-()]?\d){8,13}(?!\d)"
_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"


def tr_lower(text: Column) -> Column:
    """Lower case with the dotted and dotless i of Turkish kept apart."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def mentions(text: Column, pattern: str, reach: int) -> Column:
    """Array of (hit, before, after, left, right) for each place of a pattern: the `reach` characters around it, and the text up to the neighbouring
    places (its middle left out where it is long). A hit has at least one character, so a bounded number of neighbours fills the reach: the
    work grows with the text, not with the square of its hits."""

    def around(v: Column) -> Column:
        def ends(part: Column) -> Column:
            return F.when(F.length(part) > 4 * reach, F.concat(F.left(part, F.lit(2 * reach)), F.right(part, F.lit(2 * reach)))).otherwise(part)

        # part 0, hit 0, part 1, hit 1, ..., part n, ''
        pieces = F.flatten(F.transform(v["parts"], lambda p, i: F.array(ends(p), F.coalesce(F.get(v["hits"], i), F.lit("")))))

        def each(w: Column) -> Column:
            def one(hit: Column, k: Column) -> Column:
                first = F.greatest(F.lit(0), 2 * (k - reach))
                before = F.array_join(F.slice(w, first + 1, 2 * k + 1 - first), "")
                after = F.array_join(F.slice(w, 2 * k + 3, F.lit(2 * reach)), "")
                return F.struct(hit.alias("hit"), F.right(before, F.lit(reach)).alias("before"), F.left(after, F.lit(reach)).alias("after"), F.get(w, 2 * k).alias("left"), F.get(w, 2 * k + 2).alias("right"))

            return F.transform(v["hits"], one)

        return let(pieces, each)

    return let(F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), around)


def phones(text: Column) -> Column:
    """Distinct numbers of a text in order, 12 digits with the country code."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PHONE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.concat(F.lit("90"), F.right(F.regexp_replace(p, "[^0-9]", ""), F.lit(10)))))


# fixed values: words that stand beside the number on a sign
SIGN_WORDS = r"\b(?:satilik(?:tir)?|acil|sahibinden|sahibi|tel|telefon|whatsapp|wp|arayin|araniz|for|sale|cep|gsm)\b"


def is_sign(folded: Column, most: int = 40) -> Column:
    """Whether a folded text without its numbers is no more than a sign: few letters and digits beside the usual words."""
    return F.length(F.regexp_replace(F.regexp_replace(folded, SIGN_WORDS, " "), "[^a-z0-9]", "")) <= most


def without_phones(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _PHONE, " ")


def normalize_phone(raw: Column) -> Column:
    """12 digits with the country code, else null."""
    d = F.regexp_replace(raw, "[^0-9]", "")
    return F.when((F.length(d) == 12) & d.startswith("90"), d).when((F.length(d) == 11) & d.startswith("0"), F.concat(F.lit("9"), d)).when((F.length(d) == 10) & d.startswith("5"), F.concat(F.lit("90"), d))


def mask_phones(text: Column) -> Column:
    return F.regexp_replace(text, _ANY_PHONE, "[tel]")


def mask_pii(text: Column) -> Column:
    return F.regexp_replace(mask_phones(text), _MAIL, "[eposta]")


def pasted_link(url: Column) -> Column:
    """Host and path of an address as a user pastes it, punctuation behind it left out; null without a host or a path."""
    bare = F.rtrim(url, F.lit(").,;!?"))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^(www|m|web|mobile)\.", "")
    path = F.rtrim(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    return F.when((host != "") & (path != ""), F.concat(host, path))


def domain_matches(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def canonical_link(url: Column) -> Column:
    """An address without scheme, leading www., m., web. or mobile., query, fragment, and closing slashes."""
    bare = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return F.rtrim(F.regexp_replace(bare, r"^https?://(www\.|m\.|web\.|mobile\.)?", ""), F.lit("/"))


def link_host(url: Column) -> Column:
    """The host of an address in lower case, without leading www., m., web. or mobile."""
    host = F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return F.regexp_replace(F.lower(host), r"^(www|m|web|mobile)\.", "")


def handles(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("@([A-Za-z0-9._-]+)"), 1)


def engine_liters(text: Column) -> Column:
    """First number, cubic centimetres above 100, between 0.5 and 8.5 litres, one decimal."""
    n = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    n = F.when(n >= 100, n / 1000).otherwise(n)
    return F.when(n.between(0.5, 8.5), F.bround(n, 1))


# fixed values: spellings of fuels and gears and what they stand for
FUELS = {"elektrik": "elektrikli", "electric": "elektrikli", "hybrit": "hibrit", "hybrid": "hibrit", "mazot": "dizel"}
GEARS = {"düz": "manuel", "duz": "manuel", "düz vites": "manuel", "duz vites": "manuel", "manual": "manuel",
         "automatic": "otomatik", "atomatik": "otomatik", "otamatık": "otomatik", "otomotik": "otomatik"}


def canon(value: Column, table: dict[str, str]) -> Column:
    """The table's word for a trimmed lower-case value; values that it does not hold stay, in lower case."""
    key = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.get(F.array(F.try_element_at(known, key)), F.lit(0)), key)
