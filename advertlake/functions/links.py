"""What a pasted link or a group's texts say about a source, as columns: kind and key of the source, the region, the variant of a car."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.functions.numbers import let

# fixed values: hosts of the two networks, and first parts of paths that are no account or page
_FB_HOSTS = ["facebook.com", "m.facebook.com", "web.facebook.com", "mbasic.facebook.com", "fb.com"]
_IG_HOSTS = ["instagram.com", "m.instagram.com"]
_IG_RESERVED = ["p", "reel", "reels", "explore", "accounts", "stories", "tv", "direct", "about", "developer", "legal", "web", "share"]
_FB_NOT_PAGE = [
    "groups", "share", "profile.php", "permalink.php", "story.php", "watch", "marketplace", "reel", "reels", "events", "pages", "photo", "photo.php", "photos",
    "login", "help", "gaming", "hashtag", "people", "search", "p", "home.php", "friends",
]
_URL = r"(?i)^https?://([^/?#\s]+)([^?#\s]*)(?:[?#]\S*)?$"
_DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}$"


def _taken_apart(text: Column, body) -> Column:
    """body(struct of host and parts of the path, in lower case), null if the text is no single link."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    host = F.regexp_replace(F.rtrim(F.lower(F.regexp_extract(raw, _URL, 1)), F.lit(".")), r"^.*@", "")
    host = F.regexp_replace(F.rtrim(F.regexp_replace(host, ":.*$", ""), F.lit(".")), r"^www\.", "")
    path = F.filter(F.split(F.lower(F.regexp_extract(raw, _URL, 2)), "/"), lambda p: p != "")
    return F.when(raw.rlike(_URL), let(F.struct(host.alias("host"), path.alias("path")), body))


def source_link(text: Column) -> Column:
    """Struct (kind, handle) of a link: instagram, facebook (a group) and web are sources; ig_post, fb_post and fb_share are not. Null for other texts."""

    def found(v: Column) -> Column:
        first, second = F.get(v["path"], F.lit(0)), F.get(v["path"], F.lit(1))
        of = lambda kind, handle="": F.struct(F.lit(kind).alias("kind"), (handle if isinstance(handle, Column) else F.lit(handle)).alias("handle"))
        account = F.coalesce(~first.isin(_IG_RESERVED) & first.rlike(r"^[a-z0-9._]{1,30}$"), F.lit(False))
        group = F.coalesce((first == "groups") & second.rlike(r"^[a-z0-9._-]{1,64}$") & (F.size(v["path"]) == 2), F.lit(False))
        ig = F.when(account, of("instagram", first)).otherwise(of("ig_post"))
        fb = F.when(F.coalesce(first == "share", F.lit(False)), of("fb_share")).when(group, of("facebook", second)).otherwise(of("fb_post"))
        return F.when(~v["host"].rlike(_DOMAIN), None).when(v["host"].isin(_IG_HOSTS), ig).when(v["host"].isin(_FB_HOSTS), fb).otherwise(of("web", v["host"]))

    return _taken_apart(text, found)


def page_key(url: Column) -> Column:
    """fbp:<name> of the address of a page: a single part of a path that is a name."""

    def found(v: Column) -> Column:
        first = F.get(v["path"], F.lit(0))
        page = v["host"].isin(_FB_HOSTS) & (F.size(v["path"]) == 1) & ~first.isin(_FB_NOT_PAGE) & first.rlike(r"^[a-z0-9.]{1,64}$")
        return F.when(page, F.concat(F.lit("fbp:"), first))

    return _taken_apart(url, found)


def source_key(platform: Column, url: Column) -> Column:
    """The key by which a registered source and a link are the same; null where the address does not fit the platform."""

    def found(v: Column) -> Column:
        link = v["link"]
        own = F.when(link["kind"] == "instagram", F.concat(F.lit("ig:"), link["handle"])).when(link["kind"] == "facebook", F.concat(F.lit("fb:"), link["handle"]))
        own = own.when(link["kind"] == "web", F.concat(F.lit("web:"), link["handle"]))
        return F.when((v["platform"] == "facebook") & (link["kind"] == "fb_post"), v["page"]).when(link["kind"] == v["platform"], own)

    return let(F.struct(platform.alias("platform"), source_link(url).alias("link"), page_key(url).alias("page")), found)


# fixed values: words and places that name the region, and prefixes of its numbers
_STRONG = r"kktc|kibris|cyprus|trnc"
_PLACES = (
    r"(?<![a-z0-9])(?:lefkosa|nicosia|girne|kyrenia|gazimagusa|magusa|famagusta|guzelyurt|morphou|iskele|trikomo|lefke|dipkarpaz|karpaz|degirmenlik|alsancak|lapta|catalkoy)"
)
_ABROAD = r"(?<![a-z0-9])(?:turkiye|turkey)"
_LOCAL_PHONE = r"(?<!\d)(?:(?:\+|00)?\s*90[\s.\-]*)?\(?0?(?:533|542|548|392)\)?[\s.\-]*\d{3}[\s.\-]*\d{2}[\s.\-]*\d{2}(?!\d)"


def names_region(folded: Column) -> Column:
    """Whether a group's folded name is of the region: a strong word, or a place where it does not say that it is abroad."""
    f = F.coalesce(folded, F.lit(""))
    return f.rlike(_STRONG) | (f.rlike(_PLACES) & ~f.rlike(_ABROAD))


def text_of_region(folded: Column, text: Column, phone: Column) -> Column:
    """Whether an advert is of the region: a word or place in its folded text and location, or a number of the region."""
    f = F.coalesce(folded, F.lit(""))
    number = F.coalesce(text, F.lit("")).rlike(_LOCAL_PHONE) | F.coalesce(phone, F.lit("")).rlike("^(90533|90542|90548|90392)")
    return f.rlike(_STRONG) | f.rlike(_PLACES) | number


def region_share(hits: Column, n: Column, least: int = 3) -> Column:
    """Whether enough of a group's adverts are of the region: two thirds of at least three."""
    return (n >= least) & (hits * 3 >= n * 2)


def variant(brand_norm: Column, model: Column, engine_l: Column) -> Column:
    """The variant of a car: the three digits of a model of two brands, else the engine in steps of 0.2 litres; empty if unknown."""
    digits = F.regexp_extract(F.coalesce(model, F.lit("")), r"(?<!\d)(\d{3})(?!\d)", 1)
    engine = F.format_number(F.floor(engine_l / 0.2 + 0.5 + 1e-9) * 0.2, 1)
    return F.when(brand_norm.isin("Mercedes-Benz", "BMW"), digits).otherwise(F.coalesce(F.when(engine_l.between(0.5, 8.0), engine), F.lit("")))
