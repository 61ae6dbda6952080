"""Keys of brands, models and body types as columns. Only the folding of accents is a Python helper over Arrow batches: Spark has no function for
Unicode decomposition; every rule above it is built-in functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from advertlake.functions.numbers import let

# fixed values: spellings of brands and what they stand for
BRANDS = {
    "bmw": "BMW", "mercedes": "Mercedes-Benz", "mercedes-benz": "Mercedes-Benz", "mercedes benz": "Mercedes-Benz", "vw": "Volkswagen",
    "volkswagen": "Volkswagen", "vauxhall": "Opel", "opel": "Opel", "mg": "MG", "mersedez": "Mercedes-Benz", "mersedes": "Mercedes-Benz",
    "mercedez": "Mercedes-Benz", "merc": "Mercedes-Benz", "land": "Land Rover", "land rover": "Land Rover", "range": "Land Rover", "seat": "Seat",
}
# fixed values: model families of two words
TWO_WORDS = ["transit connect", "civic type", "land cruiser", "model 3", "model y", "model s", "model x", "range rover", "golf plus", "grand vitara", "grand cherokee", "city crossover"]
# fixed values: brand, pattern at the start of the prepared model, key (None: the first two words)
MODEL_RULES = [
    ("Toyota", r"^yaris cross", "yaris cross"), ("Toyota", r"^corolla cross", "corolla cross"), ("Toyota", r"^(?:corolla )?axio", "axio"),
    ("Toyota", r"^c ?hr\b", "c-hr"), ("Toyota", r"^rav(?: ?4)?\b", "rav4"), ("Mazda", r"^cx ?(\d{1,2})\b", "cx-$1"), ("Mazda", r"^rx ?(\d)\b", "rx-$1"),
    ("Honda", r"^fit aria", "fit aria"), ("Honda", r"^cr ?v\b", "cr-v"), ("Honda", r"^cr ?z\b", "cr-z"), ("Honda", r"^zr ?v\b", "zr-v"), ("Honda", r"^hr ?v\b", "hr-v"),
    ("Volkswagen", r"^t ?roc\b", "t-roc"), ("Volkswagen", r"^t ?cross\b", "t-cross"), ("Nissan", r"^x ?trail\b", "x-trail"), ("Nissan", r"^tida\b", "tiida"),
    ("Hyundai", r"^elentra\b", "elantra"), ("Hyundai", r"^santafe\b", "santa"), ("Renault", r"^megan\b", "megane"), ("Suzuki", r"^(?:swfit|siwft)\b", "swift"),
    ("Mitsubishi", r"^lancer (?:evo|evolution|\d\.\d evolution)", "lancer evo"), ("Mitsubishi", r"^l ?200\b", "l200"), ("Mercedes-Benz", r"^(gle|glc) coupe\b", "$1 coupe"),
    ("BMW", r"^m serisi (m\d)\b", "$1"), ("BMW", r"^z serisi (z\d)\b", "$1"), ("BMW", r"^(?:f10|f11|e60|e61)\b(?! m\d)", "5"),
    ("BMW", r"^(?:f30|f31|e46|e90|e91|g20)\b(?! m\d)", "3"), ("BMW", r"^(?:f20|f21|e87)\b(?! m\d)", "1"), ("Ford", r"^transit custom", "transit custom"),
    ("Ford", r"^transit courier", "transit courier"), ("Ford", r"^fokus\b", "focus"), ("Peugeot", r"^(20[678]|30[78]) (?:cc|cabrio)\b", "$1 cc"),
    ("Peugeot", r"^307 sw\b", "307 sw"), ("Mini", r"^cooper (?:cabrio|clubman|countryman)\b", None),
]
# fixed values: brands that are no cars
NON_CAR_BRANDS = [
    "Yamaha", "Kamyon & Kamyonet", "Ticari Araclar", "Minibus & Midibus", "Cfmoto", "Harley Davidson", "Can-Am", "Cekme Karavan", "ATV", "Yuki", "KTM",
    "Alice", "Balikci Teknesi", "Kawasaki", "Moto Karavan", "Scooter", "SYM", "Vespa", "Volta", "Karavan", "Jet Ski", "Jawa", "Iveco", "Hino",
    "Abbey Karavan", "Surat Teknesi", "DAF", "Triumph", "TVS", "Vento", "MAN", "Lobster", "Bisiklet", "Motolux", "Motoryat", "Tesla Marin", "Ducati",
    "Sanya", "Access", "Test", "Motosiklet", "Piaggio", "Aprilia", "Kymco", "Benelli", "Husqvarna", "Royal Enfield", "Mv Agusta",
]
_DIGITS = r"(?:\d+[a-z]*)?$"
# fixed values: brand of cars, pattern of the model key (or of the folded model, where raw), and the category it really is
NON_CAR_MODELS = [
    ("Honda", r"^(?:cb|cbr|cbf|cbx|crf|crm|nc|nx|nt|xl|xr|xre|x|pcx|sh|forza|nss|vfr|vtx|cmx|gl|transalp|africa|rebel|grom|monkey|dax|cub|supercub|vision|lead|dio|activa|today|joker|spacy|pantheon|goldwing|gold|shadow|hornet|varadero|deauville|silverwing|swing|msx|ctx|ct)" + _DIGITS, "Motosiklet", False),
    ("Honda", r"^400x$", "Motosiklet", False), ("Honda", r"^tekne$", "Balikci Teknesi", False),
    ("BMW", r"^(?:f|g|r|c|k|s|ce)$|^(?:f|g|r|c|k|s)\d{3,4}[a-z]*$|^ce\d+$|^r18$", "Motosiklet", False),
    ("Suzuki", r"^(?:gsx|gsr|gs|sv|dr|drz|rm|rmz|v|vstrom|burgman|an|adress|address|intruder|hayabusa|bandit|boulevard|gn|gz|lt|ltz|df|skywave|katana|vl|vz)" + _DIGITS, "Motosiklet", False),
    ("Peugeot", r"^(?:speedfight|django|kisbee|tweet|vivacity|ludix|jetforce|trekker|elystar|citystar)" + _DIGITS, "Motosiklet", False),
    ("Mercedes-Benz", r"^(?:actros|atego|axor|unimog|zetros)" + _DIGITS, "Kamyon & Kamyonet", False), ("Mitsubishi", r"^(?:canter|fuso)" + _DIGITS, "Kamyon & Kamyonet", False),
    ("Isuzu", r"^(?:elf|nqr|npr|nkr)" + _DIGITS + r"|^n\d{2}[\d.]*$", "Kamyon & Kamyonet", False), ("BMW", r"^m ?1000", "Motosiklet", True),
]
# fixed values: words of districts
DISTRICTS = {"lefkosa": "lefkosa", "girne": "girne", "lapta": "girne", "alsancak": "girne", "gazimagusa": "magusa", "magusa": "magusa", "iskele": "iskele", "guzelyurt": "guzelyurt", "lefke": "lefke"}


@F.arrow_udf(StringType())
def _ascii(texts: pa.Array) -> pa.Array:
    """Few texts at a time are Python strings, whatever the size of a batch."""
    def one(t: str | None) -> str | None:
        return t if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()

    return pa.concat_arrays([pa.array([one(t.as_py()) for t in texts.slice(i, 256)], pa.string()) for i in range(0, len(texts), 256)] or [pa.array([], pa.string())])


def fold(text: Column) -> Column:
    """Lower case without accents and other letters than ASCII's, white space as single spaces. Only texts with other letters go to Python."""
    t = F.translate(text, "ıİ", "ii")
    other = F.octet_length(t) != F.char_length(t)
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_ascii(F.when(other, t)), t)), r"\s+", " "))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _brand_of(folded: Column) -> Column:
    def named(key: Column) -> Column:
        runs = F.regexp_extract_all(key, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
        title = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
        return F.coalesce(_looked_up(BRANDS, key), F.when(F.length(key) <= 3, F.upper(key)).otherwise(title))

    return let(F.regexp_replace(folded, r"\s*-\s*", "-"), named)


def _prepared(brand_norm: Column, folded: Column) -> Column:
    m = F.trim(F.regexp_replace(F.regexp_replace(F.replace(folded, F.lit("-"), F.lit(" ")), "[^a-z0-9. ]", ""), r"\s+", " "))
    head = F.when(brand_norm == "Land Rover", r"^rover\s+(?=\S)").when(brand_norm == "Mercedes-Benz", r"^(mercedes\s+)?(benz\s+)?(?=\S)").otherwise("^$")
    return F.regexp_replace(m, head, F.lit(""))


def _family(brand: Column, m: Column) -> Column:
    out = None
    for name, pattern, key in MODEL_RULES:
        hit = (brand == name) & m.rlike(pattern)
        if key is None:
            got = F.array_join(F.slice(F.split(m, " "), 1, 2), " ")
        elif "$" in key:
            got = F.regexp_replace(F.regexp_extract(m, pattern, 0), pattern, key)
        else:
            got = F.lit(key)
        out = F.when(hit, got) if out is None else out.when(hit, got)
    return out


def _model_of(brand_norm: Column, m: Column) -> Column:
    words = F.split(m, " ")
    first, two = F.get(words, F.lit(0)), F.array_join(F.slice(words, 1, 2), " ")

    def group(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(m, pattern, 1), F.lit(""))

    def has(word: str) -> Column:
        return F.array_contains(words, word)

    merc = group(r"^(gla|glb|glc|gle|gls|cla|cls|clk|slk|sl|eqa|eqb|eqc|a|b|c|e|s|g|v|x)(?=\d|\s|$)")
    series = F.coalesce(group(r"^([1-8])\d{2}[a-z]{0,2}\b"), group(r"^([1-8])\.\d{2}[a-z]?\b"), group(r"^([1-8])\s*serisi"))
    rover = F.when(has("evoque"), "evoque").when(has("velar"), "velar").when(has("defender"), "defender").when(has("freelander"), "freelander")
    rover = rover.when(has("discovery"), F.when(has("sport"), "discovery sport").otherwise("discovery")).when(has("sport"), "range rover sport")
    rover = rover.when(m.startswith("range"), "range rover").otherwise(first)
    own = F.when(brand_norm == "Mercedes-Benz", merc).when(brand_norm == "BMW", series)
    plain = F.when(two.isin(TWO_WORDS), two).otherwise(first)
    return F.when(m == "", None).when(brand_norm == "Land Rover", rover).otherwise(F.coalesce(_family(brand_norm, m), own, plain))


def _category_of(brand_norm: Column, model_norm: Column, raw: Column) -> Column:
    out = None
    for brand, pattern, target, of_raw in NON_CAR_MODELS:
        hit = (brand_norm == brand) & F.coalesce((raw if of_raw else model_norm).rlike(pattern), F.lit(False))
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out.otherwise(brand_norm)


def brand_key(brand: Column) -> Column:
    """The brand's name; unknown ones of up to three letters in capitals, longer ones with a capital at the start of each run of letters."""
    return F.when(F.length(brand) > 0, _brand_of(fold(brand)))


def model_key(brand_norm: Column, model: Column) -> Column:
    """The key that comparables share: family rules first, then the brand's own numbering, families of two words, and the first word."""
    both = F.struct(brand_norm.alias("b"), fold(model).alias("m"))
    return let(both, lambda v: let(_prepared(v["b"], v["m"]), lambda m: _model_of(v["b"], m)))


def category(brand_norm: Column, model_norm: Column, model: Column) -> Column:
    """The brand, or what a model of it really is: motorcycles, lorries and boats of brands of cars."""
    raw = F.replace(fold(F.coalesce(model, F.lit(""))), F.lit("-"), F.lit(" "))
    return let(F.struct(brand_norm.alias("b"), model_norm.alias("m"), raw.alias("r")), lambda v: _category_of(v["b"], v["m"], v["r"]))


def keys(brand: Column, model: Column) -> Column:
    """Struct (brand_norm, model_norm) of an advert."""

    def found(v: Column) -> Column:
        model_norm = let(_prepared(v["b"], v["m"]), lambda m: _model_of(v["b"], m))
        raw = F.replace(F.coalesce(v["m"], F.lit("")), F.lit("-"), F.lit(" "))
        return let(model_norm, lambda k: F.struct(_category_of(v["b"], k, raw).alias("brand_norm"), k.alias("model_norm")))

    named = F.struct(F.when(F.length(brand) > 0, fold(brand)).alias("b"), fold(model).alias("m"))
    return let(named, lambda f: let(F.struct(_brand_of(f["b"]).alias("b"), f["m"].alias("m")), found))


def is_car(brand_norm: Column) -> Column:
    return F.coalesce((brand_norm != "") & ~brand_norm.isin(NON_CAR_BRANDS), F.lit(False))


def body_type(model: Column, url: Column) -> Column:
    """cabrio or coupe, from the model or a whole word of the address's path; cabrio if both are named; else null."""
    bare = F.split_part(F.split_part(F.trim(F.coalesce(url, F.lit(""))), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    path = fold(F.regexp_replace(bare, r"(?i)^[a-z][a-z0-9+.-]*://[^/]*", ""))

    def found(v: Column) -> Column:
        def any_of(*names: str) -> Column:
            return F.arrays_overlap(v["w"], F.array(*map(F.lit, names)))

        cabrio = v["m"].rlike("cabrio|convertible|kabrio|roadster") | any_of("cabrio", "cabriolet", "convertible", "kabrio", "roadster")
        return F.when(cabrio, "cabrio").when(v["m"].rlike("coupe|kupe") | any_of("coupe", "kupe"), "coupe")

    return let(F.struct(F.coalesce(fold(model), F.lit("")).alias("m"), F.split(path, "[^a-z0-9]+").alias("w")), found)


def district(location: Column) -> Column:
    """The district that the first known word of a location names; unknown words are no district."""
    words = F.split(fold(F.replace(F.coalesce(location, F.lit("")), F.lit(","), F.lit(" "))), " ")
    return F.get(F.array_compact(F.transform(words, lambda w: _looked_up(DISTRICTS, w))), F.lit(0))


# fixed values: letters folded by the fingerprint of posts, and its lengths
POST_FROM, POST_TO = "ÇĞİIÖŞÜÂÎÛçğıöşüâîû", "cgiiosuaiucgiosuaiu"
POST_READ, POST_KEPT, POST_LEAST = 1000, 300, 60


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def post_text(raw: Column) -> Column:
    """The normalised start of a post: compatibility forms, Turkish letters as ASCII, other runs than letters and digits as one space."""
    t = F.lower(F.translate(_compatible(F.substring(F.coalesce(raw, F.lit("")), 1, POST_READ)), POST_FROM, POST_TO))
    return F.substring(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), 1, POST_KEPT)


def post_fingerprint(raw: Column, year: Column, platform: Column) -> Column:
    """md5 of a social post's start if it is long enough and names the year as a word."""
    t = post_text(raw)
    named = F.instr(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), year.cast("string"), F.lit(" "))) > 0
    return F.when(platform.isin("facebook", "instagram") & (F.length(t) >= POST_LEAST) & named, F.md5(t.cast("binary")))
