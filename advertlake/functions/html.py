"""Pages of HTML as columns: visible lines, elements by class, embedded data. A page is cut into tags and texts by one pattern, and the depth of each tag is a
running sum, so an element ends where the depth falls below its own; no tree is built and no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.functions.numbers import let, running_sum

_REST = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
_TAG = f"<[A-Za-z/!?]{_REST}"
_HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|svg)\b[^>]*>.*?</\1\s*>"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});"
# fixed values: tags without content, tags whose end may be left out, names of entities
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
OPEN_ENDED = ["p", "li", "td", "th", "tr", "dt", "dd", "option", "thead", "tbody"]
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "pound": "£", "euro": "€", "copy": "©", "middot": "·", "bull": "•", "laquo": "«", "raquo": "»", "deg": "°", "times": "×", "ndash": "–", "mdash": "—", "hellip": "…"}


def unescaped(text: Column) -> Column:
    """Entities by number, and the common ones by name, as their characters; others stay."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def char(hit: Column) -> Column:
        code = F.coalesce(F.regexp_extract(hit, "^&#([0-9]+);$", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(hit, "^&#[xX]([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10).try_cast("int"))
        by_number = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(by_number, F.try_element_at(named, F.regexp_extract(hit, "^&([a-zA-Z]+);$", 1)), hit)

    def joined(v: Column) -> Column:
        return F.array_join(F.transform(v["parts"], lambda p, i: F.concat(p, F.coalesce(char(F.get(v["hits"], i)), F.lit("")))), "")

    cut = F.struct(F.split(text, _ENTITY, -1).alias("parts"), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)).alias("hits"))
    return F.when(text.contains("&"), let(cut, joined)).otherwise(text)


def _body(html: Column) -> Column:
    shown = F.regexp_replace(html, _HIDDEN, "<!>")  # it still parts the texts around it
    start = rf"(?is)^.*?<body\b{_REST}"
    return F.regexp_replace(F.regexp_replace(shown, start, ""), r"(?is)<head\b.*?</head\s*>", "")


def _as_lines(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda line: line != "")


def lines(html: Column) -> Column:
    """The visible texts of the body, one line for each text between tags, without empty ones."""
    return _as_lines(unescaped(F.regexp_replace(_body(html), f"(?s){_TAG}", "\n")))


def title(html: Column) -> Column:
    return F.trim(unescaped(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title", 1)))


def embedded(html: Column) -> Column:
    """Array of variants: the nodes of the page's linked data (objects, entries of lists and of @graph); scripts that are no JSON are left out."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script"""), F.lit(1))

    def nodes(script: Column) -> Column:
        v = F.try_parse_json(script)
        return let(v, lambda x: F.coalesce(F.try_variant_get(x, "$['@graph']", "array<variant>"), F.try_variant_get(x, "$", "array<variant>"), F.array(x)))

    return F.filter(F.flatten(F.transform(scripts, nodes)), lambda n: n.isNotNull())


def field(node: Column, path: str, kind: str = "string") -> Column:
    """A value of embedded data, null where it is missing or of another kind. Path: names joined by points."""
    return F.try_variant_get(node, "$" + "".join(f"['{p}']" for p in path.split(".")), kind)


def of_type(node: Column, name: str) -> Column:
    """The node's @type is the name, or a list with it."""
    return F.coalesce(F.array_contains(field(node, "@type", "array<string>"), name), field(node, "@type") == name, F.lit(False))


def first_of_type(html: Column, name: str) -> Column:
    return F.get(F.filter(embedded(html), lambda n: of_type(n, name)), F.lit(0))


def tokens(html: Column) -> Column:
    """Array of (tag, step, names, text, closes, raw, depth): the body's tags and texts in order. step: 1 opens, -1 closes, 0 for texts and for tags without an end;
    names: the classes with a space on either side; depth: how many elements are open behind the token."""
    parts = F.regexp_extract_all(_body(html), F.lit(f"(?s){_TAG}|[^<]+|<"), F.lit(0))

    def one(part: Column) -> Column:
        tag = F.lower(F.nullif(F.regexp_extract(part, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1), F.lit("")))
        flat = tag.isNull() | tag.isin(VOID) | tag.isin(OPEN_ENDED) | part.rlike(r"/\s*>$")
        names = F.regexp_extract(part, r"""(?is)\bclass\s*=\s*["']([^"']*)""", 1)
        return F.struct(
            tag.alias("tag"), F.when(flat, 0).when(part.startswith("</"), -1).otherwise(1).alias("step"),
            F.when(tag.isNotNull(), F.concat(F.lit(" "), F.regexp_replace(names, r"\s+", " "), F.lit(" "))).alias("names"), F.when(~part.rlike("(?s)^<."), part).alias("text"), part.startswith("</").alias("closes"), F.when(tag.isNotNull(), part).alias("raw"),
        )

    def with_depth(ts: Column) -> Column:
        return F.zip_with(ts, running_sum(F.transform(ts, lambda t: t["step"])), lambda t, d: t.withField("depth", d))

    return let(F.transform(parts, one), with_depth)


def element(ts: Column, i: Column) -> Column:
    """(start, end, text, flat) of the element that token i opens: its texts as lines, and joined on one line, up to the first token whose depth is below its
    own; one whose end may be left out ends at the next tag of its kind."""

    def cut(v: Column) -> Column:
        head, rest = v["head"], v["rest"]
        ends = F.transform(rest, lambda t: F.when(head["step"] == 1, t["depth"] < head["depth"]).otherwise(F.coalesce((t["tag"] == head["tag"]) | (t["depth"] < head["depth"]), F.lit(False))))

        def text(n: Column) -> Column:
            inner = F.filter(F.transform(F.slice(rest, 1, n), lambda t: t["text"]), lambda t: t.isNotNull())
            flat = F.trim(F.regexp_replace(unescaped(F.array_join(inner, "")), r"(?U)\s+", " "))
            return F.struct(i.alias("start"), (i + 1 + n).alias("end"), F.array_join(_as_lines(unescaped(F.array_join(inner, "\n"))), "\n").alias("text"), flat.alias("flat"))

        at = F.array_position(ends, True)
        return let(F.when(at > 0, at - 1).otherwise(F.size(rest)).cast("int"), text)

    return let(F.struct(F.get(ts, i).alias("head"), F.slice(ts, i + 2, F.greatest(F.size(ts), F.lit(0))).alias("rest")), cut)


def places(ts: Column, name: str, after: Column | int = -1) -> Column:
    """The tokens behind `after` that open an element of a class."""
    after = after if isinstance(after, Column) else F.lit(after)
    every = F.sequence(F.lit(0), F.greatest(F.size(ts) - 1, F.lit(0)))
    return F.filter(every, lambda i: F.coalesce((i > after) & ~F.get(ts, i)["closes"] & F.get(ts, i)["names"].contains(f" {name} "), F.lit(False)))


def elements(ts: Column, name: str) -> Column:
    return F.transform(places(ts, name), lambda i: element(ts, i))


def first_text(ts: Column, name: str) -> Column:
    """The text of the first element of a class; null without one."""
    return first_element(ts, name)["text"]


def first_element(ts: Column, name: str) -> Column:
    at = F.get(places(ts, name), F.lit(0))
    return F.when(at.isNotNull(), element(ts, at))


def first_tag(ts: Column, tag: str) -> Column:
    """The text of the first element of a tag, on one line."""
    every = F.sequence(F.lit(0), F.greatest(F.size(ts) - 1, F.lit(0)))
    at = F.get(F.filter(every, lambda i: F.coalesce((F.get(ts, i)["tag"] == tag) & ~F.get(ts, i)["closes"], F.lit(False))), F.lit(0))
    return F.when(at.isNotNull(), element(ts, at)["flat"])
