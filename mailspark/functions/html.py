"""HTML to text as a column expression."""

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, strip

# Everything between two text nodes: comments, script/style/template with content, tags.
NODE_GAP = (
    r"(?s)<!--.*?(?:-->|\z)"
    r"|<(?i:script)\b.*?(?:</(?i:script)[^>]*>|\z)"
    r"|<(?i:style)\b.*?(?:</(?i:style)[^>]*>|\z)"
    r"|<(?i:template)\b.*?(?:</(?i:template)[^>]*>|\z)"
    # A quoted attribute may hold ">". Nothing is given back, so any number of them needs no stack.
    r"|<[!/?a-zA-Z][^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+>"
    r"|<[!/?a-zA-Z][^>]*>"
)
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?"
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"

# All names that HTML knows, most with their ";". The older ones also count without it, and at the start
# of a longer name; the longest is tried first.
NAMED_ENTITIES = dict(html5)
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Numeric references 128-159 mean the Windows-1252 characters.
_C1 = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
C1_FROM = "".join(map(chr, _C1))
C1_TO = bytes(_C1).decode("cp1252")


def code_point(n: Column) -> Column:
    """Character of a code point; NULL-safe, U+FFFD for what is no character."""
    valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(valid, F.translate(char, C1_FROM, C1_TO)).otherwise(F.lit(REPLACEMENT))


def _entity_text(e: Column, named: Column) -> Column:
    name = F.substr(e, F.lit(2))
    opening = F.get(F.filter(F.lit(OPEN_NAMES), lambda n: F.startswith(name, n)), F.lit(0))
    digits = F.rtrim(F.substring(e, 3, 40), F.lit(";"))
    hexdigits = F.rtrim(F.substring(e, 4, 40), F.lit(";"))
    hex_value = F.when(F.length(hexdigits) <= 8, F.conv(hexdigits, 16, 10).try_cast("bigint"))
    return (
        F.when(F.lower(F.left(e, F.lit(3))) == "&#x", code_point(hex_value))
        .when(F.left(e, F.lit(2)) == "&#", code_point(digits.try_cast("bigint")))
        .otherwise(F.coalesce(
            F.try_element_at(named, name),
            once(opening, lambda n: F.concat(F.try_element_at(named, n), F.substr(name, F.length(n) + 1))),
            e,
        ))
    )


def decode_entities(text: Column) -> Column:
    """Replace each character reference once; what a reference yields is not read again."""
    named = F.map_from_arrays(F.lit(list(NAMED_ENTITIES)), F.lit(list(NAMED_ENTITIES.values())))
    around = F.split(text, ENTITY)
    refs = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    zipped = F.zip_with(
        around, refs, lambda p, e: F.concat(p, F.when(e.isNull(), F.lit("")).otherwise(_entity_text(e, named)))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(zipped, "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text nodes, each stripped, empty ones dropped, joined by line breaks."""
    nodes = F.transform(F.split(html, NODE_GAP), lambda t: strip(decode_entities(t)))
    return F.array_join(F.filter(nodes, lambda t: t != ""), "\n")
