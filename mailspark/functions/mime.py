"""Headers, parts and body of a raw mail, all inside the row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import REPLACEMENT, html_to_text
from .text import extract_all, once, strip

# Every text that could be declared as a boundary, anywhere in a mail.
ANY_BOUNDARY = r'(?i)boundary\s*=\s*"?([^\s;"]+|(?<=")[^"\n]+)'
BOUNDARY_QUOTED = r'(?i)boundary\s*=\s*"([^"]+)"'
BOUNDARY_BARE = r'(?i)boundary\s*=\s*([^\s;"]+)'
DEFAULT_TYPE = "text/plain"
# Stands for the break of a folded header line, so that no pattern walks line by line.
FOLD = "\0"
# A character that stands for none.
MARK = "\N{ZERO WIDTH NO-BREAK SPACE}"
UUENCODED = ["x-uuencode", "uuencode", "uue", "x-uue"]
# Six bits as a character, in order: of uuencoded text, with the grave accent for zero as well, and of base64.
UU_SIX = "".join(map(chr, range(32, 97)))
BASE64_SIX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/A"


def header(head: Column, name: str) -> Column:
    """First header of that name, any case; folded lines stay folded; '' when missing."""
    unfolded = F.regexp_replace(head, r"\n(?=[ \t])", FOLD)
    return F.replace(F.regexp_extract(unfolded, rf"(?imd)^{name}:[ \t]*(.*)", 1), F.lit(FOLD), F.lit("\n"))


def split_head(block: Column) -> Column:
    """``struct<head, payload>`` of text that starts with a line break."""
    head = F.substring_index(block, "\n\n", 1)
    return F.struct(
        head.alias("head"),
        F.substr(block, F.length(head) + 3).alias("payload"),
    )


def head_of(raw: Column) -> Column:
    return F.substring_index(F.concat(F.lit("\n"), raw), "\n\n", 1)


def _content_type(head: Column) -> Column:
    ctype = F.lower(F.regexp_extract(header(head, "content-type"), r"^\s*([^;\s/]+/[^;\s/]+)(?:[;\s]|$)", 1))
    return F.coalesce(F.nullif(ctype, F.lit("")), F.lit(DEFAULT_TYPE))


def _first_boundary(value: Column) -> Column:
    quoted = F.nullif(F.regexp_extract(value, BOUNDARY_QUOTED, 1), F.lit(""))
    return F.coalesce(quoted, F.nullif(F.regexp_extract(value, BOUNDARY_BARE, 1), F.lit("")))


def _utf8(c: Column) -> Column:
    """UTF-8 text with bad bytes dropped.

    Bad bytes become U+FFFD first. Where the text has that character of its own, it is written as a mark
    and a digit meanwhile, and so is the mark.
    """
    dropped = lambda x: F.replace(F.make_valid_utf8(x), F.lit(REPLACEMENT), F.lit(""))
    guarded = F.replace(F.replace(c, F.lit(MARK), F.lit(MARK + "0")), F.lit(REPLACEMENT), F.lit(MARK + "1"))
    freed = F.replace(F.replace(dropped(guarded), F.lit(MARK + "1"), F.lit(REPLACEMENT)), F.lit(MARK + "0"), F.lit(MARK))
    return F.when(F.contains(c, F.lit(REPLACEMENT)), freed).otherwise(dropped(c))


def _from_base64(payload: Column) -> Column:
    def whole(kept: Column) -> Column:
        return F.left(kept, F.length(kept) - F.when(F.length(kept) % 4 == 1, 1).otherwise(0))

    def padded(text: Column) -> Column:
        return F.concat(text, F.repeat(F.lit("="), (4 - F.length(text) % 4) % 4))

    kept = F.regexp_replace(payload, r"[^A-Za-z0-9+/]", "")
    return F.try_to_binary(once(once(kept, whole), padded), F.lit("base64")).cast("string")


def _from_quoted_printable(payload: Column) -> Column:
    joined = F.regexp_replace(payload, r"=[ \t]*\n", "")
    escaped = F.replace(F.replace(joined, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(F.regexp_replace(escaped, r"=([0-9A-Fa-f]{2})", "%$1"))


def _from_uuencode(payload: Column) -> Column:
    """Bytes from the ``begin`` line to the ``end`` line or the end; NULL without one or where a line is none.

    A line's first character says how many bytes it holds; its other characters are six bits each.
    """

    def line_bytes(line: Column) -> Column:
        n = (F.ascii(line) - 32).bitwiseAND(F.lit(63))
        length = (F.ceil(n / 3) * 4).cast("int")
        six = F.rpad(F.substring(line, F.lit(2), length), length, " ")
        data = F.try_to_binary(F.translate(six, UU_SIX, BASE64_SIX), F.lit("base64"))
        hexed = F.left(F.hex(data), (n * 2).cast("int"))
        return F.when(line.rlike("^[ -`]") & ~six.rlike("[^ -`]"), F.when(n == 0, F.lit("")).otherwise(hexed))

    begin = F.regexp_instr(payload, F.lit(r"(?md)^begin [0-7]+(?: |$)"))
    lines = F.split(F.substr(payload, begin), "\n")

    def decoded(of: Column) -> Column:
        end = F.array_position(F.transform(of, lambda x: F.btrim(x, F.lit(" \t\r\f"))), "end").cast("int")
        # Without an end line the data goes on to the last line break.
        last = F.when(end > 0, end).otherwise(F.size(of) + F.when(F.element_at(of, -1) == "", 0).otherwise(1))
        data = F.transform(F.slice(of, F.lit(2), F.greatest(last - 2, F.lit(0))), line_bytes)
        return F.when(~F.exists(data, lambda x: x.isNull()), F.unhex(F.array_join(data, "")).cast("string"))

    return F.when(begin > 0, once(lines, decoded))


def decode_payload(payload: Column, encoding: Column) -> Column:
    decoded = (
        F.when(encoding == "base64", _from_base64(payload))
        .when(encoding == "quoted-printable", _from_quoted_printable(payload))
        .when(encoding.isin(UUENCODED), _from_uuencode(payload))
        .otherwise(payload)
    )
    return _utf8(F.coalesce(decoded, payload))


def _declared_boundary(block: Column) -> Column:
    """The boundary that a part's own header block declares, or that of the mail it encloses."""

    def of_head(head: Column) -> Column:
        declared = F.startswith(_content_type(head), F.lit("multipart/"))
        return F.when(declared, _first_boundary(header(head, "content-type")))

    return once(split_head(block), lambda s: F.coalesce(
        of_head(s["head"]),
        F.when(_content_type(s["head"]) == "message/rfc822", of_head(head_of(s["payload"]))),
    ))


def _cut_into_parts(pieces: Column, top: Column) -> Column:
    """Parts of a mail from its pieces, each of which but the first begins with a line that looks like
    a delimiter.

    A fold keeps the boundaries that are open, outermost first. A line opens a part only if its
    boundary is open; the boundaries inside that one are then over, and the part may open its own. A
    closing line ends its boundary, and what follows up to the next opening line is no part's. All
    other pieces belong to the part they stand in.
    """
    ended = lambda acc: F.when(acc["part"].isNull(), acc["parts"]).otherwise(F.array_append(acc["parts"], acc["part"]))
    state = lambda opened, parts, part: F.struct(opened.alias("open"), parts.alias("parts"), part.alias("part"))

    def step(acc: Column, piece: Column) -> Column:
        name = F.rtrim(F.substring(F.substring_index(piece, "\n", 1), 3, 1 << 30), F.lit(" \t"))
        at = F.array_position(acc["open"], name)
        closed = F.when(F.endswith(name, F.lit("--")), F.array_position(acc["open"], F.left(name, F.length(name) - 2))).otherwise(F.lit(0))
        rest = F.substr(piece, F.length(F.substring_index(piece, "\n", 1)) + 1)
        inner = F.array_compact(F.array(_declared_boundary(rest)))
        return (
            F.when(at > 0, state(F.concat(F.slice(acc["open"], F.lit(1), at.cast("int")), inner), ended(acc), rest))
            .when(closed > 0, state(F.slice(acc["open"], F.lit(1), F.greatest(closed - 1, F.lit(0)).cast("int")), ended(acc), F.lit(None).cast("string")))
            .otherwise(state(acc["open"], acc["parts"], F.concat(acc["part"], F.lit("\n"), piece)))
        )

    none = F.array().cast("array<string>")
    start = state(F.array(top), none, F.lit(None).cast("string"))
    return F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, ended)


def with_parts(mails: DataFrame) -> DataFrame:
    """Add ``multipart`` and ``parts`` (leaves in order: ctype, encoding, payload) to ``raw`` rows.

    The text is cut at every line that could be a delimiter; which of them are is decided from the
    header blocks of the mail and of its parts alone, so quoted mail source stays text.
    """
    block = F.concat(F.lit("\n"), F.col("raw"))
    any_boundary = F.array_join(
        F.transform(
            F.array_distinct(F.array_append(extract_all(F.col("raw"), ANY_BOUNDARY), F.col("top"))),
            lambda b: F.concat(F.lit(r"\Q"), F.replace(b, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")),
        ),
        "|",
    )
    pieces = F.split(block, F.concat(F.lit(r"\n(?=--(?:"), any_boundary, F.lit(r")(?:--)?[ \t]*(?:\n|\z))")))
    trimmed = _cut_into_parts(pieces, F.col("top"))
    is_rfc822 = lambda s: _content_type(s["head"]) == "message/rfc822"
    opened = F.transform(
        F.transform(F.col("blocks"), split_head),
        lambda s: F.when(
            F.col("multipart") & is_rfc822(s), split_head(F.concat(F.lit("\n"), s["payload"]))
        ).otherwise(s),
    )
    typed = F.transform(
        opened,
        lambda s: F.struct(
            _content_type(s["head"]).alias("ctype"),
            F.lower(strip(header(s["head"], "content-transfer-encoding"))).alias("encoding"),
            s["payload"].alias("payload"),
        ),
    )
    leaves = F.filter(typed, lambda s: ~F.col("multipart") | ~F.startswith(s["ctype"], F.lit("multipart/")))
    decoded = F.transform(
        leaves,
        lambda s: F.struct(
            s["ctype"].alias("ctype"),
            s["encoding"].alias("encoding"),
            decode_payload(s["payload"], s["encoding"]).alias("payload"),
        ),
    )
    return (
        mails.withColumn("head", head_of(F.col("raw")))
        .withColumn("top", _first_boundary(header(F.col("head"), "content-type")))
        .withColumn("multipart", F.startswith(_content_type(F.col("head")), F.lit("multipart/")) & F.col("top").isNotNull())
        .withColumn("blocks", F.when(F.col("multipart"), trimmed).otherwise(F.array(block)))
        .withColumn("parts", decoded)
        .drop("top", "blocks")
    )


def body_of(parts: Column, multipart: Column, clean_single_part: bool = False) -> Column:
    """Plain leaves, else cleaned HTML leaves, else ''; a single-part mail as it is."""

    def leaves(ctype: str, text) -> Column:
        kept = F.filter(parts, lambda s: s["ctype"] == ctype)
        return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda s: text(s["payload"])), "\n"))

    plain = leaves("text/plain", lambda p: p)
    html = leaves("text/html", html_to_text)
    whole = F.get(parts, F.lit(0))["payload"]
    single = F.coalesce(html, whole) if clean_single_part else whole
    return F.coalesce(F.when(multipart, F.coalesce(plain, html)).otherwise(single), F.lit(""))
