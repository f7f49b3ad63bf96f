"""Columns taken from the mail body. Everything stays inside the row: no shuffle."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import extract_all, none_if_empty, once, rstrip, sorted_set, strip, to_bigints


def commits(body: Column) -> Column:
    """Line-start SHAs as ``array<struct<sha, short, message>>``; no message gives NULL."""
    return none_if_empty(
        # The body is searched once; a match is then taken apart.
        F.transform(
            extract_all(body, P.COMMIT_LINE, 0),
            lambda x: F.struct(
                F.regexp_extract(x, P.COMMIT_LINE, 1).alias("sha"),
                F.left(F.regexp_extract(x, P.COMMIT_LINE, 1), F.lit(7)).alias("short"),
                F.nullif(strip(F.regexp_extract(x, P.COMMIT_LINE, 2)), F.lit("")).alias("message"),
            ),
        )
    )


def file_paths(body: Column) -> Column:
    """Whole paths of name-status lines, in order, repeats included."""
    return none_if_empty(extract_all(body, P.FILE_LINE))


def file_components(paths: Column) -> Column:
    """Distinct path components of :func:`file_paths`."""
    return none_if_empty(sorted_set(F.flatten(F.transform(paths, lambda p: F.split(p, "/")))))


def linked_prs(body: Column) -> Column:
    return none_if_empty(to_bigints(F.when(F.contains(body, F.lit("://")), extract_all(body, P.BODY_PR_LINK))))


def linked_tickets(body: Column) -> Column:
    return none_if_empty(extract_all(body, "(?=[A-Z])" + P.BODY_TICKET))


def code_blocks(body: Column) -> Column:
    return none_if_empty(F.transform(F.when(F.contains(body, F.lit("```")), extract_all(body, P.CODE_FENCE)), strip))


def list_items(body: Column) -> Column:
    """Bullet and numbered lines, whole."""
    return none_if_empty(F.transform(extract_all(body, P.LIST_LINE, 0), strip))


def list_markers(body: Column) -> Column:
    """Only the bullet or number of each list line."""
    return none_if_empty(extract_all(body, P.LIST_LINE, 1))


def heading_of(line: Column) -> Column:
    """Heading text of one line, NULL for a content line."""
    is_hash = F.startswith(line, F.lit("#")) & line.rlike(P.HASH_HEADING)
    return F.when(is_hash, strip(F.regexp_extract(line, P.HASH_HEADING, 1))).when(
        line.rlike(P.PLAIN_HEADING), strip(F.regexp_extract(line, P.PLAIN_HEADING, 1))
    )


def body_lines(body: Column) -> Column:
    """Right-trimmed, non-blank lines with their heading text if they are headings."""
    # Splitting at one plain character is several times faster than splitting by a pattern.
    other = reduce(or_, [F.contains(body, F.lit(c)) for c in P.OTHER_BREAKS])
    raw_lines = F.when(other, F.split(body, P.LINE_BREAK)).otherwise(F.split(body, "\n"))
    lines = F.filter(F.transform(raw_lines, rstrip), lambda x: x != "")
    # A right-trimmed plain heading is one of the names, or ends its remark.
    may_be_heading = lambda x: F.startswith(x, F.lit("#")) | F.endswith(x, F.lit(")")) | (F.octet_length(x) <= P.LONGEST_PLAIN)
    return F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(may_be_heading(x), heading_of(x)).alias("heading")))


def sections_of_lines(lines: Column) -> Column:
    """Sections of a ``body_lines`` column; pass a stored column so that it is computed once.

    A section runs from one heading to the next, so it is a slice between neighbouring heading
    positions: linear in the number of lines, unlike a fold that grows an array.
    """
    heads = F.filter(
        F.transform(lines, lambda x, i: F.when(x["heading"].isNotNull(), i + 1)),
        lambda i: i.isNotNull(),
    )
    sections = once(
        heads,
        lambda h: F.zip_with(
            F.concat(F.array(F.lit(0)), h),
            F.concat(h, F.array(F.size(lines) + 1)),
            lambda s, e: F.struct(
                F.when(s > 0, F.get(lines, s - 1)["heading"]).alias("heading"),
                F.transform(F.slice(lines, s + 1, e - s - 1), lambda x: x["line"]).alias("lines"),
            ),
        ),
    )
    return none_if_empty(
        F.filter(sections, lambda x: x["heading"].isNotNull() | (F.size(x["lines"]) > 0))
    )


def heading_rest(lines: Column) -> Column:
    """What plain headings of a ``body_lines`` column leave out of their lines; with it, the sections have all words of the body."""
    plain = F.filter(lines, lambda x: x["heading"].isNotNull() & ~F.startswith(x["line"], F.lit("#")))
    return F.array_join(F.transform(plain, lambda x: F.substr(x["line"], F.length(x["heading"]) + 1)), "\n")


def is_sonar(item: Column) -> Column:
    """Whether a list item mentions sonar: the merge can leave such items of later mails out."""
    return F.contains(F.lower(item), F.lit("sonar"))
