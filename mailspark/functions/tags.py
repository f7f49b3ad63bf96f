"""Rule tags as plain column expressions built from the rule dictionaries."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import once, sorted_set


def _picked(conditions: dict[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in conditions.items()])))


def _contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needles])


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def files_text(files: Column) -> Column:
    """File entries lower-cased, one to a line; no entry and no rule holds a line break."""
    return lowered(F.array_join(files, "\n"))


def sections_text(sections: Column) -> Column:
    """Content lines of all sections, lower-cased, joined by commas; headings are left out."""
    return lowered(F.array_join(F.flatten(F.transform(sections, lambda s: s["lines"])), ","))


def lines_text(lines: Column) -> Column:
    """:func:`sections_text` from the ``body_lines`` that the sections are made of."""
    return lowered(F.array_join(F.transform(F.filter(lines, lambda x: x["heading"].isNull()), lambda x: x["line"]), ","))


def word_tags(low: Column, rules: dict[str, list[str]] = P.WORD_TAGS) -> Column:
    """Sorted tags whose words occur as whole words in lower-cased text.

    The text is cut into words once, of which the rules look at the known ones; only a phrase
    needs a pattern, and only in text that has its second word.
    """

    def phrase(tag: str) -> Column:
        if tag not in P.PHRASE_TAGS:
            return F.lit(False)
        word, pattern = P.PHRASE_TAGS[tag]
        return F.contains(low, F.lit(word)) & low.rlike(f"(?<!{P.WORD_CHAR}){pattern}(?!{P.WORD_CHAR})")

    known = sorted({w for words in rules.values() for w in words})
    return once(
        F.array_intersect(F.split(low, P.NOT_WORD + "+"), F.lit(known)),
        lambda found: _picked({t: F.arrays_overlap(found, F.lit(w)) | phrase(t) for t, w in rules.items()}),
    )


def file_tags(low: Column, rules: dict[str, list[str]] = P.FILE_TAGS) -> Column:
    """Sorted tags by substring of :func:`files_text`, in generated code."""
    return _picked({tag: _contains_any(low, needles) for tag, needles in rules.items()})


def tags_of_text(text: Column) -> Column:
    return once(lowered(text), word_tags)


def tags_of_files(files: Column) -> Column:
    return once(files_text(files), file_tags)


def tags_of_sections(sections: Column) -> Column:
    return once(sections_text(sections), word_tags)


def substring_tags(low: Column) -> Column:
    none = F.array().cast("array<string>")
    picked = [
        F.when(_contains_any(low, needles), F.array(*[F.lit(t) for t in tags])).otherwise(none)
        for needles, tags in P.SUBSTRING_TAGS
    ]
    return sorted_set(F.concat(*picked))


def tags_by_substring(title: Column) -> Column:
    """The second title rule set: substrings, some rules giving two tags."""
    return once(lowered(title), substring_tags)


def combined_tags(*tag_columns: Column) -> Column:
    return F.array_sort(reduce(F.array_union, tag_columns))
