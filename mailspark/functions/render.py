"""Pieces of a rendered mail and of a prompt."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

def section_line(section: Column) -> Column:
    """``heading: line | line``; a section without a heading is its lines alone."""
    lines = F.array_join(section["lines"], " | ")
    return F.when(section["heading"].isNull(), lines).otherwise(
        F.concat(section["heading"], F.lit(": "), lines)
    )


def commit_short(sha: Column) -> Column:
    return F.left(sha, F.lit(7))


def prompt_opening(mode: Column, key: Column) -> Column:
    """What stands before the context in a prompt: role line, task line with the key, blank line."""
    out = None
    for name, form in P.PROMPTS.items():
        text = F.replace(F.lit(form.removesuffix("{context}")), F.lit("{key}"), F.coalesce(key, F.lit("")))
        out = F.when(mode == name, text) if out is None else out.when(mode == name, text)
    return out
