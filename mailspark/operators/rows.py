"""Rendered mails as rows, and rows as text.

A rendered mail is a sequence of rows ``section, label, rank, item, text`` in that order; a merged mail
of any size is so rendered by many tasks. ``as_text`` puts rows of one group together where the whole
fits one value.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import commit_short
from .merge import MARKDOWN_KEYS, Merged

MAIL = ["mbox", "seq"]
BODY = "Email Body:"
ROW = ["section", "label", "rank", "item", "text"]


def _from_heads(label: str, text: Column):
    return lambda m, n: m.heads.select(
        *MAIL, F.lit(n).alias("section"), F.lit(label).alias("label"), F.lit(0).cast("bigint").alias("rank"),
        F.lit(0).alias("item"), text.alias("text"),
    ).where("text <> ''")


def _from_values(label: str, field: str, text: Column | None = None):
    """One row per value, in the order of their text."""
    return lambda m, n: m.values.where(F.col("field") == field).select(
        *MAIL, F.lit(n).alias("section"), F.lit(label).alias("label"), F.lit(0).cast("bigint").alias("rank"),
        F.lit(0).alias("item"), (F.col("value") if text is None else text).alias("text"),
    )


def _from_markdown(key: str):
    return lambda m, n: m.markdown.where(F.col("key") == key).select(
        *MAIL, F.lit(n).alias("section"), F.lit(f"## {key}").alias("label"), "rank", "item", F.concat(F.lit("- "), "text").alias("text")
    )


def _from_texts(label: str):
    return lambda m, n: m.texts.select(
        *MAIL, F.lit(n).alias("section"), F.lit(label).alias("label"), "rank", F.lit(0).alias("item"), F.col("body").alias("text")
    )


def _listed(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ", ")


# Sections that hold a member's whole texts.
BULK = (*[lambda k=k: _from_markdown(k) for k in MARKDOWN_KEYS], lambda: _from_texts(""))
# Sections of the text for the encoder and of a question's context, in order.
FULL_TEXT = (
    lambda: _from_heads("Tags: ", _listed("tags")), lambda: _from_heads("Title: ", F.col("pr_title")),
    lambda: _from_heads("PR Numbers: ", _listed("pr_numbers")), lambda: _from_values("Repos: ", "repos"),
    lambda: _from_values("Tickets: ", "tickets"), *BULK[:-1],
    lambda: _from_values("", "commits", F.concat(commit_short(F.col("value")), F.lit(","), F.coalesce("detail", F.lit("")))),
    lambda: _from_values("", "files_modified"), lambda: _from_values("Linked PRs: ", "linked_prs"),
    lambda: _from_values("Linked Tickets: ", "linked_tickets"), lambda: _from_values("Contributors: ", "contributors"),
    BULK[-1],
)
CONTEXT = (
    lambda: _from_heads("Tags: ", _listed("tags")), lambda: _from_heads("PR Numbers: ", _listed("pr_numbers")),
    lambda: _from_values("Repos: ", "repos"), lambda: _from_values("Tickets: ", "tickets"),
    lambda: _from_heads("Title: ", F.col("pr_title")),
    lambda: _from_values("Commits:", "commits", F.concat(F.lit("- "), F.concat_ws(" ", commit_short(F.col("value")), "detail"))),
    lambda: _from_values("Files Changed:", "files_modified", F.concat(F.lit("- "), "value")),
    *[lambda k=k: _from_markdown(k) for k in MARKDOWN_KEYS], lambda: _from_values("Contributors: ", "contributors"),
    lambda: _from_texts(BODY),
)


def _rows(merged: Merged, sections) -> DataFrame:
    out = None
    for n, section in enumerate(sections, 1):
        part = section()(merged, n)
        out = part if out is None else out.unionByName(part)
    return out


def full_text_rows(merged: Merged) -> DataFrame:
    """(mbox, seq, section, label, rank, item, text): the text for the encoder."""
    return _rows(merged, FULL_TEXT)


def word_rows(merged: Merged) -> DataFrame:
    """(mbox, seq, text, times): the words of :func:`full_text_rows`, each text with how often its words count; a
    member's texts stand together where that can be had."""
    once = F.lit(1).cast("bigint").alias("times")
    if merged.members is None:
        return full_text_rows(merged).select(*MAIL, "text", once)
    narrow = _rows(merged, [s for s in FULL_TEXT if s not in BULK])
    return narrow.select(*MAIL, "text", once).unionByName(merged.members)


def context_rows(merged: Merged) -> DataFrame:
    """(mbox, seq, section, label, rank, item, text): a mail inside a question's context."""
    return _rows(merged, CONTEXT)


def as_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, text): the rows of each group as one text, sections apart by a blank line.

    For groups that fit one value, such as a mail for an encoder or a prompt for a model.
    """
    label = F.col("label")
    sections = rows.groupBy(*keys, "section", "label").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "text"))).alias("rows"))
    is_body = (label == BODY) | ((label == "") & (F.get("rows", F.lit(0))["rank"] > 0))
    between = F.when(label.endswith(": "), ", ").when(is_body, "\n\n").otherwise("\n")
    texts = F.call_function("array_join", F.transform("rows", lambda r: r["text"]), between)
    head = F.when(label.endswith(": ") | (label == ""), label).otherwise(F.concat(label, F.lit("\n")))
    # Markdown sections stand together under one heading.
    is_markdown = label.startswith("## ")
    shown = sections.select(*keys, F.when(is_markdown, 0).otherwise(F.col("section")).alias("block"), F.struct("section", F.concat(head, texts).alias("text")).alias("s"))
    blocks = shown.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["text"]), "\n")
    text = F.when(F.col("block") == 0, F.concat(F.lit("Markdown Sections:\n"), text)).otherwise(text)
    placed = blocks.select(*keys, F.struct(F.get("s", F.lit(0))["section"].alias("at"), text.alias("text")).alias("b"))
    return placed.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "\n\n").alias("text")
    )
