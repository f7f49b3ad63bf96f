"""Contexts and prompts: the mails found for each question, as ordered rows.

A context is the rows of its mails in order; it has as many as its mails need and no size at which it
would change. The order is (position, mbox, seq, section, rank, item, text).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.render import prompt_opening
from ..sinks.scratch import stored
from .lookup import commit_lookup, pr_lookup
from .ordering import span_of, with_sum_before
from .rows import BODY, ROW, as_text

MAIL_ID = ["mbox", "seq"]
HIT = ["query_id", "mode", "key", "position", *MAIL_ID]


def key_hits(routed: DataFrame, pr_table: DataFrame, commit_table: DataFrame) -> DataFrame:
    """(mode, key, mbox, seq): mails of each commit or PR that is asked for at all.

    Questions about the same key share its context, so the lookup runs on distinct keys.
    """
    asked = routed.where("key IS NOT NULL").select("mode", "key", "commit", "pr").distinct()
    keyed = asked.withColumnRenamed("key", "query_id")
    commits = commit_lookup(keyed, commit_table).select(F.lit("commit").alias("mode"), "query_id", "mbox", "seq")
    prs = pr_lookup(keyed, pr_table).select(F.lit("pr").alias("mode"), "query_id", "mbox", "seq")
    return commits.unionByName(prs).withColumnRenamed("query_id", "key")


def key_contexts(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """(mode, key, mbox, seq, section, label, rank, item, text): only mails that are hit are rendered."""
    return hits.join(rows, MAIL_ID).select("mode", "key", *MAIL_ID, *ROW)


def context_hits(routed: DataFrame, pr_table: DataFrame, commit_table: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """(query_id, mode, key, position, mbox, seq): the mails of every question's context, narrow rows only.

    Re-ranked neighbours are at most k to a question.
    """
    asked = routed.where("key IS NOT NULL").select("query_id", "mode", "key")
    keyed = asked.join(key_hits(routed, pr_table, commit_table), ["mode", "key"]).withColumn("position", F.lit(0))
    semantic = semantic_hits.withColumns({"mode": F.lit("semantic"), "key": F.lit(None).cast("string")})
    return keyed.select(*HIT).unionByName(semantic.select(*HIT))


def contexts_of(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, mode, key, position, mbox, seq, section, ...): the rows of each hit.

    Hits that are a stored table are broadcast where they are few, and then no text is shuffled.
    """
    return hits.join(rows, MAIL_ID).select(*HIT, *ROW)


def answer_contexts(
    routed: DataFrame, pr_table: DataFrame, commit_table: DataFrame, rows: DataFrame, semantic_hits: DataFrame
) -> DataFrame:
    """(query_id, mode, key, position, mbox, seq, ...): every question's context; none without hits."""
    return contexts_of(context_hits(routed, pr_table, commit_table, semantic_hits), rows)


def prompts(contexts: DataFrame) -> DataFrame:
    """(query_id, mode, position, mbox, seq, section, label, rank, item, text): the opening of each
    question's prompt, at position -1, and its context."""
    opening = contexts.select("query_id", "mode", "key").distinct().select(
        "query_id", "mode", F.lit(-1).alias("position"), F.lit("").alias("mbox"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(0).alias("section"), F.lit("").alias("label"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).alias("item"),
        prompt_opening(F.col("mode"), F.col("key")).alias("text"),
    )
    return opening.unionByName(contexts.drop("key"))


def prompt_texts(contexts: DataFrame) -> DataFrame:
    """(query_id, mode, prompt): one prompt per question, for contexts that fit one value."""
    mails = as_text(contexts, ["query_id", "mode", "key", "position", *MAIL_ID])
    order = F.array_sort(F.collect_list(F.struct("position", *MAIL_ID, "text")))
    joined = mails.groupBy("query_id", "mode", "key").agg(order.alias("mails"))
    context = F.array_join(F.transform("mails", lambda m: m["text"]), P.CONTEXT_RULER)
    return joined.select("query_id", "mode", F.concat(prompt_opening(F.col("mode"), F.col("key")), context).alias("prompt"))


def budgeted(contexts: DataFrame, budget: int, max_body: int | None = None, span: int = 1024) -> DataFrame:
    """The first rows of each question's context that fit into ``budget`` characters, cut at row ends.

    ``max_body`` bounds each mail's body first: its rows are cut where their texts together, two line
    breaks between them, reach it. Sums run over blocks of rows, so a context of a third of all mails is
    never gathered; what is left of a question is bounded by the budget. A row counts with one line break.
    """
    # Rows of values are in the order of their text, all others in that of rank.
    blocked = contexts.withColumns({"_span": span_of(F.col("rank"), span), "_head": F.when(F.col("rank") == 0, F.left("text", F.lit(2))).otherwise("")})
    order = ["rank", "item", "text"]
    if max_body is not None:
        is_body = F.col("label") == BODY
        mail = ["query_id", "position", *MAIL_ID]
        bodies = with_sum_before(blocked.where(is_body), [*mail, "section"], ["_span", "_head"], order, F.length("text") + 2, "_before")
        room = F.greatest(F.lit(max_body) - F.col("_before"), F.lit(0)).cast("int")
        cut = bodies.withColumn("text", F.when(room > 0, F.left("text", room))).where("text IS NOT NULL AND (text <> '' OR rank = 1)")
        blocked = blocked.where(~is_body).unionByName(cut.drop("_before"))
    places = ["position", *MAIL_ID, "section", "_span", "_head"]
    placed = with_sum_before(blocked, ["query_id"], places, order, F.length("text") + 1, "_before")
    return placed.where(F.col("_before") + F.length("text") <= budget).select(*contexts.columns)


def budgeted_prompts(contexts: DataFrame, budget: int, max_body: int | None = None) -> DataFrame:
    """(query_id, mode, prompt): one text per question; rows that do not fit the budget are left out."""
    return prompt_texts(budgeted(contexts, budget, max_body))


def first_rows(hits: DataFrame, rows: DataFrame, budget: int, max_body: int | None = None, span: int = 16) -> DataFrame:
    """The rows of hit mails with which :func:`budgeted` has to do, the others left out.

    A mail's rows, its body apart where ``max_body`` bounds it, are added up in small blocks. A block that begins
    beyond the bound holds nothing that fits, in whatever context; those before it fill the bound already, so
    no other sum changes what fits. Only lengths are shuffled, and the kept blocks are a few of each mail.
    """
    is_body = (F.col("label") == BODY) & F.lit(max_body is not None)
    bound = F.when(is_body, F.lit(max_body)).otherwise(F.lit(budget))
    block = ["section", "_span", "_head"]
    blocked = rows.withColumns({
        "_part": is_body, "_span": span_of(F.col("rank"), span), "_head": F.when(F.col("rank") == 0, F.left("text", F.lit(8))).otherwise(""),
        "text": F.left("text", bound + 1),
    })
    asked = hits.select(*MAIL_ID).distinct()
    before = Window.partitionBy(*MAIL_ID, "_part").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.join(asked, MAIL_ID).groupBy(*MAIL_ID, "_part", *block).agg(F.sum(F.length("text") + 1).alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .where(F.col("_start") <= F.when(F.col("_part"), F.lit(max_body)).otherwise(F.lit(budget)))
    )
    kept = stored(starts.select(*MAIL_ID, "_part", *block), "blocks")
    return blocked.join(kept, [*MAIL_ID, "_part", *block]).select(*MAIL_ID, *ROW)


def budgeted_answers(hits: DataFrame, rows: DataFrame, budget: int, max_body: int | None = None) -> DataFrame:
    """:func:`budgeted_prompts` of the contexts of ``hits``, which are never formed whole."""
    return budgeted_prompts(contexts_of(hits, first_rows(hits, rows, budget, max_body)), budget, max_body)
