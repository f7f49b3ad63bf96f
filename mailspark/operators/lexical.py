"""Weighted text match: which mails have values that occur inside a question.

A value counts when it is a substring of the lower-cased question. Testing every question against
every mail is avoided: the distinct values are matched to the questions by equality joins, and
mails that have the same matching values are scored once.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.render import commit_short
from .merge import Merged

MAIL_ID = ["mbox", "seq"]
HEAD = 4           # length of the value head that is looked up first

# Scored fields that are lists of the merged mail; a commit's short SHA is part of its SHA, so it decides alone.
LIST_FIELDS = {"repos": "repo", "tickets": "ticket", "commits": "commit", "files_modified": "file", "contributors": "contributor"}


def mail_values(merged: Merged) -> DataFrame:
    """(mbox, seq, value, weight): lower-cased values of a mail with their weights."""
    head_fields = {"pr": F.col("pr_numbers").cast("array<string>"), "title": F.array("pr_title"), "tag": F.col("tags")}
    none = F.array().cast("array<struct<weight:int,value:string>>")

    def weighted(field: str):
        weight = F.lit(P.SCORE_WEIGHTS[field]).alias("weight")
        return F.coalesce(F.transform(head_fields[field], lambda x: F.struct(weight, F.lower(x).alias("value"))), none)

    pairs = [weighted(f) for f in head_fields]
    of_heads = merged.heads.select(*MAIL_ID, F.explode(F.concat(*pairs)).alias("p")).select(*MAIL_ID, "p.value", "p.weight")
    weights = F.create_map(*[F.lit(x) for f, w in LIST_FIELDS.items() for x in (f, P.SCORE_WEIGHTS[w])])
    value = F.when(F.col("field") == "commits", commit_short(F.col("value"))).otherwise(F.col("value"))
    of_lists = merged.values.where(F.col("field").isin(*LIST_FIELDS)).select(
        *MAIL_ID, F.lower(value).alias("value"), F.element_at(weights, F.col("field")).alias("weight")
    )
    return of_heads.unionByName(of_lists).where("value <> ''")


def values_in_questions(values: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, value): every distinct value that is a substring of a question.

    Each question position looks up its next one to four characters among the heads of the
    values; a head brings the lengths of its values, and the text of such a length is looked up
    among the values themselves. Values shorter than a head are their own head.
    """
    vocabulary = values.select("value").distinct()
    heads = (
        vocabulary.groupBy(F.left("value", F.lit(HEAD)).alias("head"))
        .agg(F.collect_set(F.length("value")).alias("lengths"))
    )
    low = questions.select("query_id", F.lower("text").alias("low"))
    chars = low.select("query_id", F.split("low", "").alias("chars"))
    heads_at = F.transform(
        "chars",
        lambda c, i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(HEAD), F.size("chars") - i)),
            lambda n: F.struct((i + 1).alias("start"), F.array_join(F.slice("chars", i + 1, n), "").alias("head")),
        ),
    )
    # One row per (question, start, length): a head shorter than HEAD has its own length only.
    spans = (
        chars.select("query_id", F.explode(F.flatten(heads_at)).alias("g"))
        .select("query_id", "g.start", "g.head")
        .join(heads, "head")
        .select("query_id", "start", F.explode("lengths").alias("length"))
    )
    candidates = (
        spans.join(low, "query_id")
        .select("query_id", F.substring("low", F.col("start"), F.col("length")).alias("value"))
        .distinct()
    )
    return candidates.join(vocabulary, "value").select("query_id", "value")


def lexical_scores(values: DataFrame, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(*pairs, score) of pairs (query_id, mbox, seq) that are already formed; 0 without a match."""
    matched = values_in_questions(values, questions)
    found = (
        pairs.join(values, MAIL_ID).join(matched, ["query_id", "value"])
        .groupBy("query_id", *MAIL_ID).agg(F.sum("weight").cast("double").alias("score"))
    )
    return pairs.join(found, ["query_id", *MAIL_ID], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def lexical_top(values: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, mbox, seq, score, rank): the k best mails by score; mails scoring 0 never appear.

    Mails whose values that occur in any question are the same, with the same weights, are one kind.
    Kinds are scored, and of a kind only its first k mails can be among a question's best.
    """
    matched = values_in_questions(values, questions)
    wanted = matched.select("value").distinct()
    used = values.join(wanted, "value").groupBy(*MAIL_ID, "value").agg(F.sum("weight").alias("weight"))
    kinds = used.groupBy(*MAIL_ID).agg(F.array_sort(F.collect_list(F.struct("value", "weight"))).alias("kind"))
    place = Window.partitionBy("kind").orderBy(*MAIL_ID)
    firsts = kinds.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")
    scores = (
        firsts.select("kind").distinct()
        .select("kind", F.explode("kind").alias("v")).select("kind", "v.value", "v.weight")
        .join(matched, "value")
        .groupBy("query_id", "kind").agg(F.sum("weight").cast("double").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *MAIL_ID)
    return (
        scores.join(firsts, "kind")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", *MAIL_ID, "score", "rank")
    )


def hybrid_hits(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """(query_id, *mail_id, source, rank): lexical hits first, then neighbours not yet among them.

    Both inputs hold at most k rows per question.
    """
    keys = [c for c in lexical.columns if c not in ("score", "rank")]
    both = lexical.select(*keys, F.lit(0).alias("tier"), "rank").unionByName(
        semantic.select(*keys, F.lit(1).alias("tier"), "rank")
    )
    once = both.groupBy(*keys).agg(F.min(F.struct("tier", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.tier", "at.rank")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*keys, F.when(F.col("at.tier") == 0, "lexical").otherwise("semantic").alias("source"), "rank")
    )
