"""Question routing and exact lookups by commit or pull request."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import commit_short
from ..functions.route import question_commit, question_mode, question_pr
from ..functions.text import strip


def routes(questions: DataFrame) -> DataFrame:
    """(query_id, question, commit, pr, mode, key): what each question asks for."""
    return (
        questions.select("query_id", strip(F.col("text")).alias("question"))
        .withColumn("commit", question_commit(F.col("question")))
        .withColumn("pr", question_pr(F.col("question")))
        .withColumn("mode", question_mode(F.col("commit"), F.col("pr")))
        .withColumn(
            "key",
            F.when(F.col("mode") == "commit", F.col("commit")).when(F.col("mode") == "pr", F.col("pr").cast("string")),
        )
    )


def mail_pr(heads: DataFrame) -> DataFrame:
    """(pr, mbox, seq): PR numbers of merged mails, which are their leader's."""
    return heads.select(F.explode("pr_numbers").alias("pr"), "mbox", "seq")


def mail_commit(values: DataFrame) -> DataFrame:
    """(key, mbox, seq): every text a commit can be asked by - SHA, short SHA or message."""
    keys = F.array_compact(F.array("value", commit_short(F.col("value")), "detail"))
    return values.where("field = 'commits'").select(F.explode(keys).alias("key"), "mbox", "seq").distinct()


def pr_lookup(routed: DataFrame, pr_table: DataFrame) -> DataFrame:
    """(query_id, pr, mbox, seq): merged mails of the PR a question names."""
    asked = routed.where("mode = 'pr'").select("query_id", "pr")
    return asked.join(pr_table, "pr").select("query_id", "pr", "mbox", "seq")


def commit_lookup(routed: DataFrame, commit_table: DataFrame, prefix: bool = False) -> DataFrame:
    """(query_id, commit, mbox, seq): merged mails with the commit a question names.

    ``prefix`` also finds keys that begin with the named text; the join stays an equality, on the
    first seven characters.
    """
    asked = routed.where("mode = 'commit'").select("query_id", "commit")
    if prefix:
        found = asked.withColumn("head", F.left("commit", F.lit(7))).join(
            commit_table.withColumn("head", F.left("key", F.lit(7))), "head"
        ).where(F.startswith("key", "commit"))
    else:
        found = asked.join(commit_table, asked["commit"] == commit_table["key"])
    return found.select("query_id", "commit", "mbox", "seq").distinct()


def lookup_misses(routed: DataFrame, pr_table: DataFrame, commit_table: DataFrame) -> DataFrame:
    """(query_id, mode, key): questions whose commit or PR no mail has."""
    no_commit = routed.where("mode = 'commit'").join(
        commit_table, routed["commit"] == commit_table["key"], "left_anti"
    )
    no_pr = routed.where("mode = 'pr'").join(pr_table, "pr", "left_anti")
    return no_commit.select("query_id", "mode", "key").unionByName(no_pr.select("query_id", "mode", "key"))
