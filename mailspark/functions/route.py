"""Which kind of question is it: commit, pull request or semantic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def question_commit(question: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(question), P.QUESTION_COMMIT, 0), F.lit(""))


def question_pr(question: Column) -> Column:
    """First PR number in pattern order; NULL when the question names a commit."""
    low = F.lower(question)
    hits = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in P.QUESTION_PRS]
    return F.when(question_commit(question).isNull(), F.coalesce(*hits).try_cast("bigint"))


def question_mode(commit: Column, pr: Column) -> Column:
    return (
        F.when(commit.isNotNull(), F.lit("commit"))
        .when(pr != 0, F.lit("pr"))
        .otherwise(F.lit("semantic"))
    )
