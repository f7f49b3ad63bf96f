"""Questions widened by what their best lexical hits are about.

The repositories, pull requests and tickets of a question's first lexical hits are its feedback: their words,
weighed like those of a mail, are added to the question's own before it becomes a vector. Only the
hits' entity rows and the stored term statistics are read.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embed import Terms, unit_vectors, weighed_words, word_counts
from .merge import Merged

HITS, WORDS, SHARE = 3, 10, 0.5


def entity_rows(merged: Merged) -> DataFrame:
    """(mbox, seq, text): pull requests, repositories and tickets of merged mails."""
    prs = merged.heads.select("mbox", "seq", F.explode(F.col("pr_numbers").cast("array<string>")).alias("text"))
    return prs.unionByName(merged.values.where("field IN ('repos', 'tickets')").select("mbox", "seq", F.col("value").alias("text")))


def _scaled(weighed: DataFrame, share: float) -> DataFrame:
    """Weights of a question scaled to length ``share``."""
    norm = weighed.groupBy(F.col("query_id").alias("_query")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, F.col("query_id") == F.col("_query")).where("norm > 0").select(
        "query_id", "word", (F.col("w") / F.col("norm") * share).alias("w")
    )


def expansion(hits: DataFrame, entities: DataFrame, terms: Terms, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """(query_id, word, w): the weightiest ``words`` words of each question's hits, of length ``share`` together.

    ``hits`` are the first few mails of each question.
    """
    found = hits.select("query_id", "mbox", "seq").join(entities, ["mbox", "seq"])
    weighed = weighed_words(word_counts(found, ["query_id"]), terms)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("w", 9)), "word")
    first = weighed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= words)
    return _scaled(first.select("query_id", "word", "w"), share)


def augmented_questions(questions: DataFrame, added: DataFrame, terms: Terms) -> DataFrame:
    """(query_id, embedding): the question's own words at length 1 and those added to it."""
    own = _scaled(weighed_words(word_counts(questions, ["query_id"]), terms).select("query_id", "word", "w"), 1.0)
    return unit_vectors(own.unionByName(added), ["query_id"])
