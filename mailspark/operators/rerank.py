"""Re-ranking of neighbours by tags the question mentions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def rerank_by_tags(hits: DataFrame, questions: DataFrame, tags: DataFrame, mail_id: list[str]) -> DataFrame:
    """(query_id, *mail_id, rank, boost, position): +3 per tag found in the question, ties by rank.

    Three equality joins on the hits, of which there are at most k per question.
    """
    low = questions.select("query_id", F.lower("text").alias("low"))
    matching = F.filter("tags", lambda t: F.contains(F.col("low"), F.lower(t)))
    order = Window.partitionBy("query_id").orderBy(F.desc("boost"), "rank")
    return (
        hits.join(tags.select(*mail_id, "tags"), mail_id)
        .join(low, "query_id")
        .withColumn("boost", P.TAG_BOOST * F.when(F.col("tags").isNull(), 0).otherwise(F.size(matching)))
        .withColumn("position", F.row_number().over(order))
        .select("query_id", *mail_id, "rank", "boost", "position")
    )
