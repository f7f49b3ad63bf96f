"""A corpus run end to end: each stage reads the table that the stage before has written.

NULL texts count as empty: they are scored, kept by the near-duplicate stage (no words, no likeness),
and dealt out like others. An empty table passes through. Further columns of ``documents`` pass through.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import keep, table
from mailspark.llm.decontaminate import without_contaminated
from mailspark.llm.mixing import in_mixed_order, schedule, tempered_weights
from mailspark.llm.near_dup import one_of_each
from mailspark.llm.sharding import shard
from mailspark.llm.toxicity import THRESHOLD, train, with_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go (operator 10)."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return with_scores(docs, model, "_score").where(F.col("_score") < THRESHOLD).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, Jaccard 0.8 (operator 4)."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 3)."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get shares in proportion to the root of their size, and the table is laid out in the mixed
    order (operator 9). All documents are kept; of a source that would run out documents are repeated."""
    return in_mixed_order(schedule(docs, tempered_weights(docs), repeat=True)).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal every document into 16 shards of equal row counts, with its place there (operator 7)."""
    return shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The stages train a model and search by MinHash; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
