"""Equality joins whose key may be one value in a large share of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of all rows on; so there are at most as many hot keys.
PARTS = 5_000


def join_left_hot(left: DataFrame, right: DataFrame, key: str, values: list[str], load: str, parts: int = PARTS, key_of: str | None = None) -> DataFrame:
    """``left`` with ``values`` of ``right`` by ``key`` (in ``right`` perhaps by another name), NULL where ``right``
    has no such key.

    ``right`` has each key once, and in ``load`` how many rows of ``left`` (or a number in proportion)
    have it. Keys with at least one in ``parts`` of the whole load are at most ``parts`` rows, whatever
    the data, and are broadcast; their rows of ``left`` are spread over all tasks of the other join.
    """
    enough = F.col(load) * parts >= right.agg(F.sum(load)).scalar()
    name = key_of or key
    hot = right.where(enough).select(F.col(name).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = right.where(~enough).select(
        F.col(name).alias("_cold_key"), F.lit(0).cast("bigint").alias("_cold_salt"), *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*left.columns).bitwiseOR(F.lit(1).cast("bigint")))
    joined = marked.withColumn("_salt", salt).join(
        cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
    )
    return joined.select(*left.columns, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])
