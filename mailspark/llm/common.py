"""Helpers shared by the operators of this package."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEX_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local session, where that setting is unset, gets a folder of this machine; the setting
    is then made, so that one session has one such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut, and a lost
    executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_within(df: DataFrame, keys: list[str], order: list, rank: str, cells: int = 256, seed: int = 0) -> DataFrame:
    """Add a 0-based random-order rank inside each group of ``keys``, gapless, in two levels.

    Rows fall into ``cells`` cells of their group by a hash of ``order``; they are numbered in
    their cell, and a cell starts where the cells before it end, so a group with a third of all
    rows is never in one task. The starts are one row per group and cell; they are broadcast, so
    the callers have a bounded number of groups. Rows that tie in every column of ``order`` must
    be alike in all that matters.
    """
    placed = df.withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(cells)))
    starts = (
        placed.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_n"))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.xxhash64(F.lit(seed + 1), *order), *order)
    return (
        placed.withColumn("_inside", F.row_number().over(inside))
        .alias("a")
        .join(F.broadcast(starts).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_cell"]])
        .select("a.*", (F.col("b._start") + F.col("a._inside") - 1).cast("bigint").alias(rank))
        .drop("_cell", "_inside")
    )


def literal_longs(values) -> Column:
    """A constant array of longs, as one string literal that the planner folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner", where: Column | None = None) -> DataFrame:
    """An equality join in which NULL equals NULL; the columns of ``names`` come from the left.

    ``where`` adds a condition on columns that only one side has.
    """
    other = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    condition = where if where is not None else F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_right_{n}"))
    return left.join(other, condition, how).drop(*[f"_right_{n}" for n in names])
