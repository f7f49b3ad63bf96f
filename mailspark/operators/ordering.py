"""Positions inside a group that may hold a large share of all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65536


def span_of(seq: Column, span: int = SPAN) -> Column:
    """First position of a position's block: at most ``span`` distinct positions share it."""
    return seq - seq % span


def chunk_of(rank: Column, size: int) -> Column:
    """0-based chunk number of a 1-based rank, ``size`` ranks to a chunk."""
    return F.floor((rank - 1) / size).cast("bigint")


def with_rank(
    df: DataFrame,
    keys: list[str],
    blocks: list[str],
    order: list[str],
    rank: str = "rank",
    group_aggs: dict[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its group, without one task per group.

    ``blocks`` must be a coarse prefix of ``order`` (rows sorted by ``order`` are sorted by
    ``blocks``) with few rows per (keys, blocks). Rows are numbered inside their block only; the
    block's start is a running sum over block counts, one row per block. A group of n rows thus
    spreads over its blocks, and the only per-group work is over n / block-size small rows.

    ``group_aggs`` maps a new column to (aggregate, fold) with fold one of min, max, sum: the
    aggregate is taken per block, folded over the group, and joined back the same way.
    """
    place = keys + blocks
    inside = Window.partitionBy(*place).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    folds = {"min": F.min, "max": F.max, "sum": F.sum}
    aggs = group_aggs or {}

    starts = (
        df.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("_n"), *[a.alias(c) for c, (a, _) in aggs.items()])
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumns({c: folds[fold](c).over(group) for c, (_, fold) in aggs.items()} if aggs else {})
        .drop("_n")
    )
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(starts, place)
        .withColumn(rank, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_start", "_inside")
    )


def with_sum_before(df: DataFrame, keys: list[str], blocks: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of each row's group, without one task per group.

    ``blocks`` is a coarse prefix of ``order``, as in :func:`with_rank`: rows are added up inside their
    block, and a block starts with the sum of the blocks before it, one row each.
    """
    place = keys + blocks
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    valued = df.withColumn("_value", value)
    starts = (
        valued.groupBy(*place).agg(F.sum("_value").alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(*keys).orderBy(*blocks))), F.lit(0)))
        .drop("_sum")
    )
    inside = F.coalesce(F.sum("_value").over(before(Window.partitionBy(*place).orderBy(*order))), F.lit(0))
    return (
        valued.withColumn("_inside", inside).join(starts, place)
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_value", "_start", "_inside")
    )
