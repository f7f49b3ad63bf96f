"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks by a hash. How many rows of each block go to each shard is drawn first, from
the multivariate hypergeometric law that a uniform permutation of all rows would give; the draws
use only the row counts of the blocks. Each block is then permuted on its own, its first rows go
to shard 0, the next to shard 1 and so on, and each shard is permuted again on arrival. The result
is a uniform shuffle whose shard sizes are exact: they differ by one row at most.

Law: ``rows``. The same rows, shard count and seed give the same result.

Edge cases: a NULL text has size 1 and checksum 0 of no bytes; NULL ids are values like others;
fully repeated rows are rows of their own and share a block; an empty table gives an empty result;
other columns pass through. Columns named ``shard`` or ``slot`` in the input are replaced; names
that begin with an underscore are kept for this module.
"""

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import keep, literal_longs, rank_within

N_SHARDS = 16
#: Blocks and, by shard, cells: the driver holds BLOCKS row counts, and one task sorts a block.
BLOCKS = 1024
SEED = 20


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls are good, drawn without return: inversion from the mode outward."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    p_up = p_down = math.exp(log_choose(good, up) + log_choose(bad, draws - up) - log_choose(good + bad, draws))
    u = rng.random() - p_up
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return up if u <= 0 else min(max((draws * good) // (good + bad), low), high)


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard: exact row and column sums, drawn block by block."""
    total = sum(block_sizes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng, matrix = random.Random(seed), []
    for size in block_sizes:
        rest, left, row = sum(room), size, []
        for s in range(n_shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left)
            left -= k
            row.append(k)
        room = [r - k for r, k in zip(room, row)]
        matrix.append(row)
    return matrix


def shard(rows: DataFrame, n_shards: int = N_SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (0-based place in the shard, gapless).

    Runs one job for the row counts of the blocks (``blocks`` numbers reach the driver) and writes
    the rows with their shard to the shared folder, so that a lost executor can't re-deal them.
    """
    rows = rows.drop("shard", "slot")
    everything = [F.col(f"`{c}`") for c in rows.columns]
    block_of = F.pmod(F.xxhash64(F.lit(seed), *everything), F.lit(blocks)).cast("int")
    counts = dict(rows.groupBy(block_of.alias("_block")).count().collect())
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], n_shards, seed)
    ends = literal_longs(sum(row[: s + 1]) for row in matrix for s in range(n_shards))

    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), *everything), *everything)
    dealt = (
        rows.withColumn("_block", block_of)
        .withColumn("_place", F.row_number().over(local))
        .withColumn(
            "shard",
            F.size(F.filter(F.slice(ends, F.col("_block") * n_shards + 1, n_shards), lambda end: end < F.col("_place"))),
        )
        .drop("_block", "_place")
    )
    return rank_within(keep(dealt), ["shard"], everything, "slot", cells=max(1, blocks // n_shards), seed=seed + 2)


def op7_shards(spark, documents: DataFrame) -> DataFrame:
    narrow = keep(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        )
    )
    return shard(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
