"""Activity of repositories over time.

``repo_activity`` counts mails and keeps a mergeable sketch of the contributors at the finest grain; every
coarser grain is merged from it. ``repo_sessions`` cuts a repository's mails into sessions without one
task per repository: gaps are taken inside blocks of time, and one row per block carries on what lies
between blocks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import mail_time

GRAINS = [("repo", "tag", "week"), ("repo", "week"), ("repo", "tag"), ("repo",), ("tag",), ("week",), ()]
SKETCH_BITS = 14            # about 1.3 % error for many contributors
SESSION_GAP = 12 * 3600     # seconds without a mail that end a session
BLOCK = 86_400              # seconds of a block


def activity(mails: DataFrame) -> DataFrame:
    """(mbox, seq, sender, repos, tags, at, week): mails whose date can be read."""
    dated = mails.select("mbox", "seq", "sender", "repos", "tags", mail_time(F.col("date")).alias("at"))
    return dated.where("at IS NOT NULL").withColumn("week", F.trunc("at", "week"))


def _by_repo_and_tag(active: DataFrame) -> DataFrame:
    none = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.array_distinct(c)).otherwise(F.array(F.lit("")))
    return active.select("mbox", "seq", "sender", "week", F.explode(none("repos")).alias("repo"), "tags").select(
        "mbox", "seq", "sender", "week", "repo", F.explode(none("tags")).alias("tag")
    )


def repo_cube(mails: DataFrame) -> DataFrame:
    """(repo, tag, week, grain, mails, contributors) by grouping sets; ``grain`` names the columns that count.

    Mails and contributors are counted once each in every cell. A mail of no repository or tag has ''.
    """
    rows = _by_repo_and_tag(activity(mails))
    sets = [[F.col(c) for c in grain] for grain in GRAINS]
    cube = rows.groupingSets(sets, "repo", "tag", "week").agg(
        F.grouping_id("repo", "tag", "week").alias("grain"), F.count_distinct("mbox", "seq").alias("mails"),
        F.count_distinct("sender").alias("contributors"),
    )
    return cube.select("repo", "tag", "week", "grain", "mails", "contributors")


def repo_activity(mails: DataFrame) -> DataFrame:
    """(repo, tag, week, entries, contributors): one row per finest cell, contributors as a sketch to be stored."""
    return _by_repo_and_tag(activity(mails)).groupBy("repo", "tag", "week").agg(
        F.count(F.lit(1)).alias("entries"), F.hll_sketch_agg("sender", SKETCH_BITS).alias("contributors")
    )


def rolled_up(cells: DataFrame, *grain: str) -> DataFrame:
    """(*grain, entries, contributors) of coarser cells, from stored cells alone; contributors estimated."""
    return cells.groupBy(*grain).agg(
        F.sum("entries").alias("entries"), F.hll_sketch_estimate(F.hll_union_agg("contributors")).alias("contributors")
    )


def repo_sessions(mails: DataFrame, gap: int = SESSION_GAP, block: int = BLOCK) -> DataFrame:
    """(repo, session, first, last, mails): runs of mails of a repository with no gap above ``gap`` seconds.

    Sessions are numbered from 1 by time.
    """
    active = activity(mails).select("mbox", "seq", F.unix_timestamp("at").alias("t"), F.explode("repos").alias("repo")).distinct()
    timed = active.groupBy("repo", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("t") / block))
    inside = Window.partitionBy("repo", "block").orderBy("t")
    within = timed.withColumn("before", F.lag("t").over(inside))
    blocks = within.groupBy("repo", "block").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum(F.when(F.col("t") - F.col("before") > gap, 1).otherwise(0)).alias("cuts")
    )
    # One row per block and repository: whether it begins a session, and how many began before it.
    order = Window.partitionBy("repo").orderBy("block")
    opened = blocks.withColumn("last_before", F.lag("last_t").over(order)).withColumn(
        "opens", F.when(F.col("last_before").isNull() | (F.col("first_t") - F.col("last_before") > gap), 1).otherwise(0)
    )
    earlier = F.coalesce(F.sum(F.col("opens") + F.col("cuts")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = opened.select("repo", "block", "opens", earlier.alias("earlier"))
    new = F.when(F.col("before").isNull(), F.col("opens")).when(F.col("t") - F.col("before") > gap, 1).otherwise(0)
    numbered = within.join(starts, ["repo", "block"]).withColumn("session", F.col("earlier") + F.sum(new).over(inside))
    return numbered.groupBy("repo", "session").agg(
        F.timestamp_seconds(F.min("t")).alias("first"), F.timestamp_seconds(F.max("t")).alias("last"), F.sum("n").alias("mails")
    )
