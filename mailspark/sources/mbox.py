"""Mailbox files as a splittable source."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAILBOX_GLOB = "*.mbox/mbox"
SEPARATOR = "\nFrom "


def read_mbox(spark: SparkSession, root: str, pattern: str = MAILBOX_GLOB) -> DataFrame:
    """``raw_mails(mbox, seq, raw)`` of every mailbox file below ``root``.

    A message starts at each line beginning ``From ``. Files are split anywhere; a message's
    ``seq`` is the number of messages in earlier splits of its file plus its place in its split.
    The counts are one small row per split, so the message text itself is not shuffled when they
    are small enough to broadcast, which Spark decides from their measured size.
    """
    scan = (
        spark.read.text(f"{root}/{pattern}", lineSep=SEPARATOR)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split_start"),
            # The record number within the task grows along each split.
            F.monotonically_increasing_id().alias("record"),
            F.col("value"),
        )
    )
    file = Window.partitionBy("path")
    earlier = file.orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        scan.groupBy("path", "split_start")
        .agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("first_record"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("total", F.sum("n").over(file))
    )
    seq = F.col("before") + F.col("record") - F.col("first_record")
    mails = scan.join(splits, ["path", "split_start"]).withColumn("seq", seq)

    # Text before the first ``From `` line is no mail; the first mail still has its ``From ``.
    is_mail = (F.col("seq") > 0) | F.startswith(F.col("value"), F.lit("From "))
    # The separator took the line break of the last line away, except at the end of the file;
    # one blank line before a separator or the end is not part of the mail.
    closed = F.when(F.col("seq") < F.col("total") - 1, F.concat("value", F.lit("\n"))).otherwise(F.col("value"))
    text = F.regexp_replace(F.replace(closed, F.lit("\r\n"), F.lit("\n")), r"\n\n\z", "\n")
    envelope_end = F.instr(text, "\n")
    mbox = F.regexp_replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), r"\.mbox$", "")
    return mails.where(is_mail).select(
        mbox.alias("mbox"),
        F.col("seq").cast("bigint").alias("seq"),
        F.when(envelope_end > 0, F.substr(text, envelope_end + 1)).otherwise(F.lit("")).alias("raw"),
    )
