"""Tables written on the way, so that later steps scan them and do not recompute them."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="mailspark-")
    return f"{base.rstrip('/')}/mailspark-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: later steps scan its columns and do not recompute it."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    return store(df, f"{scratch_dir(df.sparkSession)}/{name}")
