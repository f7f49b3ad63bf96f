"""The search index as Parquet tables.

An index is a folder of runs and a manifest. A run writes its tables below a folder of its own name;
when all are there it adds one generation to the manifest, which names the folders of every table.
Readers take the last generation, so a run that stopped half way is not seen, and a reader keeps the
tables it began with while mailboxes are added.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import BatchEncoder, HashedEncoder, Terms, terms_of
from ..operators.extract import extract, parse_mails
from ..operators.lookup import mail_commit, mail_pr
from ..operators.merge import Merged, members, merge_by_pr
from ..operators.rows import as_text, full_text_rows, word_rows
from ..sources.mbox import read_mbox
from .scratch import store

TERMS = [f"terms_{n}" for n in Terms.NAMES]
TABLES = ["mails", *[f"merged_{n}" for n in Merged.NAMES], "mail_pr", "mail_commit", *TERMS, "vectors"]
MANIFEST = "generation int, table string, path string"


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Range-cluster rows by key, so that file statistics let a lookup skip files.

    Ranges are cut by row counts over all keys, so one large mailbox spreads over many files.
    """
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def manifest(spark: SparkSession, out: str) -> list:
    """(generation, table, path) of the last finished generation; nothing where there is none."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{out}/manifest/*").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return []
    last = max((r["generation"] for r in rows), default=None)
    return [r for r in rows if r["generation"] == last]


def finish(spark: SparkSession, out: str, generation: int, paths: dict[str, list[str]]) -> None:
    """Name the tables of a generation; written last, and whole or not at all."""
    rows = [(generation, table, path) for table, of in paths.items() for path in of]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{out}/manifest/{generation}")


def _write_tables(mails: DataFrame, run: str, keep_unlinked: bool, **merge_options) -> dict[str, DataFrame]:
    """Every table that depends on the given mails alone."""
    tables = {"mails": store(mails, f"{run}/mails")}
    who = store(members(tables["mails"], keep_unlinked), f"{run}/members")
    merged = merge_by_pr(tables["mails"], who, **merge_options).map(
        lambda name, table: store(clustered(table, "mbox", "seq"), f"{run}/merged_{name}")
    )
    tables |= {f"merged_{name}": getattr(merged, name) for name in Merged.NAMES}
    tables["mail_pr"] = store(clustered(mail_pr(merged.heads), "pr", "mbox", "seq"), f"{run}/mail_pr")
    tables["mail_commit"] = store(clustered(mail_commit(merged.values), "key", "mbox", "seq"), f"{run}/mail_commit")
    terms = terms_of(word_rows(merged), merged.heads).map(lambda name, table: store(table, f"{run}/terms_{name}"))
    return tables | {f"terms_{name}": getattr(terms, name) for name in Terms.NAMES}


def _vectors(tables: dict[str, DataFrame], encoder: BatchEncoder | None, new: Merged) -> DataFrame:
    """Vectors of all mails by the native encoder, or of the new ones by a given model."""
    if encoder is None:
        return HashedEncoder(terms_in(tables)).mails()
    return encoder(as_text(full_text_rows(new), ["mbox", "seq"]))


def write_index(mails: DataFrame, out: str, encoder: BatchEncoder | None = None, keep_unlinked: bool = False, **merge_options) -> dict[str, DataFrame]:
    """Write mails, the tables of merged mails, key tables, term statistics and vectors below ``out`` as a new
    generation; return them. Without an encoder the vectors are those of the native one."""
    run = f"{out}/{uuid.uuid4().hex}"
    tables = _write_tables(mails, run, keep_unlinked, **merge_options)
    tables["vectors"] = store(_vectors(tables, encoder, merged_of(tables)), f"{run}/vectors")
    last = manifest(mails.sparkSession, out)
    finish(mails.sparkSession, out, last[0]["generation"] + 1 if last else 0, {t: [f"{run}/{t}"] for t in TABLES})
    return tables


def add_mails(mails: DataFrame, out: str, encoder: BatchEncoder | None = None, keep_unlinked: bool = False, **merge_options) -> dict[str, DataFrame]:
    """Add the mails of further mailboxes to an index; return its tables.

    Mails merge inside their mailbox, so a mailbox is added as a whole; one that the index has already is
    refused. What is stored stays; only the frequencies are added up, and the native encoder's vectors, whose
    weights have changed, are made anew from the stored words. No stored mail is read.
    """
    spark = mails.sparkSession
    last = manifest(spark, out)
    if not last:
        raise ValueError(f"no finished index in {out}")
    run = f"{out}/{uuid.uuid4().hex}"
    before = read_index(spark, out)
    new = _write_tables(mails, run, keep_unlinked, **merge_options)
    known = new["merged_heads"].select("mbox").distinct().join(before["merged_heads"].select("mbox"), "mbox", "left_semi").limit(5).collect()
    if known:
        raise ValueError(f"mailboxes {[r['mbox'] for r in known]} are in the index already")
    paths = {t: [r["path"] for r in last if r["table"] == t] + [f"{run}/{t}"] for t in TABLES}
    both = lambda t: before[t].unionByName(new[t])
    store(both("terms_frequency").groupBy("word").agg(F.sum("df").alias("df")), f"{run}/all_frequency")
    store(both("terms_total").agg(F.sum("total").alias("total")), f"{run}/all_total")
    paths |= {"terms_frequency": [f"{run}/all_frequency"], "terms_total": [f"{run}/all_total"]}
    tables = {t: spark.read.parquet(*paths[t]) for t in TABLES if t != "vectors"}
    store(_vectors(tables, encoder, merged_of(new)), f"{run}/vectors")
    if encoder is None:
        paths["vectors"] = [f"{run}/vectors"]
    finish(spark, out, last[0]["generation"] + 1, paths)
    return read_index(spark, out)


def read_index(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the last finished generation."""
    last = manifest(spark, out)
    if not last:
        raise ValueError(f"no finished index in {out}")
    return {t: spark.read.parquet(*[r["path"] for r in last if r["table"] == t]) for t in TABLES}


def terms_in(tables: dict[str, DataFrame]) -> Terms:
    """The term statistics of an index."""
    return Terms(*[tables[t] for t in TERMS])


def merged_of(tables: dict[str, DataFrame]) -> Merged:
    """The merged mails of an index."""
    return Merged(*[tables[f"merged_{n}"] for n in Merged.NAMES])


def index_mailboxes(spark: SparkSession, root: str, out: str, encoder: BatchEncoder | None = None, **merge_options):
    """Mailbox files below ``root`` to a stored index below ``out``."""
    return write_index(extract(parse_mails(read_mbox(spark, root))), out, encoder, **merge_options)


def ingest_counts(heads: DataFrame) -> DataFrame:
    """(mailboxes, mails): mailboxes found and mails kept after the merge."""
    return heads.agg(F.countDistinct("mbox").alias("mailboxes"), F.count(F.lit(1)).alias("mails"))
