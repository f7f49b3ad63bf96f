"""The registered queries of this package, each over its whole tables."""

from pyspark.sql import DataFrame, SparkSession

from public_tokenizers import path

from . import oracles
from .bpe import op12_digests, read_tokenizer
from .common import table
from .chat import op5_digests
from .decontaminate import op3_contaminations
from .fim import op13_digests
from .fingerprint import op1_fingerprints
from .hard_negatives import op11_mined
from .html_template import op2_main_text
from .line_dedup import op8_removed
from .mixing import op9_mixture
from .near_dup import op4_components
from .pii import op6_spans
from .sharding import op7_shards
from .toxicity import op10_scores

QUERIES = {}
#: SQL where it can express an operator; the others are tested against brute force, round trips and
#: held-out labels in tests/llm.
ORACLES = {
    "op3_contamination": oracles.CONTAMINATION,
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op8_line_set_join": oracles.LINES,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_shards(spark, table(spark, sf_dir, "documents"))


@query
def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_digests(spark, table(spark, sf_dir, "conversations"))


@query
def op9_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mixture(spark, table(spark, sf_dir, "documents"))


@query
def op1_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_fingerprints(spark, table(spark, sf_dir, "documents"))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_spans(spark, table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_contaminations(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_components(spark, table(spark, sf_dir, "documents"))


@query
def op2_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_main_text(spark, table(spark, sf_dir, "pages"))


@query
def op8_line_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_removed(spark, table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_mined(spark, table(spark, sf_dir, "embeddings"))


@query
def op12_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_digests(spark, table(spark, sf_dir, "documents"), read_tokenizer(path("byte_bpe_50k.json")))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_digests(spark, table(spark, sf_dir, "documents"))
