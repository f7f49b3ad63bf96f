"""Nearest neighbours by squared Euclidean distance, exact and by hashing.

The distance work runs in NumPy over Arrow batches. Each task keeps only its best k rows per
question; those few rows are ranked by a window. Ties go to the smaller id.
"""

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.patterns import SEMANTIC_K

QUESTION_BLOCK = 4096       # questions of one cell
VECTOR_BLOCK = 20_000       # vectors of one cell
_QUESTION_CHUNK = 256       # questions per distance matrix
_EPS = 1e-6                 # slack of the matrix-product distance before the exact one

# The functions below travel with the tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _best(rows: pd.DataFrame, ids: list[str], k: int) -> pd.DataFrame:
    return rows.sort_values(["query_id", "dist", *ids], kind="stable").groupby("query_id").head(k)


def _rows(table: pa.Table) -> np.ndarray:
    """Column ``embedding`` as a matrix, straight from Arrow's buffer."""
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _nearest(table: pa.Table, ids: list[str], qids: np.ndarray, qmat: np.ndarray, k: int) -> pd.DataFrame:
    """Best k rows of ``table`` for each question: (query_id, *ids, dist)."""
    block = table.select(ids).to_pandas().sort_values(ids, kind="stable")
    single = np.ascontiguousarray(_rows(table)[block.index.to_numpy()], dtype=np.float32)
    block = block.reset_index(drop=True)
    # Of equal vectors only the k with the smallest ids can be among the best k.
    same = pd.Series([row.tobytes() for row in single])
    keep = (same.groupby(same, sort=False).cumcount() < k).to_numpy()
    block, vecs = block[keep].reset_index(drop=True), single[keep].astype(np.float64)
    norms = (vecs * vecs).sum(axis=1)
    found = []
    for start in range(0, len(qids), _QUESTION_CHUNK):
        q = qmat[start : start + _QUESTION_CHUNK]
        rough = (q * q).sum(axis=1)[:, None] + norms[None, :] - 2.0 * (q @ vecs.T)
        if len(vecs) > k:
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
            qi, vi = np.nonzero(rough <= kth + _EPS * (1.0 + np.abs(kth)))
        else:
            qi, vi = (x.ravel() for x in np.indices(rough.shape))
        gap = q[qi] - vecs[vi]
        dist = (gap * gap).sum(axis=1)
        order = np.lexsort((vi, dist, qi))
        qi, vi, dist = qi[order], vi[order], dist[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
        qi, vi, dist = qi[place < k], vi[place < k], dist[place < k]
        rows = block[ids].iloc[vi].reset_index(drop=True)
        rows.insert(0, "query_id", qids[start + qi])
        found.append(rows.assign(dist=dist))
    return pd.concat(found, ignore_index=True)


def _hit_schema(vectors: DataFrame, ids: list[str]) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", T.LongType()),
        *[vectors.schema[c] for c in ids],
        T.StructField("dist", T.DoubleType()),
    ])


def _ranked(partial: DataFrame, ids: list[str], k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", *ids)
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _own_columns(questions: DataFrame) -> DataFrame:
    """Questions may come from the vectors' own table; new names keep the two sides apart."""
    return questions.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("embedding"))


def _matrix(questions: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return questions.column("query_id").to_numpy(), _rows(questions).astype(np.float64)


def _cell_knn(vectors: DataFrame, questions: DataFrame, ids: list[str], cell: list[str], k: int) -> DataFrame:
    """Best k per question inside each cell; a cell holds a bounded number of rows of each side."""
    schema = _hit_schema(vectors, ids)
    arrow = to_arrow_schema(schema)

    def best_of_cell(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return arrow.empty_table()
        return pa.Table.from_pandas(_nearest(v, ids, *_matrix(q), k), schema=arrow, preserve_index=False)

    return questions.groupBy(*cell).cogroup(vectors.groupBy(*cell)).applyInArrow(best_of_cell, schema)


def _blocks(df: DataFrame, size: int):
    """How many blocks of about ``size`` rows a table has: a column, so no job runs before the plan does."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return F.greatest(F.ceil(rows / size), F.lit(1)).cast("int")


def _every(blocks):
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def knn(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = SEMANTIC_K,
    ids: list[str] = ("mbox", "seq"),
    question_block: int = QUESTION_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """(query_id, *ids, dist, rank): the k nearest vectors of each question, exactly.

    One plan for any number of either: a grid of question blocks and vector blocks, whose cells hold
    a bounded number of rows and pass on their best k of each question.
    """
    ids = list(ids)
    vectors, questions = vectors.select(*ids, "embedding"), _own_columns(questions)
    q_blocks, v_blocks = _blocks(questions, question_block), _blocks(vectors, vector_block)
    q = questions.withColumn("qb", F.pmod(F.xxhash64("query_id"), q_blocks).cast("int")).withColumn("vb", _every(v_blocks))
    v = vectors.withColumn("vb", F.pmod(F.xxhash64(*ids), v_blocks).cast("int")).withColumn("qb", _every(q_blocks))
    return _ranked(_cell_knn(v, q, ids, ["qb", "vb"], k), ids, k)


def knn_lsh(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = SEMANTIC_K,
    ids: list[str] = ("mbox", "seq"),
    tables: int = 8,
    hashes_per_table: int = 2,
    bucket_length: float = 0.35,
    seed: int = 7,
) -> DataFrame:
    """Approximate :func:`knn`: only vectors sharing a bucket with the question are compared.

    Buckets are random projections from Spark ML, ``hashes_per_table`` of them together making
    one key. A bucket with many vectors or many questions is cut into cells of bounded size, and
    each cell gives its best k only, so no list of candidate pairs ever exists.
    """
    ids = list(ids)
    model = BucketedRandomProjectionLSH(
        inputCol="_vector", outputCol="_hashes", numHashTables=tables * hashes_per_table,
        bucketLength=bucket_length, seed=seed,
    ).fit(vectors.select(array_to_vector("embedding").alias("_vector")))

    def bucketed(df: DataFrame, keep: list[str]) -> DataFrame:
        hashed = model.transform(df.withColumn("_vector", array_to_vector("embedding")))
        keys = F.array(*[
            F.concat_ws(",", F.lit(t), *[
                vector_to_array(F.get("_hashes", F.lit(t * hashes_per_table + h)))[0].cast("int")
                for h in range(hashes_per_table)
            ])
            for t in range(tables)
        ])
        return hashed.select(*keep, "embedding", F.explode(keys).alias("bucket"))

    v, q = bucketed(vectors, ids), bucketed(_own_columns(questions), ["query_id"])
    sizes = (
        v.groupBy("bucket").agg(F.count(F.lit(1)).alias("nv"))
        .join(q.groupBy("bucket").agg(F.count(F.lit(1)).alias("nq")), "bucket")
        .select(
            "bucket",
            F.ceil(F.col("nv") / VECTOR_BLOCK).cast("int").alias("v_cells"),
            F.ceil(F.col("nq") / QUESTION_BLOCK).cast("int").alias("q_cells"),
        )
    )

    def cells(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    q_cells = q.join(sizes, "bucket").select(
        "query_id", "embedding", "bucket",
        F.pmod(F.xxhash64("query_id"), "q_cells").cast("int").alias("qb"), cells(F.col("v_cells")).alias("vb"),
    )
    v_cells = v.join(sizes, "bucket").select(
        *ids, "embedding", "bucket",
        F.pmod(F.xxhash64(*ids), "v_cells").cast("int").alias("vb"), cells(F.col("q_cells")).alias("qb"),
    )
    partial = _cell_knn(v_cells, q_cells, ids, ["bucket", "qb", "vb"], k)
    return _ranked(partial.groupBy("query_id", *ids).agg(F.min("dist").alias("dist")), ids, k)
