"""A stored approximate index: vectors by cell, compared by short codes first.

``write_cells`` trains a coarse quantiser, puts every vector into its nearest cells and writes one folder
per cell, so that a question reads only the folders of the cells it probes. A vector's code is one
signed byte per component and a scale. ``knn_cells`` compares codes within the probed cells, then takes
exact distances of the best few alone.

Sizes: the quantiser is fitted on at most ``SAMPLE`` vectors (chosen by a hash of their ids) and has
``4 * sqrt(n)`` cells, at most ``CELLS``; every vector is in the index. A cell with many vectors is cut into
blocks, so a third of all vectors in one cell is many tasks. Centres, the only thing that every task
gets, are at most ``CELLS`` vectors. ``probe`` is the share of cells that a question asks; at 1 all vectors
are compared by code.
"""

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.patterns import SEMANTIC_K

SAMPLE, CELLS = 200_000, 4_096
SPILL, PROBE, RERANK = 2, 0.14, 6
BLOCK = 20_000              # vectors of one cell that a task takes
QUESTION_BLOCK = 4_096      # questions of one cell that a task takes
PAIRS = 1 << 20             # distances that a task holds at a time

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _slices(rows: int, width: int) -> list[slice]:
    """Slices of ``rows`` rows, each of at most ``PAIRS`` distances to ``width`` others."""
    step = max(PAIRS // max(width, 1), 1)
    return [slice(i, i + step) for i in range(0, rows, step)]


def train(vectors: DataFrame, ids: list[str], sample: int = SAMPLE, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centres of the cells, by k-means over a sample."""
    n = vectors.count()
    if not n:
        return np.empty((0, 0))
    count = max(min(cells or math.ceil(4 * math.sqrt(n)), CELLS, n), 1)
    share = max(math.floor(n / sample), 1)
    some = vectors.where(F.pmod(F.xxhash64(*ids), F.lit(share)) == 0) if share > 1 else vectors
    fitted = KMeans(k=count, seed=seed, maxIter=10).fit(some.select(array_to_vector("embedding").alias("features")))
    return np.array(fitted.clusterCenters())


def with_cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """One row for each of the ``n`` nearest cells, nearest first in ``place``."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("place", T.IntegerType())])
    norms = (centres**2).sum(axis=1)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(_column(batch, "embedding"), batch.num_rows)
            near = np.concatenate([
                np.argsort(norms[None, :] - 2.0 * x[at] @ centres.T, axis=1, kind="stable")[:, :n].astype(np.int32)
                for at in _slices(len(x), len(centres))
            ])
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
            place = np.tile(np.arange(near.shape[1]), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*again.columns, pa.array(near.ravel(), pa.int32()), pa.array(place, pa.int32())], schema=to_arrow_schema(schema)
            )

    return df.mapInArrow(assign, schema)


def with_codes(df: DataFrame) -> DataFrame:
    """Add ``code`` (a signed byte per component), ``scale`` and ``square`` (the vector's squared length)."""
    added = [T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("square", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *added])

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(_column(batch, "embedding"), batch.num_rows)
            scale = np.abs(x).max(axis=1) / 127.0
            code = np.rint(x / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
            columns = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array((x * x).sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=to_arrow_schema(schema))

    return df.mapInArrow(encode, schema)


class Cells:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = spark.read.parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        self.centres = np.array([r["centre"] for r in rows], np.float64)


def write_cells(
    vectors: DataFrame, path: str, ids: list[str] = ("mbox", "seq"), spill: int = SPILL, cells: int | None = None, block: int = BLOCK
) -> Cells:
    """Write ``vectors(*ids, embedding)`` by cell below ``path``; rows without an embedding are left out."""
    spark, ids = vectors.sparkSession, list(ids)
    vectors = vectors.where("embedding IS NOT NULL").select(*ids, "embedding")
    centres = train(vectors, ids, cells=cells)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    placed = with_cells(with_codes(vectors), centres, spill) if rows else with_codes(vectors).withColumns({"cell": F.lit(0), "place": F.lit(0)})
    # As many blocks to a cell as its vectors fill: one row per cell.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cut = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(*ids), "blocks").cast("int"))
    writer = cut.select(*ids, "embedding", "code", "scale", "square", "block", "cell").repartition("cell", "block").write
    # Without vectors there is no folder of a cell, and the table's columns would be lost with them.
    (writer.partitionBy("cell") if rows else writer).parquet(f"{path}/vectors")
    return Cells(spark, path)


def probes(index: Cells, questions: DataFrame, probe: float = PROBE) -> DataFrame:
    """(query_id, embedding, cell, place): the cells that each question asks."""
    asked = questions.where("embedding IS NOT NULL").select(F.col("query_id").alias("query_id"), F.col("embedding").alias("embedding"))
    return with_cells(asked, index.centres, max(math.ceil(probe * len(index.centres)), 1))


def probed_vectors(index: Cells, asked: DataFrame) -> DataFrame:
    """The stored rows of the cells that any question asks: the other folders are not read."""
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
    return index.vectors.where(F.col("cell").isin(cells))


def candidates(index: Cells, asked: DataFrame, ids: list[str], n: int) -> DataFrame:
    """(query_id, *ids, cell, near): the ``n`` rows nearest by code of each question, over its cells."""
    stored = probed_vectors(index, asked).select(*ids, "cell", "block", "code", "scale", "square")
    blocks = stored.select(F.col("cell").alias("cell"), F.col("block").alias("block")).distinct()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)))
    parts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUESTION_BLOCK).cast("int").alias("parts"))
    placed = asked.join(parts, "cell").withColumn("part", F.pmod("part", "parts").cast("int")).drop("parts").join(blocks, "cell")
    again = parts.select(F.col("cell").alias("cell"), F.col("parts").alias("parts"))
    offered = stored.join(again, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = T.StructType([
        T.StructField("query_id", T.LongType()), *[index.vectors.schema[c] for c in ids],
        T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType()),
    ])
    arrow = to_arrow_schema(schema)

    def best_of_cell(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return arrow.empty_table()
        x = _matrix(q.column("embedding"), q.num_rows)
        code = np.frombuffer(b"".join(v.column("code").to_pylist()), np.int8).reshape(v.num_rows, -1).astype(np.float32)
        scale, square = np.asarray(v.column("scale")), np.asarray(v.column("square"))
        take = min(n, v.num_rows)
        places, nears = [], []
        for at in _slices(len(x), v.num_rows):
            away = square[None, :] - 2.0 * (x[at].astype(np.float32) @ code.T) * scale[None, :] + (x[at] * x[at]).sum(axis=1)[:, None]
            places.append(np.argpartition(away, take - 1, axis=1)[:, :take])
            nears.append(np.take_along_axis(away, places[-1], axis=1))
        best, found = np.concatenate(places), np.concatenate(nears)
        who = np.repeat(np.arange(q.num_rows), take)
        rows = v.select([*ids, "cell"]).take(pa.array(best.ravel()))
        columns = [q.column("query_id").take(pa.array(who)), *rows.columns, pa.chunked_array([found.ravel()])]
        return pa.Table.from_arrays(columns, schema=arrow)

    place = ["cell", "block", "part"]
    found = placed.groupBy(*place).cogroup(offered.groupBy(*place)).applyInArrow(best_of_cell, schema)
    # A vector that lies in two of the cells counts once.
    once = found.groupBy("query_id", *ids).agg(F.min(F.struct("near", "cell")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.near", *ids)
    return once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("query_id", *ids, "at.cell", "at.near")


def knn_cells(
    index: Cells, questions: DataFrame, k: int = SEMANTIC_K, ids: list[str] = ("mbox", "seq"), probe: float = PROBE, rerank: int = RERANK
) -> DataFrame:
    """(query_id, *ids, dist, rank): near neighbours of each question, ranked by exact squared distance."""
    ids = list(ids)
    if not len(index.centres):
        empty = index.vectors.select(*ids).limit(0)
        return empty.select(F.lit(0).cast("bigint").alias("query_id"), *ids, F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    asked = probes(index, questions, probe)
    near = candidates(index, asked, ids, rerank * k)
    stored = probed_vectors(index, asked).select(*ids, "cell", F.col("embedding").alias("_vector"))
    both = near.join(stored, [*ids, "cell"]).join(
        asked.where("place = 0").select("query_id", F.col("embedding").alias("_asked")), "query_id"
    )
    gaps = F.zip_with("_asked", "_vector", lambda a, b: a.cast("double") - b.cast("double"))
    dist = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    order = Window.partitionBy("query_id").orderBy("dist", *ids)
    ranked = both.withColumn("dist", dist).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", *ids, "dist", "rank")


def compared(index: Cells, questions: DataFrame, probe: float = PROBE) -> DataFrame:
    """(codes): how many pairs of question and stored vector are compared by code."""
    sizes = index.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return probes(index, questions, probe).join(sizes, "cell").agg(F.sum("n").alias("codes"))
