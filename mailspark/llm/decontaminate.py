"""Benchmark items inside documents, by a size-partitioned MinHash containment search.

A MinHash signature tells a short item in a long document only if both are of like size. So both are
partitioned by size: an item of q shingles has the level S, the smallest power of two that is at least
q, be it 1; a document is cut into segments of S shingles for each level that the benchmark has. Segment and
item have 32-bit minima under ``COORDINATES`` hashes. If a part t of the item's shingles is in the
document, wherever it lies, one coordinate of the item equals that of some segment with a chance of at
least t * q / (q + S), at least t / 3. With t = 0.8 and 64 coordinates an item is overlooked with a
chance below 3e-9. Items and segments that share a coordinate value of a level are candidates; each is
verified on the exact shingle sets of item and document.

The documents meet the items' values first in a Bloom filter of bounded size, which only saves work;
then only documents that pass travel, once, to the join. Item signatures are joined, not broadcast.

Shingles are five words. An item with fewer words has one shingle, its whole sequence, and is found in
a document of just that text; an item or document without words is never part of a pair. NULL texts
have no words. Repeated items or documents are rows of their own; NULL ids are kept. Other columns of
both tables are ignored. An empty table gives no pairs.
"""

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_on, keep
from .shingles import coordinate, groups, mix, shingle_hashes, shingle_sets, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, THRESHOLD = 5, 0.8
COORDINATES = 64
#: Bits of the Bloom filter: 1,024 per value, as a document has thousands of values, between these.
BITS_A_VALUE, LEAST_BITS, MOST_BITS = 1024, 1 << 20, 1 << 27


def level_of(size: int) -> int:
    """log2 of the segment size for an item of ``size`` shingles."""
    return (size - 1).bit_length()


def post_keys(minima: np.ndarray, k: int, level: int) -> np.ndarray:
    """One number for (level, coordinate, value)."""
    return mix(minima.astype(np.uint64) + np.uint64((level << 48) | (k << 40)))


def item_postings(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, size, level, key``: a row for each coordinate of each item; ``item`` numbers rows."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            out = []
            for i, text, s in zip(ids, texts, shingle_sets(texts, WORDS)):
                if len(s):
                    level = level_of(len(s))
                    keys = np.array([post_keys(coordinate(s, k).min(keepdims=True), k, level)[0] for k in range(COORDINATES)])
                    out.append((i, text.decode(), len(s), level, keys.view(np.int64).tolist()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            names = ("item_id", "item_text", "size", "level", "keys")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return benchmark.select("item_id", "text").mapInArrow(
        run, "item_id bigint, item_text string, size bigint, level int, keys array<bigint>"
    )


def bloom(postings: DataFrame) -> np.ndarray:
    """Two bits for each key; at most MOST_BITS in all reach the driver."""
    n = postings.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_VALUE * max(n, 1) - 1).bit_length()))
    spots = postings.select(
        F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))).alias("bit")
    )
    words = spots.groupBy(F.shiftright("bit", 5).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 31 AS int)))").alias("mask")
    )
    filled = np.zeros(bits // 32, np.uint32)
    for word, mask in words.collect():
        filled[word] = mask
    return filled


def possible(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(filled) * 32 - 1)
    out = np.ones(len(keys), bool)
    for spot in (keys & bits, (keys >> np.uint64(32)) & bits):
        out &= (filled[(spot >> np.uint64(5)).astype(np.int64)] >> (spot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return out


def segment_starts(starts: np.ndarray, size: int) -> np.ndarray:
    """Where the segments of all texts begin."""
    lengths = np.diff(starts)
    pieces = -(-lengths // size)
    first = np.repeat(starts[:-1], pieces)
    return first + size * (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces))


def hits_of(texts: list[bytes], filled: np.ndarray, levels: list[int]) -> list[np.ndarray]:
    """For each text the keys of its segments that pass the filter."""
    shingles, starts = shingle_hashes(texts, WORDS)
    found_text, found_key = [], []
    if len(shingles):
        cuts = {level: segment_starts(starts, 1 << level) for level in levels}
        owners = {level: np.searchsorted(starts, c, "right") - 1 for level, c in cuts.items()}
        for k in range(COORDINATES):
            values, below = coordinate(shingles, k), None
            for level in levels:
                # A larger segment begins where a smaller one does.
                at = cuts[level] if below is None else np.searchsorted(cuts[below], cuts[level])
                values, below = np.minimum.reduceat(values, at), level
                keys = post_keys(values, k, level)
                passed = np.flatnonzero(possible(filled, keys))
                found_text.append(owners[level][passed])
                found_key.append(keys[passed])
    of = np.concatenate(found_text) if found_text else np.empty(0, np.int64)
    keys = np.concatenate(found_key) if found_key else np.empty(0, np.uint64)
    order = np.argsort(of, kind="stable")
    limits = np.searchsorted(of[order], np.arange(len(texts) + 1))
    return [np.unique(keys[order[a:b]]) for a, b in zip(limits, limits[1:])]


def document_hits(docs: DataFrame, filled: np.ndarray, levels: list[int]) -> DataFrame:
    """Documents that may hold an item: ``doc_id, text, row, keys``; ``row`` numbers them."""
    held = docs.sparkSession.sparkContext.broadcast((filled, levels))

    def run(batches):
        from pyspark import TaskContext

        filled, levels = held.value
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in groups([len(t) for t in texts]):
                out = []
                for i, text, keys in zip(ids[a:b], texts[a:b], hits_of(texts[a:b], filled, levels)):
                    if len(keys):
                        row += 1
                        out.append((i, text.decode(), row, keys.view(np.int64).tolist()))
                cols = list(zip(*out)) or [[]] * 4
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=("doc_id", "text", "row", "keys"))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, row bigint, keys array<bigint>")


@F.pandas_udf(T.LongType())
def shared_shingles(text: pd.Series, item: pd.Series) -> pd.Series:
    """How many shingles of the item are in the text."""
    sets = zip(shingle_sets([t.encode() for t in text], WORDS), shingle_sets([t.encode() for t in item], WORDS))
    return pd.Series([len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets], dtype="int64")


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item that it holds: ``doc_id, text_hash, item_id, n_item_shingles,
    n_shared, containment``. Writes the items and the documents that may match to the shared folder."""
    items = keep(item_postings(benchmark).withColumn("item", F.monotonically_increasing_id()))
    postings = items.select("item", F.explode("keys").alias("key"))
    levels = sorted(r[0] for r in items.select("level").distinct().collect())
    hits = keep(document_hits(docs, bloom(postings), levels))
    candidates = (
        hits.select("row", F.explode("keys").alias("key")).join(postings, "key").select("row", "item").distinct()
    )
    pairs = candidates.join(hits.drop("keys"), "row").join(items.drop("keys", "level"), "item")
    shared = pairs.withColumn("n_shared", shared_shingles("text", "item_text"))
    return shared.where(F.col("n_shared") * 100 >= F.col("size") * round(threshold * 100)).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "item_id", F.col("size").alias("n_item_shingles"), "n_shared",
        (F.col("n_shared") / F.col("size")).alias("containment"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item."""
    leaks = contaminations(docs, benchmark).select("doc_id", "text_hash").distinct()
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return join_on(keyed, leaks.withColumnRenamed("text_hash", "_text_hash"), ["doc_id", "_text_hash"], "left_anti").drop("_text_hash")


def op3_contaminations(spark, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminations(documents, benchmark).drop("text_hash")
