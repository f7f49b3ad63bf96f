"""Document fingerprints: chunks cut by content, and sets of their digests.

Cutting: a gear hash runs over the UTF-8 bytes; the hash at a byte depends on the last 32 bytes of
its text only. A chunk may end at a byte whose hash has its low bits zero. Chunk sizes are
normalised: up to ``NORMAL`` bytes the end needs ``HARD_BITS`` zero bits, later only ``EASY_BITS``;
no chunk is shorter than ``LEAST`` (but the last) or longer than ``MOST`` bytes. An edit so moves the
cuts near it only, and the chunks behind it keep their digests.

Fingerprint: the set of (digest, length) of a text's chunks, sorted, as base64 of 64-bit digests
followed by 16-bit lengths. Equal texts have equal fingerprints, the empty text has the empty one.

Likeness: bytes of the chunks that two sets share, over the bytes of the smaller set: a weighted
containment between 0 and 1. Two empty sets are alike (1), an empty and another are not (0).

Neighbours: the next document is that with the next smaller id, after the last the first. Ids are
cut into ranges by quantiles; a range's first document is also sent, as a copy, to the range before,
so no task sees more than its range and no global order is kept. Ties of an id are in the order of
their text's hash, then text; NULL ids come last; a NULL text is empty; other columns are ignored; an empty
table gives an empty result. The ids' quantiles and the ranges' first ids (``RANGES`` of each) reach
the driver; texts are shuffled once.
"""

import base64
import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import literal_longs

LEAST, NORMAL, MOST = 16, 64, 256
HARD_BITS, EASY_BITS = 8, 4
WINDOW = 32
RANGES = 2048
#: Bytes that are hashed at once.
AT_ONCE = 1 << 21

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One 32-bit number per byte value, drawn from a fixed seed.
GEAR = np.random.default_rng(1).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(size: int, hard: list[int], easy: list[int]) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes, from the sorted ends that the hashes allow."""
    ends, start, i, j = [], 0, 0, 0
    n_hard, n_easy = len(hard), len(easy)
    while size - start > LEAST:
        low, mid, high = start + LEAST, start + NORMAL, min(start + MOST, size)
        while i < n_hard and hard[i] < low:
            i += 1
        if i < n_hard and hard[i] <= mid:
            end = hard[i]
        else:
            while j < n_easy and easy[j] <= mid:
                j += 1
            end = easy[j] if j < n_easy and easy[j] < high else high
        ends.append(min(end, size))
        start = ends[-1]
    if start < size:
        ends.append(size)
    return ends


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """Digest to length for each text. Texts are hashed together, 32 bytes apart."""
    out, at = [], 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < AT_ONCE):
            total += len(texts[end]) + WINDOW
            end += 1
        group = texts[at:end]
        data = np.frombuffer((b"\0" * WINDOW).join(group), dtype=np.uint8)
        if len(data):
            masked = gear_of_texts(data, group)
            hard_at = np.flatnonzero((masked & np.uint32((1 << HARD_BITS) - 1)) == 0) + 1
            easy_at = np.flatnonzero((masked & np.uint32((1 << EASY_BITS) - 1)) == 0) + 1
        else:
            hard_at = easy_at = np.empty(0, np.int64)
        start = 0
        for text in group:
            stop = start + len(text)
            own = lambda a: (a[np.searchsorted(a, start, "right"):np.searchsorted(a, stop, "right")] - start).tolist()  # noqa: B023, E731
            found, last = {}, 0
            for c in cuts(len(text), own(hard_at), own(easy_at)):
                found[xxhash.xxh3_64_intdigest(text[last:c])] = c - last
                last = c
            out.append(found)
            start = stop + WINDOW
        at = end
    return out


def gear_of_texts(data: np.ndarray, group: list[bytes]) -> np.ndarray:
    """The gear hash at every byte: the sum of GEAR[byte j back] << j over the last 32 bytes, by
    doubling. The gaps between the texts add nothing, so a text's hashes don't see the one before."""
    values = GEAR[data]
    start = 0
    for text in group:
        stop = start + len(text)
        values[stop : stop + WINDOW] = 0
        start = stop + WINDOW
    width = 1
    while width < WINDOW:
        shifted = values[:-width] << np.uint32(width)
        values[width:] += shifted
        width *= 2
    return values


def fingerprint_of(chunks: dict[int, int]) -> str:
    digests = np.fromiter(sorted(chunks), np.uint64, len(chunks))
    lengths = np.fromiter((chunks[d] for d in digests.tolist()), np.uint16, len(chunks))
    return base64.b64encode(digests.tobytes() + lengths.tobytes()).decode()


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) < len(b) else (b, a)
    shared = sum(n for d, n in small.items() if d in large)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column, for any table with a text column."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            prints = pa.array([fingerprint_of(c) for c in chunk_sets(texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def dealt_by_range(docs: DataFrame, ranges: int) -> DataFrame:
    """Texts with ``part`` (ascending as ids descend), sorted in it; ``extra`` marks the first text of
    the part that follows, as the part's last row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({
        # Ascending as ids descend, without overflow; NULL ids last.
        "down": F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)),
        "tie": F.xxhash64("text"),
    })
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("down", at, 10 * ranges)).first()[0] or []))
    # The number of bounds below a value, by bisection over the constant array.
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    fits = lambda n: (n <= len(bounds)) & (F.get(literal_longs(bounds or [0]), (n - 1).cast("int")) < F.col("down"))
    part = F.aggregate(literal_longs(steps), F.lit(0).cast("bigint"), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))
    rows = rows.withColumn("part", part.cast("int"))

    firsts = rows.groupBy("part").agg(F.min(F.struct("down", "tie")).alias("f")).orderBy("part").collect()
    before = {r["part"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}
    found = {r["part"]: r["f"] for r in firsts}
    by_part = lambda value: F.get(literal_longs([value(p) for p in range(len(bounds) + 1)]), F.col("part"))
    is_first = (F.col("down") == by_part(lambda p: found[p]["down"] if p in found else 0)) & (
        F.col("tie") == by_part(lambda p: found[p]["tie"] if p in found else 0)
    )
    also = F.when(is_first, by_part(lambda p: before.get(p, -1)).cast("int"))
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.when(
        also.isNotNull(), F.struct(also.alias("part"), F.lit(True).alias("extra"))
    )))
    return (
        rows.withColumn("place", F.explode(places))
        .select("doc_id", "text", "down", "tie", "place.part", "place.extra")
        .repartition("part")
        .sortWithinPartitions("part", "extra", "down", "tie", "text")
        .select("doc_id", "text", "part", "extra")
    )


def _pairs(batches):
    """Rows of one task, in order, with each its following row of the same part."""
    last = None
    for batch in batches:
        ids, texts, parts, extras = (batch.column(i).to_pylist() for i in range(4))
        chunks = chunk_sets([t.encode() for t in texts])
        rows = list(zip(ids, texts, parts, extras, chunks))
        if last:
            rows.insert(0, last)
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[2] == b[2] and not a[3]]
        last = rows[-1] if rows else last
        yield pairs


def _results(batches):
    for pairs in _pairs(batches):
        changed = [edited(a[1], b[1]) for a, b in pairs]
        sets = chunk_sets([t.encode() for t in changed])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([fingerprint_of(a[4]) for a, _ in pairs], pa.string()),
                pa.array([fingerprint_of(c) for c in sets], pa.string()),
                pa.array([likeness(a[4], c) for (a, _), c in zip(pairs, sets)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def op1_fingerprints(spark, documents: DataFrame, ranges: int = RANGES) -> DataFrame:
    return dealt_by_range(documents, ranges).mapInArrow(
        _results,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
