"""Fill-in-the-middle rewriting by repeated-capture matching.

One full match of ``(unit)*`` by the ``regex`` library keeps every repetition of its group, so
``match.ends(1)`` gives the number of units and the offset after each at once: both cuts are looked
up in it. A unit is a code point unless another pattern is given (``\\X`` for grapheme clusters).

Where a text is cut, and into which form, follows from its ``doc_id`` and the seed alone, so a lost
task gives the same rows again. Defined cases: a NULL text is empty; an empty text, a text with one
of the sentinels in it, and a text that is not a sequence of units stay as they are (``plain``); a
NULL ``doc_id`` is drawn like an empty one; repeated rows give equal rows; columns of the documents
that have the name of a new column are replaced, all others pass through. Work and memory of a task
follow its longest text: some 50 bytes a character.
"""

import hashlib
import sys

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 1, 90, 20
ROWS = 200
ADDED = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def rewrite(text: str, numbers: tuple[int, int, int, int], units, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT):
    """(n, form, prefix_chars, middle_chars, output) of a text; ``units`` is the compiled ``(unit)*``."""
    match = units.fullmatch(text)
    ends = match.ends(1) if match else []
    n, (first, second, third, fourth) = len(ends), numbers
    if not n or third % 100 >= fim or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if fourth % 100 < spm:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, a, b - a, output


def fill_in_middle(
    docs: DataFrame, unit: str = CODE_POINT, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, text: str = "text"
) -> DataFrame:
    """The documents with ``n, form, prefix_chars, middle_chars, output``; one pass, no exchange."""
    kept = [c for c in docs.columns if c not in ADDED.names]
    schema = T.StructType([*[docs.schema[c] for c in kept], *ADDED.fields])

    def rows(batches):
        units = regex.compile(f"({unit})*")
        for batch in slices(batches, ROWS):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            new = zip(*[rewrite(t or "", draws(i, seed), units, fim, spm) for t, i in zip(texts, ids)], strict=True)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(v, t) for v, t in zip(new, types)] if texts else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *ADDED.names])

    return docs.mapInArrow(rows, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that a rewritten one came from, from the output and its form."""

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def op13_digests(spark, documents: DataFrame) -> DataFrame:
    """Form, cuts and digests of every document's rewritten and rebuilt text."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(documents.select("doc_id", "text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
