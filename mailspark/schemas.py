"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())
_bigints = T.ArrayType(T.LongType())

COMMIT = T.StructType([
    T.StructField("sha", T.StringType()),
    T.StructField("short", T.StringType()),
    T.StructField("message", T.StringType()),
])
SECTION = T.StructType([
    T.StructField("heading", T.StringType()),
    T.StructField("lines", _strings),
])
MARKDOWN = T.StructType([
    T.StructField("code_blocks", _strings),
    T.StructField("headings", T.ArrayType(SECTION)),
    T.StructField("lists", _strings),
])

RAW_MAILS = T.StructType([
    T.StructField("mbox", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("raw", T.StringType()),
])

_MAIL_FIELDS = [
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("pr_numbers", _bigints),
    T.StructField("pr_title", T.StringType()),
    T.StructField("repos", _strings),
    T.StructField("tickets", _strings),
    T.StructField("body", T.StringType()),
    T.StructField("markdown", MARKDOWN),
    T.StructField("commits", T.ArrayType(COMMIT)),
    T.StructField("files_modified", _strings),
    T.StructField("file_paths", _strings),
    T.StructField("tags", _strings),
    T.StructField("linked_prs", _bigints),
    T.StructField("linked_tickets", _strings),
    T.StructField("contributors", _strings),
]

MAILS = T.StructType([
    T.StructField("mbox", T.StringType()),
    T.StructField("seq", T.LongType()),
    *_MAIL_FIELDS,
    # Which Markdown keys are filled: the merge asks for these, and must not read the lists for it.
    *[T.StructField(f"has_{key}", T.BooleanType()) for key in MARKDOWN.names],
])

VECTORS = T.StructType([
    T.StructField("mbox", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

QUESTIONS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("text", T.StringType()),
])
