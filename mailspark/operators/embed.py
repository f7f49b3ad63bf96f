"""Text to vectors: a native encoder over rows, and any model over texts."""

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import Merged
from .rows import as_text, full_text_rows, word_rows
from .skew import join_left_hot

ENCODER_BATCH = 32
WIDTH = 64
WORD = r"[\p{L}\p{N}_]+"
# The same in lower-cased ASCII text, where it is faster.
ASCII_WORD = "[a-z0-9_]+"
# Entries are rounded, so that equal texts have equal vectors in whatever order sums were taken.
DIGITS = 6


class Terms:
    """What the native encoder knows of a corpus: words of each mail, document frequencies, their number.

    The three are tables of an index. Vectors come from them alone, so that neither questions nor a
    renewed set of vectors read a mail's text.
    """

    NAMES = ("counts", "frequency", "total")

    def __init__(self, counts: DataFrame, frequency: DataFrame, total: DataFrame):
        self.counts, self.frequency, self.total = counts, frequency, total

    def map(self, use) -> "Terms":
        """``use(name, table)`` for each table, such as storing it, the counts first."""
        counts = use("counts", self.counts)
        return Terms(counts, use("frequency", frequency_of(counts)), use("total", self.total))


def words_of(text: Column) -> Column:
    low = F.lower(text)
    words = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    return F.when(F.octet_length(text) == F.char_length(text), words(ASCII_WORD)).otherwise(words(WORD))


def word_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, word, n) of rows with ``text``, whose words count ``times`` where there is such a column."""
    times = F.col("times") if "times" in rows.columns else F.lit(1).cast("bigint")
    words = rows.select(*keys, times.alias("_times"), F.explode(words_of(F.col("text"))).alias("word"))
    return words.groupBy(*keys, "word").agg(F.sum("_times").alias("n"))


def frequency_of(counts: DataFrame) -> DataFrame:
    """(word, df): in how many mails a word is."""
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def terms_of(mail_rows: DataFrame, heads: DataFrame | None = None) -> Terms:
    """Term statistics of rendered mails; ``heads`` has the same mails in narrow rows."""
    counts = word_counts(mail_rows, ["mbox", "seq"])
    mails = mail_rows if heads is None else heads
    return Terms(counts, frequency_of(counts), mails.agg(F.count_distinct("mbox", "seq").alias("total")))


def idf_of(df: Column, terms: Terms) -> Column:
    """A word's inverse document frequency."""
    return F.log((terms.total.scalar() + 1.0) / (F.coalesce(df, F.lit(0)) + 1.0)) + 1.0


def weighed_words(counts: DataFrame, terms: Terms) -> DataFrame:
    """The counts with ``w``: a word's count by inverse document frequency."""
    known = join_left_hot(counts, terms.frequency, "word", ["df"], "df")
    return known.withColumn("w", F.col("n") * idf_of(F.col("df"), terms)).drop("df")


def with_places(words: DataFrame) -> DataFrame:
    """Add ``place`` and ``sign``, to which a word is hashed."""
    digest = F.col("_digest")
    code = lambda at: F.ascii(F.substring(digest, at, 1))
    digit = lambda at: code(at) - F.when(code(at) < 97, 48).otherwise(87)
    # The first four hex digits modulo WIDTH: the last six bits of them. The fifth digit gives the sign.
    return words.withColumn("_digest", F.md5(F.col("word"))).withColumns({
        "place": digit(3) % 4 * 16 + digit(4), "sign": F.when(digit(5) % 2 == 0, 1.0).otherwise(-1.0),
    }).drop("_digest")


def unit_vectors(weighed: DataFrame, keys: list[str]) -> DataFrame:
    """Words hashed to places with a sign, scaled to unit length."""
    return vectors_of(with_places(weighed).select(*keys, "place", (F.col("w") * F.col("sign")).alias("w")), keys)


def vectors_of(signed: DataFrame, keys: list[str]) -> DataFrame:
    """Signed weights at places added up and scaled to unit length."""
    places = signed.groupBy(*keys, "place").agg(F.sum("w").alias("w"))
    gathered = places.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("at"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    entry = lambda i: (F.round(F.coalesce(F.try_element_at("at", i), F.lit(0.0)) / F.col("norm"), DIGITS) + F.lit(0.0)).cast("float")
    return gathered.where("norm > 0").select(*keys, F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), entry).alias("embedding"))


class HashedEncoder:
    """Deterministic native encoder from term statistics; nothing reaches the driver.

    Made from stored :class:`Terms`, or from the rows of rendered mails.
    """

    def __init__(self, source: Terms | DataFrame):
        self.terms = source if isinstance(source, Terms) else terms_of(source)

    def mails(self) -> DataFrame:
        """(mbox, seq, embedding) of the mails it was made from.

        Every word of them has a frequency, so its place and weight are worked out once, not once a mail.
        """
        words = with_places(self.terms.frequency).withColumn("signed", idf_of(F.col("df"), self.terms) * F.col("sign"))
        known = join_left_hot(self.terms.counts, words, "word", ["place", "signed"], "df")
        return vectors_of(known.select("mbox", "seq", "place", (F.col("n") * F.col("signed")).alias("w")), ["mbox", "seq"])

    def questions(self, questions: DataFrame) -> DataFrame:
        """(query_id, embedding); a question without words has none."""
        return unit_vectors(weighed_words(word_counts(questions, ["query_id"]), self.terms), ["query_id"])


class BatchEncoder:
    """Any model as an encoder of texts: ``make_predict`` runs once per worker and returns a function
    from an array of texts to a matrix."""

    def __init__(self, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = ENCODER_BATCH):
        self.encode = predict_batch_udf(
            make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )

    def __call__(self, texts: DataFrame) -> DataFrame:
        """Replace column ``text`` by ``embedding ARRAY<FLOAT>``, keeping the other columns."""
        return texts.withColumn("embedding", self.encode("text")).drop("text")


def embed_mails(merged: Merged, encoder: BatchEncoder | None = None) -> DataFrame:
    """``vectors(mbox, seq, embedding)`` of the mails' full text."""
    if encoder is None:
        return HashedEncoder(terms_of(word_rows(merged), merged.heads)).mails()
    return encoder(as_text(full_text_rows(merged), ["mbox", "seq"]))
