"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text of at most ``LONG`` characters is encoded in its row. A longer one is cut into halves, again
and again, down to pieces of at most ``PIECE`` characters, wherever the cuts fall; pieces are rows of
their own and are encoded in parallel by many tasks. Then neighbours are joined up the tree. Only
what lies around a join is encoded again:

* A blank after a character that is no white space begins a new word whatever stands around it, so a
  window between two such places agrees with both sides at once.
* Without one near, the region up to the next such place is cut into words as the tokenizer does.
  Words that both sides cut alike are kept as they are encoded.
* A long word across the join is encoded again over a window of ``WINDOW`` tokens on each side,
  which doubles until its first token is the left side's and its last token the right side's. Each
  pair of neighbouring tokens is then one that the merges give, which fixes the whole sequence: the
  result is the encoding of the word, not an approximation.

Encoded words are remembered in a task (at most ``MEMO`` of them); that saves work and changes
nothing. Ids are kept as BINARY, little-endian unsigned 32-bit, four bytes a token.

The tokenizer is a file of the ``tokenizers`` library of the byte-level kind (no normaliser, no added
prefix blank, added tokens without flags); others are refused. It is read once on the driver and
travels with the tasks (some MB), so executors need no copy.

Defined cases: a NULL or empty text has no tokens; repeated rows give equal rows; the string of a
special token in a text is that token, as the library has it; an empty table gives an empty table;
columns with the name of a new column are replaced, all others pass through. A long text's pieces come
together in one task again, as the text itself was one value.
"""

import json
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep
from .shingles import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG, PIECE = 16_384, 8_192
WINDOW = 16
MEMO, MEMO_CHARS = 200_000, 64
ROWS = 200
#: A blank after a character that is no white space: always the start of a word.
SAFE = re.compile(r"(?<=\S)(?= )")
#: A blank that does not begin a word by itself.
WIDE = re.compile(r"\s ")
#: The same as SAFE, and a line break there; what follows a single line break; a mark after an ASCII letter. No word of
#: the tokenizer runs across such a place, and none there depends on what lies beyond it.
WORDS = re.compile(r"(?<=\S)(?=[ \n])|(?<=\S\n)(?=\S)|(?<=[A-Za-z])(?=[.,;:!?*&$#%()])")


def halves(n: int, most: int) -> list[tuple[int, int]]:
    """Places of the leaves of the tree over ``n`` characters."""
    if n <= most:
        return [(0, n)]
    middle = n // 2
    return halves(middle, most) + [(a + middle, b + middle) for a, b in halves(n - middle, most)]


class Bpe:
    """A tokenizer in a task."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.words = self.tokenizer.model, self.tokenizer.pre_tokenizer
        # The library writes each byte as a printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        self.char_of = {b: c for c, b in self.byte_of.items()}
        self.blank = self.char_of[32]
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(self.byte_of[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.memo: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    # --- texts ---

    def encode(self, text: str) -> bytes:
        """The ids of a text, as the library encodes it."""
        return b"".join(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a word that several have is encoded once."""
        if len(self.memo) > MEMO:
            self.memo = {}
        if len(self.after_blank) > MEMO:
            self.after_blank = {}
        memo, after = self.memo, self.after_blank
        # Texts fall apart at blanks, of which each begins a word unless white space stands before it. A blank
        # and ASCII letters are one word, whose letters the library writes as they are.
        heads, tails = [], []
        for t in texts:
            if WIDE.search(t):
                heads.append(SAFE.split(t))
                tails.append([])
            else:
                first, *rest = t.split(" ")
                heads.append([first] if first else [])
                tails.append(rest)
        unknown = set().union(*tails).difference(after)
        plain = [w for w in unknown if w.isascii() and w.isalpha()]
        after.update((w, self.merged(self.blank + w)) for w in plain)
        cut = {w: WORDS.split(" " + w) for w in unknown.difference(plain)}
        whole = {h: WORDS.split(h) for h in set().union(*heads)}
        new = list(set().union(*cut.values(), *whole.values()).difference(memo))
        self.learn(new)
        ids = memo.__getitem__
        after.update((w, b"".join(map(ids, words))) for w, words in cut.items())
        first = {h: b"".join(map(ids, words)) for h, words in whole.items()}
        out = [b"".join([*map(first.__getitem__, h), *map(after.__getitem__, t)]) for h, t in zip(heads, tails)]
        for known, added in ((memo, new), (after, unknown)):
            for w in [w for w in added if len(w) > MEMO_CHARS]:
                del known[w]
        return out

    def merged(self, word: str) -> bytes:
        """Ids of one word of the tokenizer, written as the library writes its bytes."""
        return b"".join([self.packed[t.id] for t in self.model.tokenize(word)])

    def learn(self, words: list[str]) -> None:
        """Put the ids of new words into the memo."""
        packed = self.packed.__getitem__
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.memo.update((w, b"".join(map(packed, e.ids))) for w, e in zip(words, found))

    def decode(self, ids: bytes) -> str:
        at = self.bytes_of
        return b"".join([at[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")

    # --- joins ---

    def tokens_within(self, ids: np.ndarray, n_bytes: int, from_end: bool) -> int:
        """How many tokens at an end of ``ids`` make up ``n_bytes``."""
        if not n_bytes:
            return 0
        step = 64
        while True:
            part = ids[-step:][::-1] if from_end else ids[:step]
            total = np.cumsum(self.sizes[part])
            if total[-1] >= n_bytes or step >= len(ids):
                at = int(np.searchsorted(total, n_bytes))
                assert total[at] == n_bytes, "not a place between tokens"
                return at + 1
            step *= 2

    def word_ids(self, data: bytes) -> np.ndarray:
        """Merges over bytes that stand in one word."""
        return np.array([t.id for t in self.model.tokenize("".join(map(self.char_of.__getitem__, data)))], np.uint32)

    def join_word(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of one word from those of its two parts, by windows that grow until both sides agree."""
        w = WINDOW
        while True:
            a, b = max(len(left) - w, 0), min(w, len(right))
            inside = np.concatenate([left[a:], right[:b]])
            again = self.word_ids(b"".join(self.bytes_of[i] for i in inside.tolist()))
            agrees_left = a == 0 or again[0] == inside[0]
            agrees_right = b == len(right) or again[-1] == inside[-1]
            if agrees_left and agrees_right:
                return np.concatenate([left[:a], again, right[b:]])
            w *= 2

    def cut(self, text: str) -> list[int]:
        """Places in a text where its words begin, and its end."""
        return [a for _, (a, _) in self.words.pre_tokenize_str(text)] + [len(text)]

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """Text and ids of two neighbouring parts of a text, each with its own encoding."""
        (lt, li), (rt, ri) = left, right
        if not lt or not rt:
            return (lt + rt, np.concatenate([li, ri]))
        before = lt.rfind(" ")
        while before > 0 and lt[before - 1].isspace():
            before = lt.rfind(" ", 0, before)
        before = max(before, 0)
        after = SAFE.search(rt)
        after = after.start() if after else len(rt)
        lw, rw = lt[before:], rt[:after]
        l_at = len(li) - self.tokens_within(li, len(lw.encode()), True)
        r_at = self.tokens_within(ri, len(rw.encode()), False)
        middle = self.join_region(lw, li[l_at:], rw, ri[:r_at])
        return lt + rt, np.concatenate([li[:l_at], middle, ri[r_at:]])

    def join_region(self, lw: str, li: np.ndarray, rw: str, ri: np.ndarray) -> np.ndarray:
        whole = lw + rw
        if len(whole) <= MEMO_CHARS:
            return np.frombuffer(self.encode(whole), "<u4")
        left, right, both = self.cut(lw), [len(lw) + p for p in self.cut(rw)], self.cut(whole)
        same = 0
        while same < min(len(left), len(both)) - 1 and left[same + 1] == both[same + 1] and both[same + 1] <= len(lw):
            same += 1
        a, ends = both[same], set(right)
        b = next(p for p in both[same:] if p in ends and p >= len(lw))
        # From b on the words are the right side's: what a word is depends on what follows its start.
        l_at = self.tokens_within(li, len(lw[:a].encode()), False)
        r_at = self.tokens_within(ri, len(whole[len(lw) : b].encode()), False)
        inner = [p for p in both if a <= p <= b]
        one_word = inner == [a, b] and [p for p in left if p >= a] == [a, len(lw)] and [p for p in right if p <= b] == [len(lw), b]
        if one_word:
            middle = self.join_word(li[l_at:], ri[:r_at])
        else:
            parts = [self.word_ids(whole[s:e].encode()) for s, e in zip(inner, inner[1:])]
            middle = np.concatenate([*parts, np.empty(0, np.uint32)])
        return np.concatenate([li[:l_at], middle, ri[r_at:]]).astype(np.uint32)

    def join_all(self, parts: list[tuple[str, np.ndarray]], n: int | None = None, most: int = PIECE) -> np.ndarray:
        """Up the tree that :func:`halves` cut: ``parts`` are its leaves in order."""
        leaves = iter(parts)

        def node(size: int) -> tuple[str, np.ndarray]:
            if size <= most:
                return next(leaves)
            return self.join(node(size // 2), node(size - size // 2))

        return node(sum(len(t) for t, _ in parts) if n is None else n)[1]

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """A text between its special tokens: (text, None) or ('', id)."""
        if self.special is None:
            return [(text, None)]
        pieces = self.special.split(text)
        return [("", self.added[p]) if i % 2 else (p, None) for i, p in enumerate(pieces) if i % 2 or p]


class Loader:
    """The tokenizer of a task, made once in it; the text of its file travels (some MB, whatever the data)."""

    def __init__(self, df: DataFrame, spec: str):
        self.spec, self.bpe = df.sparkSession.sparkContext.broadcast(checked(spec)), None

    def __call__(self) -> Bpe:
        self.bpe = self.bpe or Bpe(self.spec.value)
        return self.bpe


def checked(spec: str) -> str:
    """The tokenizer file's text, if it is of the kind for which the joins are exact."""
    d = json.loads(spec)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    fits = (
        d.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and model["type"] == "BPE"
        and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and not model.get("ignore_merges")
        and not any(t[k] for t in d.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
        and not any(" " in t["content"] for t in d.get("added_tokens", []))
    )
    if not fits:
        raise ValueError("not a byte-level BPE tokenizer without normaliser and flags")
    return spec


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return checked(f.read())


def _replaced(df: DataFrame, types: dict[str, T.DataType]) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c not in types]
    return kept, T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in types.items()]])


def _with_columns(batch, kept: list[str], new: dict[str, pa.Array]):
    columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
    return pa.RecordBatch.from_arrays([*columns, *new.values()], names=[*kept, *new])


def encode(
    docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None, long: int = LONG, piece: int = PIECE
) -> DataFrame:
    """The rows with column ``ids`` (BINARY) in addition; ``tokenizer`` is the text of its file.

    ``decoded`` names a further column: the text that the ids decode to, read back in the same task. Rows of
    long texts get a number first and are a written table, so that a task that is run again finds the same rows.
    """
    load = Loader(docs, tokenizer)
    kept, schema = _replaced(docs, {ids: T.BinaryType()} | ({decoded: T.StringType()} if decoded else {}))

    def results(bpe: Bpe, values: list[bytes]) -> dict[str, pa.Array]:
        back = {decoded: pa.array([bpe.decode(v) for v in values], pa.string())} if decoded else {}
        return {ids: pa.array(values, pa.binary())} | back

    def rows(batches):
        for batch in slices(batches, ROWS):
            bpe = load()
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield _with_columns(batch, kept, results(bpe, bpe.encode_all([t or "" for t in texts])))

    length = F.coalesce(F.length(text), F.lit(0))
    short = docs.where(length <= long).mapInArrow(rows, schema)

    number = "_row"
    while number in docs.columns:
        number += "_"
    numbered = keep(docs.where(length > long).withColumn(number, F.monotonically_increasing_id()))

    def cut(batches):
        for batch in slices(batches, 1):
            bpe = load()
            row, whole = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            out = []
            for s, (part, token) in enumerate(bpe.segments(whole)):
                places = halves(len(part), piece) if token is None else [(0, 0)]
                out += [(row, s, n, part[a:b], token) for n, (a, b) in enumerate(places)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types)], names=["_row", "segment", "piece", "text", "token"]
            )

    pieces = numbered.select(F.col(number).alias("_row"), F.col(text).alias("text")).mapInArrow(
        cut, "_row bigint, segment int, piece int, text string, token bigint"
    )
    spread = pieces.repartition("_row", "segment", "piece")

    def encoded(batches):
        for batch in slices(batches, ROWS):
            bpe = load()
            texts, tokens = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ids_of = bpe.encode_all(texts)
            values = [i if t is None else np.array([t], "<u4").tobytes() for i, t in zip(ids_of, tokens)]
            yield _with_columns(batch, batch.schema.names, {"part": pa.array(values, pa.binary())})

    parts = spread.mapInArrow(encoded, "_row bigint, segment int, piece int, text string, token bigint, part binary")

    def joined(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bpe = load()
        rows = sorted(group.to_pylist(), key=lambda r: (r["segment"], r["piece"]))
        segments: dict[int, list] = {}
        for r in rows:
            segments.setdefault(r["segment"], []).append((r["text"], np.frombuffer(r["part"], "<u4")))
        whole = np.concatenate([bpe.join_all(s, most=piece) for s in segments.values()])
        return pa.table({number: pa.array([key[0].as_py()], pa.int64())} | results(bpe, [whole.astype("<u4").tobytes()]))

    new = [ids, decoded] if decoded else [ids]
    found = parts.groupBy("_row").applyInArrow(joined, T.StructType([T.StructField(number, T.LongType()), *[schema[c] for c in new]]))
    back = numbered.select(number, *kept)
    return short.unionByName(back.join(found, number).select(*kept, *new))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with column ``text`` in addition: the text of ``ids``, special tokens included."""
    load = Loader(df, tokenizer)
    kept, schema = _replaced(df, {text: T.StringType()})

    def rows(batches):
        for batch in slices(batches, ROWS):
            bpe = load()
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield _with_columns(batch, kept, {text: pa.array([bpe.decode(i or b"") for i in values], pa.string())})

    return df.mapInArrow(rows, schema)


def op12_digests(spark, documents: DataFrame, tokenizer: str) -> DataFrame:
    """Number of tokens, digest of the ids and of the decoded text of every document."""
    encoded = encode(documents.select("doc_id", "text"), tokenizer, decoded="decoded")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return encoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), digest("ids").alias("ids_sha256"),
        digest("decoded").alias("decoded_sha256"),
    )
