"""Near-repeated lines by an exact set-similarity join, in DataFrame operations only.

A line is its set of words. Lines of equal sets are one class, and its first line in order (document
id, line number) stands for it. Two classes match if the Jaccard similarity of their sets is at least
``PERCENT``. A line is removed if an earlier line has its set or one that matches it.

Join: the words of a line are ordered by rarity, counted over all lines in ``CELLS`` cells of a word
hash (any common order is right; rare ones first makes it fast). Classes that match share a word of their
first ``n - ceil(n * PERCENT / 100) + 1`` words; classes are posted under these words, and meet there
if they pass the length filter, the positional filter (the first word they share has enough words behind it in
both) and a parity filter (each word in which they differ turns one bit of a map, of 64 bits or of 128 for longer
lines). Pairs that pass are verified on the full sets of words, read again from the documents that hold them: of
each class first the pair whose maps differ least, then all other pairs of the classes that this did not settle.

Before that join, the classes of large groups of alike lines (many prefixes with the same sketch) are compared with a few
leaders of their group, and those that match one are settled: they still meet the others as the earlier line, but
not one another, so that a group of near copies does not give pairs by the square of its size.

Texts are cut into words twice, for the rarity and for the lines, which are then written with what the join needs.

Blank lines are no lines to remove. NULL text has no lines to remove; documents that share an id share
their line numbers' order, so ids should be unique; a NULL id comes first. Words are compared as 57-bit
hashes, sets by a 64-bit digest. An empty table gives an empty result. Other columns pass through
``without_removed`` and are ignored elsewhere.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_on, keep, literal_longs

PERCENT = 80
CELLS = 1 << 17
#: Words up to which a line's map has 64 bits.
SHORT = 64
#: Bits of a filter on ids, a constant of fixed size.
ID_BITS = 1 << 20
#: Classes of one sketch up to which they only meet by their words; for larger groups, sketches of a class from either end of
#: its prefix, leaders of a group, and leaders that a class is compared with in full.
FEW = 32
SKETCHES = 3
LEADERS = 8
TRIED = 3


def blanked(text: Column | str) -> Column:
    """Text with every white space but the line feed as a blank: cutting at one plain character is the fastest."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\t\x0B-\r]"), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``, lines blanked."""
    return docs.select("doc_id", F.posexplode(F.split(blanked("text"), "\n")).alias("line_no", "line"))


def words_of(line: Column | str) -> Column:
    return F.array_remove(F.split(line, " "), "")


def rarity(docs: DataFrame) -> Column:
    """A constant array: the order of magnitude of each cell's word count, over all lines."""
    cell = F.xxhash64("word").bitwiseAND(CELLS - 1)
    words = docs.select(F.explode(F.split(F.replace(blanked("text"), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.where("word <> ''").groupBy(cell.alias("cell")).count()
    classes = [0] * CELLS
    for at, n in counts.collect():
        classes[at] = int(n).bit_length()
    return literal_longs(classes)


def keys_of(line: Column, classes: Column) -> Column:
    """The distinct words of a blanked line as numbers that sort by rarity."""

    def number(word: Column) -> Column:
        h = F.xxhash64(word)
        # The default never applies; without NULL the words are sorted as plain numbers.
        rare = F.coalesce(F.get(classes, h.bitwiseAND(CELLS - 1).cast("int")), F.lit(0).cast("bigint"))
        return F.shiftleft(rare, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    return F.sort_array(F.array_distinct(F.array_remove(F.transform(F.split(line, " "), number), number(F.lit("")))))


def parity(keys: Column) -> Column:
    """64 bits, each telling whether an odd number of words fall on it."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k.bitwiseAND(63).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda m, k: m.bitwiseXOR(bit(k)))


def keyed_lines(docs: DataFrame, rare: Column, percent: int) -> DataFrame:
    """``doc_id, line_no, id, n, prefix, b0, b1`` of every line with words; lines of equal sets have one ``id``."""
    keys, n = F.col("keys"), F.size("keys")
    # A filter on the keys would be moved before them and work them out twice.
    keyed = lines_of(docs).where(F.trim("line") != "").select("doc_id", "line_no", keys_of(F.col("line"), rare).alias("keys"))
    long = F.when(n > SHORT, parity(F.filter(keys, lambda k: k.bitwiseAND(64) != 0))).otherwise(F.lit(0).cast("bigint"))
    prefix = F.slice(keys, F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    # Smaller sets match their equals only: at 0.8 those of three words or fewer.
    posted = F.when(n * (100 - percent) >= percent, F.transform(prefix, lambda k: F.hash(k)))
    return keyed.select(
        "doc_id", "line_no", F.xxhash64("keys").alias("id"), n.alias("n"), posted.alias("prefix"), parity(keys).alias("b0"), long.alias("b1")
    ).withColumn("b0", F.col("b0").bitwiseXOR(F.col("b1")))


def classes_of(lines: DataFrame) -> DataFrame:
    """``id, first, n, prefix, b0, b1, copies`` of every class of lines."""
    m = F.min(F.struct("doc_id", "line_no", "n", "prefix", "b0", "b1"))
    return lines.groupBy("id").agg(m.alias("m"), F.count(F.lit(1)).alias("copies")).select(
        "id", F.struct("m.doc_id", "m.line_no").alias("first"), "m.n", "m.prefix", "m.b0", "m.b1", "copies"
    )


def sketches(classes: DataFrame, ends: int) -> DataFrame:
    """Every posted class under sketches of its prefix: neighbours in the order of their hashes, ``ends`` from either end."""
    up = [F.get("up", F.lit(i)) for i in range(ends + 1)]
    down = [F.get("up", F.size("up") - 1 - i) for i in range(ends + 1)]
    pairs = [F.hash(up[i], up[i + 1]) for i in range(ends)] + [F.hash(down[i + 1], down[i]) for i in range(ends)]
    # Sorted in a step of its own, as an explode works out each mention anew.
    posted = classes.where("prefix IS NOT NULL").select("id", "first", "n", "b0", "b1", F.sort_array("prefix").alias("up"))
    return posted.select("id", "first", "n", "b0", "b1", F.explode(F.array(*pairs)).alias("sketch"))


def leader_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: for the classes ``b`` of large groups of alike lines up to ``TRIED`` earlier leaders that pass the filters.

    A group has a sketch in common; its leaders are the first classes of ``LEADERS`` parts of it. So pairs grow with the classes,
    not with their square.
    """
    large = keep(sketches(classes, 1).groupBy("sketch").count().where(F.col("count") > FEW).select("sketch"))
    members = keep(sketches(classes, SKETCHES).where(bit_filter(large, "sketch")).join(large, "sketch", "left_semi"))
    part = F.pmod(F.xxhash64("id"), F.lit(LEADERS))
    m = F.min(F.struct("first", "id", "n", "b0", "b1"))
    leaders = members.groupBy("sketch", part.alias("part")).agg(m.alias("m")).select(
        "sketch", F.col("m.first").alias("first_a"), *[F.col(f"m.{c}").alias(f"{c}_a") for c in ("id", "n", "b0", "b1")]
    )
    own = members.select("sketch", *[F.col(c).alias(f"{c}_b") for c in ("id", "first", "n", "b0", "b1")])
    fit = own.join(leaders, "sketch").where((F.col("first_a") < F.col("first_b")) & sizes_fit(percent) & close(percent))
    best = F.slice(F.sort_array(F.collect_set(F.struct(apart().alias("apart"), F.col("id_a").alias("a")))), 1, TRIED)
    return fit.groupBy(F.col("id_b").alias("b")).agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")


def needed(percent: int) -> str:
    """The words that sets of ``n_a`` and ``n_b`` words share at least if they match."""
    return f"(({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})"


def apart() -> Column:
    """The differing bits of two maps."""
    return F.expr(
        f"""if(n_a > {SHORT} AND n_b > {SHORT}, bit_count(b0_a ^ b0_b) + bit_count(b1_a ^ b1_b), bit_count(b0_a ^ b1_a ^ b0_b ^ b1_b))"""
    ).cast("int")


def sizes_fit(percent: int) -> Column:
    return F.expr(f"least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent}")


def close(percent: int) -> Column:
    return apart() <= F.expr(f"n_a + n_b - 2 * {needed(percent)}")


def candidate_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, apart``: pairs of classes that pass the filters, each once, in either order, with the differing bits of their maps.

    Pairs of classes that are both ``settled`` are left out. Of two sets that match, the first word they share is in the smaller
    one among the first words, those that suffice for sets of its own size; only larger ones must look further.
    """
    own = F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    cols = ("id", "n", "pos", "b0", "b1", "settled")
    head = classes.select("id", "n", "b0", "b1", "settled", F.posexplode(F.slice("prefix", F.lit(1), own)).alias("pos", "key"))
    rest = classes.where(F.size("prefix") > own).select(
        "id", "n", "b0", "b1", "settled", own.alias("own"), F.posexplode(F.slice("prefix", own + 1, F.size("prefix") - own)).alias("at", "key")
    ).withColumn("pos", F.col("own") + F.col("at"))
    side = lambda posts, x: posts.select("key", *[F.col(c).alias(f"{c}_{x}") for c in cols])
    fits = sizes_fit(percent) & F.expr(f"least(n_a - pos_a, n_b - pos_b) >= {needed(percent)} AND NOT (settled_a AND settled_b)") & close(percent)
    pairs = lambda posts, smaller: side(head, "a").join(side(posts, "b"), "key").where(F.expr(smaller) & fits).select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), apart().alias("apart")
    )
    return pairs(head, "n_a < n_b OR (n_a = n_b AND id_a < id_b)").union(pairs(rest, "n_a < n_b")).distinct()


def in_order(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs with the earlier class first, if the later one is not settled."""
    first = lambda x: ends.select(F.col("id").alias(x), F.col("first").alias(f"first_{x}"), F.col("settled").alias(f"settled_{x}"))
    placed = pairs.join(first("a"), "a").join(first("b"), "b")
    turned = F.when((F.col("first_a") < F.col("first_b")) & ~F.col("settled_b"), F.struct("a", "b")).when(
        (F.col("first_b") < F.col("first_a")) & ~F.col("settled_a"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    return placed.select(turned.alias("p"), "apart").where("p IS NOT NULL").select("p.*", "apart")


def ends_of(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes of the pairs, without what only the join needs."""
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return keep(classes.where(bit_filter(ids, "id")).drop("n", "prefix", "b0", "b1", "copies").join(ids, "id", "left_semi"))


def bit_filter(ids: DataFrame, name: str) -> Column:
    """Whether a value of column ``name`` can be among those of ``ids``: a bit array of fixed size, as a constant."""
    bit = F.xxhash64(name).bitwiseAND(ID_BITS - 1)
    words = ids.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 32 AS int)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 31 AS int)))").alias("mask")
    )
    masks = [0] * (ID_BITS // 32)
    for word, mask in words.collect():
        masks[word] = mask
    held = F.get(literal_longs(masks), F.shiftright(bit, 5).cast("int"))
    return F.call_function("shiftright", held, bit.bitwiseAND(31).cast("int")).bitwiseAND(1) == 1


def sets_of(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``id, words`` of every class of ``ends``, read again from the documents that hold them."""
    wanted = ends.select("id", "first.*").groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "id")).alias("wanted"))
    texts = docs.select("doc_id", F.split(blanked("text"), "\n").alias("lines")).where(bit_filter(ends.select("first.doc_id"), "doc_id"))
    found = join_on(texts, wanted, ["doc_id"]).select("lines", F.explode("wanted").alias("w")).select(
        "w.id", F.array_distinct(words_of(F.get("lines", F.col("w.line_no")))).alias("words")
    )
    return keep(found.dropDuplicates(["id"]))


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that match on their full sets."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("words").alias(f"w_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("w_a", "w_b"))
    return both.where(shared * 100 >= (F.size("w_a") + F.size("w_b") - shared) * percent).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ids ``b`` of the pairs that match on their full sets."""
    return alike(pairs, sets, percent).select(F.col("b").alias("id")).distinct()


def settled_by_leaders(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ids of the classes that match an earlier leader of their group."""
    pairs = keep(leader_pairs(classes, percent))
    return keep(alike(pairs, sets_of(docs, ends_of(pairs, classes)), percent).select(F.col("b").alias("id")).distinct())


def matches(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ids of the classes that match an earlier one."""
    settled = settled_by_leaders(docs, classes, percent)
    some, no = bit_filter(settled, "id"), F.lit(False)
    marked = classes.where(some).join(settled.withColumn("settled", F.lit(True)), "id", "left").withColumn("settled", F.coalesce("settled", no))
    classes = classes.where(~some).withColumn("settled", no).unionByName(keep(marked))
    pairs = keep(candidate_pairs(classes, percent))
    ends = ends_of(pairs, classes)
    pairs = keep(in_order(pairs, ends))
    sets = sets_of(docs, ends)
    # Lines of many near copies have many matches, of which one is enough.
    best = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select("m.a", "b")
    first = keep(verified(best, sets, percent))
    open_ = pairs.join(first.withColumnRenamed("id", "b"), "b", "left_anti")
    return settled.union(first).union(keep(verified(open_, sets, percent)))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, line_no`` of every removed line."""
    lines = keep(keyed_lines(docs, rarity(docs), percent))
    classes = keep(classes_of(lines))
    matched = matches(docs, classes, percent)
    told = classes.select("id", "first", "copies").join(matched.withColumn("matched", F.lit(True)), "id", "left")
    some = told.where("matched OR copies > 1").select("id", "first", F.coalesce("matched", F.lit(False)).alias("matched"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    return lines.select("doc_id", "line_no", "id").join(some, "id").where(F.col("matched") | ~is_first).select("doc_id", "line_no")


def without_removed(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts."""
    gone = removed.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    return join_on(docs, gone, ["doc_id"], "left").withColumn("text", F.array_join(kept, "\n")).drop("_gone")


def op8_removed(spark, documents: DataFrame) -> DataFrame:
    """One row per document with its removed line numbers."""
    gone = removed_lines(documents).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    text = F.coalesce("text", F.lit(""))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1
    return join_on(documents.select("doc_id", lines.alias("n_lines")), gone, ["doc_id"], "left").select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("removed", lambda i: i.cast("string")), ","), F.lit("")).alias("removed_lines"),
    )
