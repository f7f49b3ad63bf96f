"""Near-duplicate documents by an inverted join over signature coordinates.

1. A document is its set of word shingles. Documents with equal sets are one class, found by a digest
   of the set; from here on only classes count, so copies cost nothing.
2. A class has a MinHash signature of ``COORDINATES`` values. It is posted under each (coordinate,
   value) pair. Pairs that one class has alone can't collide and are skipped.
3. Two classes above the similarity collide in at least ``MATCHES`` of the coordinates (at 64 and 0.8
   all but one in 10^5 do). So they share one of the first ``64 - MATCHES + 1`` pairs of each, in any
   common order; the rarest pairs come first, so that passages in many documents hardly count.
4. Star round: the members of a prefix pair meet the leader of a random cell of their pair's members,
   and cell leaders a common one: as many candidates as postings. Collisions are counted over the
   whole signatures, and links confirmed on the full sets. Connected classes are one from here on.
5. Completion: where a prefix pair still has members of several components, all its pairs of different
   components are tried: few members by a join; of many, those outside the largest component meet all
   others in blocks, each pair under its first common prefix pair only, and connected ones are skipped;
   where too many are outside it, by the exact prefix filter over the shingles, rarest first. So no
   two classes that collide often enough are left untried, unless already connected.

Links are confirmed by 100 * intersection >= percent * union, on full sets. A document without words
has an empty set and no links; NULL text is empty. Documents are told apart by row, so NULL and
repeated ids are no harm: a component's id is its smallest id, NULL if it has none. Other columns are
ignored. An empty table gives an empty result. Tables on the way are written to the shared folder.
"""

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import join_on, keep
from .shingles import coordinate, groups, shingle_hashes, shingle_sets, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COORDINATES, MATCHES = 64, 36
#: In the star round a pair is tried only if it looks alike: the completion tries the others.
STAR_MATCHES = 46
CELL = 64
#: Members of a prefix pair that are joined with each other, and blocks in which others meet.
FEW, OUTSIDE_BLOCK, BLOCK = 64, 512, 1024
#: Members outside the largest component that meet all others in blocks.
MOST_OUTSIDE = 4096


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``row, doc_id, text_hash, n_shingles, s1, s2, signature`` of every document."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in groups([len(t) for t in texts]):
                shingles, starts = shingle_hashes(texts[a:b], words)
                full = np.flatnonzero(np.diff(starts))
                minima = np.zeros((b - a, COORDINATES), np.int32)
                if len(full):
                    for k in range(COORDINATES):
                        minima[full, k] = np.minimum.reduceat(coordinate(shingles, k), starts[full]).view(np.int32)
                sizes, digests = [], []
                for i, j in zip(starts, starts[1:]):
                    s = np.unique(shingles[i:j])
                    sizes.append(len(s))
                    digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                digests = np.array(digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + b - a)), pa.array(ids[a:b], pa.int64()), pa.array(hashes[a:b], pa.int64()),
                        pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * COORDINATES), pa.array(minima.ravel())),
                    ],
                    names=["row", "doc_id", "text_hash", "n_shingles", "s1", "s2", "signature"],
                )
                row += b - a

    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).mapInArrow(
        run, "row bigint, doc_id bigint, text_hash bigint, n_shingles bigint, s1 bigint, s2 bigint, signature array<int>"
    )


def prefix_postings(classes: DataFrame) -> DataFrame:
    """``key, node, cells, earlier``: each class under its rarest shared coordinate-value pairs.

    ``cells`` is how many cells a pair needs; ``earlier`` has a bit for each coordinate whose pair comes
    before this one in the class's prefix.
    """
    posts = classes.select("node", F.posexplode("signature")).select("node", "pos", F.xxhash64("pos", "col").alias("key"))
    shared = posts.groupBy("key").count().where("count > 1")
    ordered = (
        posts.join(shared, "key")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("count", "key", "pos"))).alias("pairs"))
        .where(F.size("pairs") >= MATCHES)
        .select("node", F.slice("pairs", F.lit(1), F.size("pairs") - (MATCHES - 1)).alias("pairs"))
    )
    bits = F.expr("aggregate(slice(pairs, 1, i), 0L, (mask, p) -> mask | shiftleft(1L, p.pos))")
    return ordered.select("node", "pairs", F.posexplode("pairs").alias("i", "p")).select(
        F.col("p.key").alias("key"), "node", F.ceil(F.col("p.count") / CELL).alias("cells"), bits.alias("earlier")
    )


def pair(a, b):
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def star_pairs(posts: DataFrame) -> DataFrame:
    """Members with their cell's leader, cell leaders with their key's: at most one pair per posting."""
    placed = posts.select("key", "node", F.pmod(F.xxhash64("node", "key"), F.col("cells")).alias("cell"))
    lead = placed.groupBy("key", "cell").agg(F.min_by("node", F.xxhash64("key", "node")).alias("lead"))
    inside = placed.join(lead, ["key", "cell"]).where("node <> lead").select(pair(F.col("node"), F.col("lead")).alias("p"))
    top = lead.groupBy("key").agg(F.min_by("lead", F.xxhash64("key", "lead")).alias("top"))
    across = lead.join(top, "key").where("lead <> top").select(pair(F.col("lead"), F.col("top")).alias("p"))
    return inside.union(across).select("p.a", "p.b").distinct()


def colliding(pairs: DataFrame, known: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs of fitting sizes whose signatures collide in at least ``matches`` coordinates."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    count = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where(fits & (count >= matches)).select("a", "b")


@F.pandas_udf(T.LongType())
def shared_count(a: pd.Series, b: pd.Series) -> pd.Series:
    sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b))
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], dtype="int64")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links: pairs that are similar on their full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = (F.octet_length("s_a") + F.octet_length("s_b")) / 8
    shared = shared_count("s_a", "s_b")
    return both.select("a", "b", sizes.alias("sizes"), shared.alias("shared")).where(
        F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent
    ).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: every linked node with a label that its whole component shares.

    Rounds of contraction: each node moves to the neighbour (or itself) with the least hash, in an
    order that is new in each round; links are redrawn between what is left. Each round leaves a
    fraction of the nodes, whatever the shape of a component; hubs are met by partial aggregation.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges, moved, n = keep(both(links)), None, 0
    while not edges.isEmpty():
        order = lambda c, n=n: F.xxhash64(F.lit(n), c)
        move = edges.groupBy("a").agg(F.min_by("b", order("b")).alias("near")).select(
            F.col("a").alias("node"), F.when(order("near") < order("a"), F.col("near")).otherwise(F.col("a")).alias("label")
        )
        move = keep(move)
        if moved is None:
            moved = move
        else:
            step = move.select(F.col("node").alias("label"), F.col("label").alias("further"))
            moved = keep(moved.join(step, "label", "left").select("node", F.coalesce("further", "label").alias("label")))
        end = lambda x, move=move: move.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}"))
        edges = edges.join(end("a"), "a").join(end("b"), "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges, n = keep(edges.distinct()), n + 1
    return moved if moved is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))


def shingle_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components by the exact prefix filter over shingles: sets that are similar
    enough share one of their first ``n - ceil(n * percent / 100) + 1`` shingles, rarest first."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            spread = lambda i: pa.array(np.repeat(np.array(batch.column(i).to_pylist(), np.int64), sizes))  # noqa: B023, E731
            shingles = pa.array(np.concatenate([*lists, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([spread(0), spread(1), pa.array(np.repeat(sizes, sizes)), shingles], names=["node", "label", "n", "shingle"])

    rows = keep(
        nodes.join(sets, "node").select("node", "label", "shingles").mapInArrow(run, "node bigint, label bigint, n bigint, shingle bigint")
    )
    counts = rows.groupBy("shingle").count().where("count > 1")
    place = Window.partitionBy("node").orderBy("count", "shingle")
    # Shingles that one set has alone come first and can't be shared.
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    limit = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = rows.join(counts, "shingle").withColumn("place", F.row_number().over(place) + alone).where(F.col("place") <= limit)
    side = lambda x: first.select("shingle", F.col("node").alias(x), F.col("label").alias(f"l_{x}"), F.col("n").alias(f"m_{x}"))
    fits = F.expr(f"l_a <> l_b AND a < b AND least(m_a, m_b) * 100 >= greatest(m_a, m_b) * {percent}")
    return side("a").join(side("b"), "shingle").where(fits).select("a", "b")


def block_links(mixed: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the members outside a prefix pair's largest component to its members, block by block."""
    body = known.join(sets, "node")
    a_blocks, b_blocks = F.ceil(F.col("outside") / OUTSIDE_BLOCK), F.ceil(F.col("members") / BLOCK)
    rows = mixed.join(body, "node").withColumns({
        "a_block": F.pmod(F.xxhash64("node"), a_blocks).cast("int"), "b_block": F.pmod(F.xxhash64("node"), b_blocks).cast("int")
    })
    of = ["key", "node", "label", "earlier", "n", "signature", "shingles"]
    left = rows.where("label <> major").select(*of, F.lit(True).alias("left"), "a_block", F.explode(F.sequence(F.lit(0), b_blocks.cast("int") - 1)).alias("b_block"))
    right = rows.select(*of, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), a_blocks.cast("int") - 1)).alias("a_block"), "b_block")
    right = right.select(*left.columns)
    outside_label = rows.select("key", "major").distinct()
    both = left.unionByName(right).join(outside_label, "key")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["left"]], group[~group["left"]]
        links: list[tuple[int, int]] = []
        if len(a) and len(b):
            joined: dict[int, int] = {}

            def root(x):
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            sig_b, n_b = np.stack(b["signature"].to_numpy()), b["n"].to_numpy()
            node_b, label_b, set_b = b["node"].to_numpy(), b["label"].to_numpy(), b["shingles"].tolist()
            outside_b = label_b != group["major"].iloc[0]
            for sig, n, node, label, earlier, shingles in zip(a["signature"], a["n"], a["node"], a["label"], a["earlier"], a["shingles"]):
                equal = sig_b == np.asarray(sig)
                before = np.array([int(earlier) >> k & 1 for k in range(COORDINATES)], bool)
                hits = equal.sum(1)
                fits = (hits >= MATCHES) & ~equal[:, before].any(1) & (label_b != label) & (~outside_b | (node < node_b))
                fits &= np.minimum(n, n_b) * 100 >= np.maximum(n, n_b) * percent
                own = np.frombuffer(shingles, np.uint64)
                tried = np.flatnonzero(fits)
                for j in tried[np.argsort(-hits[tried], kind="stable")]:
                    x, y = root(label), root(label_b[j])
                    if x != y:
                        shared = np.intersect1d(own, np.frombuffer(set_b[j], np.uint64), assume_unique=True).size
                        if shared * 100 >= (n + n_b[j] - shared) * percent:
                            joined[x] = y
                            links.append((min(node, node_b[j]), max(node, node_b[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return both.groupBy("key", "a_block", "b_block").applyInPandas(meet, "a bigint, b bigint")


def links_across(posts: DataFrame, labels: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a prefix pair."""
    members = keep(
        join_on(posts, labels, ["node"], "left").select("key", "node", F.coalesce("label", "node").alias("label"), "earlier")
    )
    sums = (
        members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("key")
        .agg(F.sum("m").alias("members"), F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select("key", "members", F.col("top.label").alias("major"), (F.col("members") - F.col("top.m")).alias("outside"))
    )
    mixed = keep(members.join(sums, "key"))
    few = mixed.where(F.col("members") <= FEW)
    side = lambda x: few.select("key", F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    pairs = side("a").join(side("b"), "key").where("l_a <> l_b AND a < b").select("a", "b")
    # A pair whose first common key has too many members outside is found below.
    heavy = mixed.where((F.col("members") > FEW) & (F.col("outside") > MOST_OUTSIDE)).select("node", "label").distinct()
    if not heavy.isEmpty():
        pairs = pairs.union(keep(shingle_pairs(heavy, sets, percent)))
    # Each step is a plan of its own: one for all would hold the driver for its size alone.
    tried = keep(colliding(keep(pairs.distinct()), known, MATCHES, percent))
    links = keep(confirmed(tried, sets, percent))
    many = mixed.where((F.col("members") > FEW) & (F.col("outside") <= MOST_OUTSIDE))
    return links.union(keep(block_links(many, known, sets, percent)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``row, doc_id, text_hash, n_shingles, component, component_id``: ``component`` is NULL for documents
    that are like no other."""
    signed = keep(signatures(docs, words))
    classes = keep(
        signed.where("n_shingles > 0").groupBy("s1", "s2").agg(
            F.min("row").alias("node"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"),
            F.max("signature").alias("signature"), F.count(F.lit(1)).alias("copies"),
        )
    )
    posts = keep(prefix_postings(classes))
    nodes = posts.select("node").distinct()
    known = keep(classes.join(nodes, "node").select("node", "n", "signature"))
    wanted = join_on(signed.select(F.col("row").alias("node"), "doc_id", "text_hash"), nodes, ["node"], "left_semi")
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def set_of(batches):
        for batch in slices(batches):
            sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    sets = join_on(texts, wanted, ["doc_id", "text_hash"]).select("node", "text").mapInArrow(set_of, "node bigint, shingles binary")
    sets = keep(sets.dropDuplicates(["node"]))

    star = keep(colliding(keep(star_pairs(posts)), known, STAR_MATCHES, percent))
    first = components(confirmed(star, sets, percent))
    across = links_across(posts, first, known, sets, percent)
    lift = lambda x: first.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    between = across.join(lift("a"), "a", "left").join(lift("b"), "b", "left").select(
        F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")
    ).where("a <> b")
    second = components(between)

    # A class that is linked has the component of its label, and one of copies alone its own.
    labels = join_on(first, second.select(F.col("node").alias("label"), F.col("label").alias("joined")), ["label"], "left").select(
        "node", F.coalesce("joined", "label").alias("component")
    )
    labels = labels.union(join_on(second, first.select("node"), ["node"], "left_anti").select("node", "label")).distinct()
    of_class = join_on(classes.select("s1", "s2", "node", "least", "copies"), labels, ["node"], "left").where(
        "component IS NOT NULL OR copies > 1"
    ).withColumn("component", F.coalesce("component", "node"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    known_classes = of_class.join(least, "component").select("s1", "s2", "component", "component_id")
    return (
        signed.drop("signature").join(known_classes, ["s1", "s2"], "left").select(
            "row", "doc_id", "text_hash", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"),
            F.when((F.col("n_shingles") > 0) & F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest id, the first of
    its rows. Documents without words stay."""
    found = keep(near_duplicates(docs, words, percent))
    chosen = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"))
    losers = (
        found.where("component IS NOT NULL").join(chosen, "component").where(F.col("row") != F.col("m.row"))
        .select("doc_id", "text_hash")
    )
    winners = chosen.join(found.select("row", "text_hash"), F.col("m.row") == F.col("row")).select(F.col("m.doc_id").alias("doc_id"), "text_hash")
    # Rows that repeat a winner's id and text can't be told from it by these keys: one of them stays.
    twice = keep(join_on(losers, winners, ["doc_id", "text_hash"], "left_semi").distinct())
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = join_on(keyed, losers.distinct().subtract(twice).withColumnRenamed("text_hash", "_text_hash"), ["doc_id", "_text_hash"], "left_anti")
    if twice.isEmpty():
        return out.drop("_text_hash")
    marked = join_on(out, twice.withColumnsRenamed({"text_hash": "_text_hash"}).withColumn("_twice", F.lit(True)), ["doc_id", "_text_hash"], "left")
    alone = marked.where("_twice IS NULL")
    rank = F.row_number().over(Window.partitionBy("doc_id", "_text_hash").orderBy(*[c for c in docs.columns if c != "text"]))
    again = marked.where("_twice").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return alone.union(again).drop("_text_hash", "_twice")


def op4_components(spark, documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents, words=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
