"""Hard negatives by inner product, with cover trees over norm-augmented candidates.

Each candidate gets one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm of its block,
and an anchor q gets a zero there; inner products stay as they are, and the largest one is the nearest
point. A node of a tree holds the points nearest to its centre, within a covering radius r, so the
inner product of q with each of them lies in ``q.c - |q|r .. q.c + |q|r``. Children are chosen farthest
first until their radii have shrunk by ``SHRINK``, so levels cover at falling radii.

* **Blocks.** Pivots, the roots' centres, come from a bounded sample (``SAMPLE`` rows, chosen by a hash of
  the row). Every row goes to its nearest pivot; a pivot's rows are cut by a hash into blocks of about
  ``BLOCK`` rows, so a hot region is many blocks. One task makes one block's tree, stored as one row.
* **Search.** Anchors meet the blocks of a pivot if the pivot's own radius lets a window reach in. In a
  block an anchor descends best first: nodes whose bounds lie outside its windows, or below what it has
  found, are skipped; leaves are verified by exact integer products. A block passes on its best rows only.
* **Two passes.** Positives: first the anchor's own pivot, which gives a floor, then all other pivots that
  can reach it. Negatives: windows of the positives' scores.

The index decides only where rows lie; every row is in it, and the results are exact.

Defined cases: rows with a NULL label or vector, or a NULL or non-finite component take no part; shorter
vectors count as filled up with zeros; of rows with the same label and vector only as many enter as can
be returned, the first by (id, row); repeated rows are rows of their own ("other rows" leaves out only the
anchor's row); ties go to the smaller id; anchors without positives or negatives give no rows; an empty
table gives none. Scores must fit 64 bits; otherwise the query fails with an overflow error.
"""

import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE, PIVOTS = 2_048, 64
BLOCK, ANCHORS = 8_192, 1_024
LEAF, CHILDREN, SHRINK = 64, 16, 1.5
EXACT = float(1 << 53)
#: Below every score, with room to change its sign; and behind every id.
NOTHING, NO_ID = -(1 << 63) + 1, (1 << 63) - 1
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies within these hundredths of the positive's.
LOWEST, HIGHEST = 50, 95

NODE = "array<struct<start:int,size:int,centre:int,radius:double,child:int,children:int,low:bigint,high:bigint>>"


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A list column of equal lengths as rows of 64-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(rows, -1)


def augmented(points: np.ndarray) -> np.ndarray:
    x = points.astype(np.float64)
    norms = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))])


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def spread_centres(x: np.ndarray, first: int, most: int, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres farthest first until all points are within ``radius`` of one; each point's centre and its
    distance to it."""
    centres, owner = [first], np.zeros(len(x), np.int64)
    gap = distances(x, x[first])
    while len(centres) < most and gap.max(initial=0.0) > radius:
        new = int(gap.argmax())
        other = distances(x, x[new])
        closer = other < gap
        owner[closer], gap[closer] = len(centres), other[closer]
        centres.append(new)
    return centres, owner, gap


def cover_tree(points: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The order of the points in which every node is a range, and the nodes, parents first."""
    x, n = augmented(points), len(points)
    order = np.arange(n)
    first = int(distances(x, x.mean(axis=0)).argmin())
    nodes, todo = [], [(0, n, first, float(distances(x, x[first]).max()))]
    at = 0
    while at < len(todo):
        start, size, centre, radius = todo[at]
        rows = order[start : start + size].copy()
        child = children = 0
        if size > LEAF and radius > 0:
            centres, owner, gap = spread_centres(x[rows], int(np.flatnonzero(rows == centre)[0]), CHILDREN, radius / SHRINK)
            order[start : start + size] = rows[np.argsort(owner, kind="stable")]
            child, children = len(todo), len(centres)
            sizes = np.bincount(owner, minlength=children)
            starts = start + np.cumsum(sizes) - sizes
            todo += [(int(s), int(m), int(rows[c]), float(gap[owner == k].max())) for k, (s, m, c) in enumerate(zip(starts, sizes, centres))]
        own = labels[rows]
        nodes.append((start, size, centre, radius, child, children, int(own.min()), int(own.max())))
        at += 1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, [(s, m, int(place[c]), *rest) for s, m, c, *rest in nodes]


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floating point where every sum is below 2^53, else whole numbers."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(queries.shape[1], 1)
    if largest < EXACT:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    return (queries.astype(object) @ points.astype(object).T).astype(np.int64)


class Block:
    """A stored tree in a task."""

    def __init__(self, table: pa.Table):
        n = len(table.column("ids")[0])
        self.ids, self.rows, self.labels = (np.asarray(table.column(c)[0].values) for c in ("ids", "rows", "labels"))
        self.points = np.asarray(table.column("points")[0].values, np.int64).reshape(n, -1)
        nodes = table.column("nodes")[0].values
        get = lambda name: np.asarray(nodes.field(name))
        self.start, self.size, self.child, self.children = get("start"), get("size"), get("child"), get("children")
        self.low, self.high, self.radius = get("low"), get("high"), get("radius")
        self.centres = self.points[get("centre")].astype(np.float64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that a node can hold, with slack for rounding."""
        q = queries.astype(np.float64)
        at = q @ self.centres.T
        norms = np.sqrt((q * q).sum(axis=1))
        reach = norms[:, None] * self.radius[None, :]
        slack = 1.0 + 1e-9 * (np.abs(at) + reach + norms[:, None] * np.sqrt((self.centres**2).sum(axis=1))[None, :])
        return at - reach - slack, at + reach + slack

    def search(self, queries, labels, rows, same: bool, floor, low, high, k: int):
        """Best k (score, id, row) of each query, scores within low..high and not below its floor.

        Each node is visited with the queries it can serve, best bound first, so that what is found in
        one leaf closes others.
        """
        best = np.full((len(queries), k), NOTHING, np.int64)
        best_id = np.full((len(queries), k), NO_ID, np.int64)
        best_row = np.full((len(queries), k), -1, np.int64)
        least, most = self.bounds(queries)
        most = np.minimum(most, high[:, None])

        def open_to(node: int, who: np.ndarray) -> np.ndarray:
            inside = (least[who, node] <= high[who]) & (most[who, node] >= np.maximum(np.maximum(low[who], floor[who]), best[who, -1]))
            if same:
                inside &= (labels[who] >= self.low[node]) & (labels[who] <= self.high[node])
            elif self.low[node] == self.high[node]:
                inside &= labels[who] != self.low[node]
            return who[inside]

        heap = [(-np.inf, 0, np.arange(len(queries)))]
        while heap:
            _, node, who = heapq.heappop(heap)
            who = open_to(node, who)
            if not len(who):
                continue
            if self.children[node]:
                for c in range(self.child[node], self.child[node] + self.children[node]):
                    left = open_to(c, who)
                    if len(left):
                        heapq.heappush(heap, (-float(most[left, c].max()), c, left))
                continue
            part = slice(self.start[node], self.start[node] + self.size[node])
            score = products(queries[who], self.points[part])
            fits = (labels[who][:, None] == self.labels[part][None, :]) == same
            fits &= (rows[who][:, None] != self.rows[part][None, :]) & (score >= np.maximum(low, floor)[who][:, None]) & (score <= high[who][:, None])
            fits &= score >= best[who, -1][:, None]
            any_ = fits.any(axis=1)
            who, score, fits = who[any_], score[any_], fits[any_]
            if not len(who):
                continue
            shape = score.shape
            scores = np.concatenate([best[who], np.where(fits, score, NOTHING)], axis=1)
            ids = np.concatenate([best_id[who], np.where(fits, np.broadcast_to(self.ids[part], shape), NO_ID)], axis=1)
            at = np.concatenate([best_row[who], np.where(fits, np.broadcast_to(self.rows[part], shape), -1)], axis=1)
            top = np.lexsort((at, ids, -scores), axis=1)[:, :k]
            best[who], best_id[who], best_row[who] = (np.take_along_axis(v, top, axis=1) for v in (scores, ids, at))
        found, place = np.nonzero(best_row >= 0)
        return found, best[found, place], best_id[found, place], best_row[found, place]


def pivots_of(points: DataFrame, n: int) -> np.ndarray:
    """Centres of the top level, farthest first over a sample of ``SAMPLE`` rows."""
    sample = points.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec").collect()
    x = np.array([r["vec"] for r in sample], np.float64).reshape(len(sample), -1)
    count = min(PIVOTS, max(-(-n // BLOCK), 1))
    centres, _, _ = spread_centres(x, int(distances(x, x.mean(axis=0)).argmin()), count, 0.0)
    return x[centres]


def with_pivot(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each row's nearest pivot and its distance to it."""

    def nearest(batches):
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vec")), batch.num_rows).astype(np.float64)
            square = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
            own = square.argmin(axis=1) if len(x) else np.empty(0, np.int64)
            far = np.sqrt(((x - pivots[own]) ** 2).sum(axis=1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int32()), pa.array(far, pa.float64())], names=[*batch.schema.names, "pivot", "far"]
            )

    return points.mapInArrow(nearest, "row bigint, id bigint, label bigint, vec array<bigint>, pivot int, far double")


def trees_of(points: DataFrame) -> DataFrame:
    """(pivot, block, ids, rows, labels, points, nodes): one row per block of about ``BLOCK`` rows."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = matrix(table.column("vec"), table.num_rows)
        labels = np.asarray(table.column("label"))
        order, nodes = cover_tree(x, labels)
        names = ["start", "size", "centre", "radius", "child", "children", "low", "high"]
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        ints, long = [pa.int32()] * 3, pa.int64()
        kinds = [*ints, pa.float64(), pa.int32(), pa.int32(), long, long]
        return pa.table({
            "pivot": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
            "ids": one(np.asarray(table.column("id"))[order], long), "rows": one(np.asarray(table.column("row"))[order], long),
            "labels": one(labels[order], long), "points": one(x[order].ravel(), long),
            "nodes": pa.array([[dict(zip(names, v)) for v in nodes]], pa.list_(pa.struct(list(zip(names, kinds))))),
        })

    return points.groupBy("pivot", "block").applyInArrow(
        build,
        f"pivot int, block int, ids array<bigint>, rows array<bigint>, labels array<bigint>, points array<bigint>, nodes {NODE}",
    )


def reachable(queries: DataFrame, pivots: np.ndarray, radii: np.ndarray, blocks: list[int], own: bool | None) -> DataFrame:
    """A row for each query and each block whose pivot its window can reach; ``own`` takes the query's own
    pivot only (True) or all others (False)."""
    norms = np.sqrt((pivots * pivots).sum(axis=1))
    schema = queries.schema.simpleString()[len("struct<") : -1]

    def meet(batches):
        for batch in batches:
            q = matrix(batch.column(batch.schema.get_field_index("vec")), batch.num_rows).astype(np.float64)
            get = lambda name: np.asarray(batch.column(batch.schema.get_field_index(name)))
            at, size = q @ pivots.T, np.sqrt((q * q).sum(axis=1))
            reach = size[:, None] * radii[None, :]
            slack = 1.0 + 1e-9 * (reach + size[:, None] * norms[None, :])
            can = (at + reach + slack >= get("least")[:, None]) & (at - reach - slack <= get("most")[:, None])
            if own is not None:
                can &= (np.arange(len(pivots))[None, :] == get("pivot")[:, None]) == own
            who, pivot = np.nonzero(can)
            many = np.asarray(blocks)[pivot]
            block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(np.repeat(who, many))).columns, pa.array(np.repeat(pivot, many), pa.int32()), pa.array(block, pa.int32())],
                names=[*batch.schema.names, "to_pivot", "block"],
            )

    return queries.mapInArrow(meet, f"{schema}, to_pivot int, block int")


def hits(trees: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(q, score, id, row) of the best k of each query in each block it meets."""
    asked = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(1 << 20)))
    # So many groups of queries to a block that each has about ``ANCHORS``.
    sizes = asked.groupBy("to_pivot", "block").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("parts"))
    asked = (
        asked.join(sizes, ["to_pivot", "block"]).withColumn("part", F.pmod("part", "parts").cast("int")).drop("parts")
    )
    offered = trees.join(sizes, (trees["pivot"] == sizes["to_pivot"]) & (trees["block"] == sizes["block"])).select(
        trees["pivot"].alias("to_pivot"), trees["block"], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "ids", "rows", "labels", "points", "nodes",
    )
    empty = pa.schema([("q", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())]).empty_table()

    def search(queries: pa.Table, tree: pa.Table) -> pa.Table:
        if not queries.num_rows or not tree.num_rows:
            return empty
        get = lambda name: np.asarray(queries.column(name))
        found, score, ids, rows = Block(tree).search(
            matrix(queries.column("vec"), queries.num_rows), get("label"), get("row"), same, get("least"), get("least"), get("most"), k
        )
        return pa.table({"q": get("q")[found], "score": score, "id": ids, "row": rows})

    place = ["to_pivot", "block", "part"]
    return asked.groupBy(*place).cogroup(offered.groupBy(*place)).applyInArrow(search, "q bigint, score bigint, id bigint, row bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has id, label (whole numbers) and vec (array of whole numbers); ``is_anchor`` is a condition
    on id. Anchors, points and trees are written tables, read by each pass.
    """
    spark = rows.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    fits = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull())
    valid = rows.select(F.col("id").cast("bigint"), F.col("label").cast("bigint"), F.col("vec").cast("array<bigint>")).where(fits)
    numbered = keep(valid.withColumn("row", F.monotonically_increasing_id()))
    n, width = numbered.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], out)
    # A vector needs a place at least for its rows to be told apart.
    filled = F.concat("vec", F.array_repeat(F.lit(0).cast("bigint"), F.lit(max(width, 1)) - F.size("vec")))
    numbered = numbered.select("row", "id", "label", filled.alias("vec"))

    copies = Window.partitionBy("label", "vec").orderBy("id", "row")
    first = numbered.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= max(positives + 1, negatives)).drop("_copy")
    points = keep(first)
    pivots = pivots_of(points, n)
    placed = keep(with_pivot(points, pivots))
    sizes = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    blocks = [-(-sizes[p]["n"] // BLOCK) if p in sizes else 0 for p in range(len(pivots))]
    radii = np.array([sizes[p]["far"] if p in sizes else 0.0 for p in range(len(pivots))])
    many = F.get(F.lit(blocks), F.col("pivot"))
    trees = keep(trees_of(placed.withColumn("block", F.pmod(F.xxhash64("row", "id"), many).cast("int"))))

    anchors = with_pivot(numbered.where(is_anchor), pivots).withColumnRenamed("row", "q").withColumn("row", F.col("q")).drop("far")
    lowest_score, largest_score = F.lit(NOTHING + 1).cast("bigint"), F.lit(NO_ID).cast("bigint")
    open_ = keep(anchors.withColumns({"least": lowest_score, "most": largest_score}))
    near = keep(best(hits(trees, reachable(open_, pivots, radii, blocks, True), True, positives), positives))
    floors = near.where(F.col("rank") == positives).select("q", F.col("score").alias("_floor"))
    floored = open_.join(floors, "q", "left").withColumn("least", F.coalesce("_floor", "least")).drop("_floor")
    rest = hits(trees, reachable(floored, pivots, radii, blocks, False), True, positives)
    found = keep(best(near.drop("rank").unionByName(rest), positives))

    # One search for each different window of an anchor.
    low = F.ceil(F.lit(lowest) * F.col("score").cast("decimal(20,0)") / 100).cast("bigint")
    high = F.floor(F.lit(highest) * F.col("score").cast("decimal(20,0)") / 100).cast("bigint")
    windows = keep(
        found.select(F.col("q").alias("anchor"), "score").distinct()
        .withColumns({"least": low, "most": high}).where("least <= most").withColumn("q", F.monotonically_increasing_id())
    )
    asked = windows.drop("score").join(open_.select(F.col("q").alias("anchor"), "row", "label", "vec"), "anchor")
    negative = best(hits(trees, reachable(asked.drop("anchor"), pivots, radii, blocks, None), False, negatives), negatives)
    ids = open_.select(F.col("q").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = found.select(F.col("q").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        negative.select("q", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(windows.select("q", "anchor", F.col("score").alias("positive_score")), "q")
        .join(pairs, ["anchor", "positive_score"]).join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op11_mined(spark, embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every 50th vector; vectors in 1/256ths, every 7th label moved on."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").alias("id"), label.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"),
    )
    return hard_negatives(rows, F.col("id") % 50 == 0)
