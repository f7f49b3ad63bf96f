"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

A source's rows are cut into blocks. With weight w the source's i-th block (from 1) is released at
slot floor((i - 1) / w) and due at slot ceil(i / w); at each slot the released block with the
earliest deadline is taken. With weights that sum to one every block meets its deadline, so at any
slot the blocks a source has had differ from slot * w by less than one.

Weights are fractions a / UNIT with whole a, by largest remainder: off by less than 2^-40. A weight below
``2 / MOST_SLOTS`` of the whole counts as that. The slots up to the last block of any source are worked
out on the driver; they are ``MOST_SLOTS`` at most at any size of the table, because the block, the unit
that is dealt out, grows with it: ``block`` rows, doubled until the slots suffice (64 rows up to some 33
million rows; at 10^10 rows 32,768). The bound of less than one block holds at every slot. A source that has
run out leaves its slots empty: the others close up, in their proportions. All rows are kept. None
repeats, unless ``repeat`` is set: then a source that would run out begins again, until the source with
the most slots has had all its rows; ``epochs`` says how often that is for each source.

Edge cases: a NULL source is a source like others; ties and repeated rows are ranked by all columns;
an empty table gives an empty result; other columns pass through, but the names this operator adds
(``block, release, deadline, slot, rank_in_source``) are replaced.
"""

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_on, rank_within

BLOCK = 64
#: Slots that are worked out: at least, and at most (or 16 a source); weights are fractions of the unit.
PERIOD, MOST_SLOTS, UNIT = 1024, 1 << 19, 1 << 40
SEED = 9
#: Cells of a source for ranking, and slots summed together for positions.
CELLS, SLOTS_AT_ONCE = 256, 4096


def shares(weights: dict, period: int) -> dict:
    """Whole parts of the period by largest remainder, at least one each, summing to the period."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    parts = {s: int(x) for s, x in exact.items()}
    rest = period - sum(parts.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[:rest]:
        parts[s] += 1
    for s in [s for s, a in parts.items() if not a]:
        parts[max(parts, key=parts.get)] -= 1
        parts[s] = 1
    return parts


def period_schedule(parts: dict, period: int, until: int | None = None) -> dict:
    """Slots of each of a source's blocks before ``until`` (one period), earliest deadline first; a
    source's weight is its part of the period."""
    until = until or period
    slots, coming, ready = {s: [] for s in parts}, [(0, str(s), i, s) for i, s in enumerate(parts)], []
    heapq.heapify(coming)
    had = dict.fromkeys(parts, 0)
    for slot in range(until):
        while coming and coming[0][0] <= slot:
            _, name, i, s = heapq.heappop(coming)
            had[s] += 1
            heapq.heappush(ready, (-(-had[s] * period // parts[s]), name, i, s))
            heapq.heappush(coming, (had[s] * period // parts[s], name, i, s))
        deadline, _, _, s = heapq.heappop(ready)
        if deadline <= slot:
            raise ArithmeticError("a block misses its deadline")
        slots[s].append(slot)
    return slots


def tempered_weights(docs: DataFrame, power: float = 0.5) -> dict:
    """Target weights proportional to a power of a source's row count: one number per source."""
    return {s: n**power for s, n in docs.groupBy("source").count().collect()}


def most_slots(weights: dict) -> int:
    return max(MOST_SLOTS, 16 * len(weights))


def raised(weights: dict) -> dict:
    """The weights, none below two in ``most_slots`` of their sum."""
    least = sum(map(Fraction, weights.values())) * 2 / most_slots(weights)
    return {s: max(Fraction(w), least) for s, w in weights.items()}


def rows_dealt(sizes: dict, parts: dict, repeat: bool) -> dict:
    """Rows of each source in the schedule, with repeats."""
    longest = max(sizes, key=lambda s: Fraction(sizes[s], parts[s]), default=None)
    return {s: max(n, -(-sizes[longest] * parts[s] // parts[longest])) if repeat else n for s, n in sizes.items()}


def fitting_block(rows: dict, parts: dict, block: int, period: int = PERIOD) -> tuple[int, int]:
    """The block, doubled until the last deadline is within ``most_slots``, and the slots it takes."""
    while True:
        slots = max([period, *(-(-(-(-n // block)) * UNIT // parts[s]) for s, n in rows.items())])
        if slots <= most_slots(parts):
            return block, slots
        block *= 2


def epochs(sizes: dict, weights: dict) -> dict:
    """How often each source's rows are dealt out by a schedule that repeats them, as a float."""
    parts = shares(raised(weights), UNIT)
    rows = rows_dealt(sizes, parts, True)
    return {s: rows[s] / n for s, n in sizes.items()}


def schedule(
    docs: DataFrame, weights: dict, block: int = BLOCK, period: int = PERIOD, seed: int = SEED, repeat: bool = False
) -> DataFrame:
    """``docs`` with ``rank_in_source, block, release, deadline, slot``; each source needs a weight.

    A row without a weight for its source is an error of the caller and fails the job. The schedule
    (at most ``most_slots`` numbers) is broadcast. One job counts the rows of each source.
    """
    docs = docs.drop("rank_in_source", "block", "release", "deadline", "slot")
    if not weights:
        weights = {None: 1.0}
    sizes = {s: n for s, n in docs.groupBy("source").count().collect() if s in weights}
    parts = shares(raised(weights), UNIT)
    rows = rows_dealt(sizes, parts, repeat)
    block, slots = fitting_block(rows, parts, block, period)
    found = period_schedule(parts, UNIT, slots)
    plan = docs.sparkSession.createDataFrame(
        [(s, parts[s], found[s], sizes.get(s, 0), rows.get(s, 0)) for s in parts],
        "source string, _share bigint, _slots array<bigint>, _size bigint, _rows bigint",
    )
    everything = [F.col(f"`{c}`") for c in docs.columns]
    ranked = rank_within(docs, ["source"], everything, "rank_in_source", CELLS, seed)
    planned = join_on(ranked, F.broadcast(plan), ["source"], "left")
    if repeat:
        times = F.coalesce(F.sequence("rank_in_source", F.col("_rows") - 1, "_size"), F.array("rank_in_source"))
        planned = planned.withColumn("rank_in_source", F.explode(times))
    return (
        planned.withColumn("block", F.floor(F.col("rank_in_source") / block))
        .withColumns({
            "release": F.expr(f"block * {UNIT} div _share"),
            "deadline": F.expr(f"((block + 1) * {UNIT} + _share - 1) div _share"),
            "slot": F.coalesce(
                F.element_at("_slots", (F.col("block") + 1).cast("int")),
                F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("NULL")))).cast("bigint"),
            ),
        })
        .drop("_share", "_slots", "_size", "_rows")
    )


def positions(scheduled: DataFrame) -> DataFrame:
    """Add ``position``, the gapless 0-based place of a row in the mixed order.

    A slot starts where the slots before it end: sums over slots in groups of slots, then over groups.
    A slot holds one block of one source, whose ranks follow each other.
    """
    counts = scheduled.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("rank_in_source").alias("first")).withColumn(
        "group", F.floor(F.col("slot") / SLOTS_AT_ONCE)
    )
    in_group = Window.partitionBy("group").orderBy("slot")
    counts = counts.withColumn("inside", F.sum("n").over(in_group) - F.col("n"))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.withColumn("base", F.sum("n").over(Window.orderBy("group")) - F.col("n")).drop("n")
    starts = counts.join(groups, "group").select("slot", (F.col("base") + F.col("inside") - F.col("first")).alias("_start"))
    return (
        scheduled.join(starts, "slot")
        .withColumn("position", F.col("_start") + F.col("rank_in_source"))
        .drop("_start")
    )


def in_mixed_order(scheduled: DataFrame) -> DataFrame:
    """Rows laid out in the mixed order: partitions follow each other, rows inside are sorted."""
    return scheduled.repartitionByRange("slot", "rank_in_source").sortWithinPartitions("slot", "rank_in_source")


def op9_mixture(spark, documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "source")
    mixed = positions(schedule(rows, tempered_weights(rows)))
    return mixed.select("doc_id", "source", "rank_in_source", "block", "release", "deadline", "slot", "position")
