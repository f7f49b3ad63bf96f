"""What mails, pull requests, tickets and commits have to do with each other.

Each mail is linked to the pull requests, tickets and commits it names. ``components`` contracts the graph:
in a round every node takes the label of the least node of its neighbourhood, by a hash that changes with
the round, and labels become the nodes of the next round. The number of nodes falls by a factor each
round whatever the shape, so a chain of n nodes takes about log n rounds and a hub is one row. Rounds
are written tables; labels are put together from the last round backwards, where tables are smallest. What
is left when at most ``SMALL`` edges are is joined up in one task, which saves the last rounds.
"""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.scratch import scratch_dir, store
from .skew import join_left_hot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAIL, PR, TICKET, COMMIT = "mail", "pr", "ticket", "commit"
SMALL = 200_000             # edges that one task joins up


def _all(*names: str) -> Column:
    """The values of list columns, none twice; never NULL."""
    lists = [F.coalesce(F.col(n).cast("array<string>"), F.array().cast("array<string>")) for n in names]
    return F.array_distinct(F.array_compact(F.concat(*lists)))


def mail_links(mails: DataFrame) -> DataFrame:
    """(mbox, seq, kind, value): what a mail names. Pull requests are those of the mail's mailbox."""
    shas = F.transform("commits", lambda c: c["sha"])
    named = {PR: _all("pr_numbers", "linked_prs"), TICKET: _all("tickets", "linked_tickets"), COMMIT: _all("_shas")}

    def of_kind(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    pairs = F.concat(*[of_kind(k, v) for k, v in named.items()])
    return mails.withColumn("_shas", shas).select("mbox", "seq", F.explode(pairs).alias("p")).select("mbox", "seq", "p.kind", "p.value")


def node(kind: Column, *parts: Column) -> Column:
    return F.concat_ws("/", kind, *parts)


def mail_node() -> Column:
    return node(F.lit(MAIL), F.col("mbox"), F.col("seq").cast("string"))


def value_node() -> Column:
    mbox = F.when(F.col("kind") == PR, F.col("mbox"))
    return node(F.col("kind"), mbox, F.col("value"))


def link_edges(links: DataFrame) -> DataFrame:
    """(a, b): mail and what it names."""
    return links.select(mail_node().alias("a"), value_node().alias("b"))


def _labels(edges: DataFrame, round_: int) -> DataFrame:
    """(node, label, degree): the least node, by hash, of each node and its neighbours."""
    rank = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("h"), F.col(c).alias("n"))
    least = edges.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return least.select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("label"), "degree")


def _joined_up(edges: DataFrame) -> DataFrame:
    """(node, label): each node of a few edges with the least node of its component, in one task."""

    def run(batches):
        above: dict[str, str] = {}

        def top(x: str) -> str:
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = top(a), top(b)
                above[max(p, q)] = min(p, q)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([top(x) for x in nodes], pa.string())], names=["node", "label"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node string, label string")


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(node, component): the least node that can be reached; every node of an edge, a NULL is none.

    ``small`` replaces ``SMALL``; nothing but the time depends on it.
    """
    small = SMALL if small is None else small
    out = scratch_dir(edges.sparkSession)
    given = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = store(given.union(given.select("b", "a")).distinct(), f"{out}/edges")
    now, rounds = both, []
    while (n := now.count()) > 0:
        if n <= small:
            rounds.append(store(_joined_up(now), f"{out}/labels-{len(rounds)}"))
            break
        labels = store(_labels(now, len(rounds)), f"{out}/labels-{len(rounds)}")
        rounds.append(labels)
        ours = join_left_hot(now, labels, "a", ["label"], "degree", key_of="node").select(F.col("label").alias("a"), "b")
        theirs = join_left_hot(ours, labels, "b", ["label"], "degree", key_of="node").select("a", F.col("label").alias("b"))
        now = store(theirs.where("a <> b").distinct(), f"{out}/edges-{len(rounds)}")
    if not rounds:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = rounds[-1].select("node", F.col("label").alias("root"))
    for i, labels in enumerate(reversed(rounds[:-1])):
        roots = store(_through(labels.select("node", "label"), roots), f"{out}/roots-{i}")
    least = roots.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"))
    return join_left_hot(roots, least, "root", ["component"], "n").select("node", F.least("node", "component").alias("component"))


def _through(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): the root of each node's label."""
    asked = labels.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("n"))
    used = roots.join(asked, roots["node"] == asked["_label"]).select(F.col("node").alias("label"), "root", "n")
    return join_left_hot(labels, used, "label", ["root"], "n").select("node", F.coalesce("root", "label").alias("root"))


def pr_graph(mails: DataFrame) -> DataFrame:
    """(kind, node, component, members): every mail that names something, and everything named."""
    found = store(components(link_edges(mail_links(mails))), f"{scratch_dir(mails.sparkSession)}/components")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    return join_left_hot(found, sizes, "component", ["members"], "members").select(
        F.substring_index("node", "/", 1).alias("kind"), "node", "component", "members"
    )


def pr_edges(mails: DataFrame) -> DataFrame:
    """(mbox, pr, kind, value, mails): how many mails of a pull request name something else.

    A mail's pull requests are those of its subject and Message-ID.
    """
    links = mail_links(mails)
    own = mails.select(F.col("mbox").alias("_mbox"), F.col("seq").alias("_seq"), F.explode("pr_numbers").alias("pr"))
    pairs = links.join(own, (F.col("mbox") == F.col("_mbox")) & (F.col("seq") == F.col("_seq")))
    other = (F.col("kind") != PR) | (F.col("value") != F.col("pr").cast("string"))
    return pairs.where(other).groupBy("mbox", "pr", "kind", "value").agg(F.count(F.lit(1)).alias("mails"))
