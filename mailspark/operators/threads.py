"""Reply threads from Message-ID, In-Reply-To and References.

A mail's parent is the first mail that exists among those it names: In-Reply-To, then References from
the last to the first. Roots and depths come from pointer jumping: in each round a mail that has not
reached its root takes over the pointer of the mail it points to, so a thread of depth d takes log d
rounds, and each round works on the mails that are left only. When at most ``SMALL`` are, one task follows
their pointers, which saves the last rounds.

Defined cases: of several mails with one Message-ID the first by (mbox, seq) is meant; a mail that names
itself, or only mails that do not exist, begins a thread; where replies run in a circle, its first mail by
(mbox, seq) begins the thread. Mails without a Message-ID can reply but not be replied to.
"""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import mime
from ..functions.text import extract_all
from ..sinks.scratch import scratch_dir, store
from .skew import join_left_hot

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ID = r"<([^<>\s]+)>"
SMALL = 200_000             # mails whose pointers one task follows
MAIL_ID = ["mbox", "seq"]


def thread_headers(raw_mails: DataFrame) -> DataFrame:
    """(mbox, seq, message_id, names): a mail's own id, and the ids it replies to, nearest first."""
    ids = lambda name: extract_all(mime.header(F.col("head"), name), ID)
    return raw_mails.withColumn("head", mime.head_of(F.col("raw"))).select(
        *MAIL_ID, F.get(ids("message-id"), F.lit(0)).alias("message_id"),
        F.array_distinct(F.concat(ids("in-reply-to"), F.reverse(ids("references")))).alias("names"),
    )


def parents(headers: DataFrame) -> DataFrame:
    """(node, parent): each mail as a struct (mbox, seq), and the mail it replies to or NULL."""
    mail = F.struct(*MAIL_ID).alias("node")
    nodes = headers.select(mail, "message_id", "names")
    asks = nodes.select("node", F.posexplode("names").alias("place", "name"))
    asked = asks.groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("n"))
    known = nodes.where("message_id IS NOT NULL").groupBy("message_id").agg(F.min("node").alias("parent"))
    known = known.join(asked, known["message_id"] == asked["_name"]).select("message_id", "parent", "n")
    found = join_left_hot(asks, known, "name", ["parent"], "n", key_of="message_id").where("parent IS NOT NULL AND parent <> node")
    first = found.groupBy("node").agg(F.min(F.struct("place", "parent"))["parent"].alias("parent"))
    return nodes.select("node").join(first, "node", "left")


def _jump(left: DataFrame, all_: DataFrame) -> DataFrame:
    """``left`` after a jump: each pointer is that of the mail it points to, in ``all_``."""
    asked = left.groupBy(F.col("at").alias("_at")).agg(F.count(F.lit(1)).alias("n"))
    to = all_.select(F.col("node").alias("key"), F.struct("at", "steps", "least", "done").alias("next"))
    used = to.join(asked, to["key"] == asked["_at"]).select("key", "next", "n")
    return join_left_hot(left, used, "at", ["next"], "n", key_of="key").select(
        "node", F.col("next.at").alias("at"), (F.col("steps") + F.col("next.steps")).alias("steps"),
        F.least("least", "next.least").alias("least"), F.col("next.done").alias("done"),
    )


def _start(parent: DataFrame) -> DataFrame:
    """Pointers one step long: at, steps, the least mail on the way, and whether the root is reached."""
    is_root = F.col("parent").isNull()
    return parent.select(
        "node", F.coalesce("parent", "node").alias("at"), F.when(is_root, 0).otherwise(1).cast("bigint").alias("steps"),
        F.col("node").alias("least"), is_root.alias("done"),
    )


def _followed(parent: DataFrame, left: DataFrame, done: DataFrame) -> DataFrame:
    """(node, at, steps) of a few mails: their parents are followed in one task, to mails whose root is known or
    around a circle."""
    known = done.select(F.col("node").alias("parent"), F.struct("at", "steps").alias("known"))
    rows = left.select("node").join(parent, "node").join(known, "parent", "left").select("node", "parent", "known")
    schema = T.StructType([T.StructField(n, left.schema[n].dataType) for n in ("node", "at", "steps")])

    def run(batches):
        key = lambda x: (x["mbox"], x["seq"])
        up, found = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                up[key(r["node"])] = key(r["parent"])
                if r["known"] is not None:
                    found[key(r["parent"])] = (key(r["known"]["at"]), r["known"]["steps"])
        own = list(up)
        for start in own:
            path, on = [], set()
            x = start
            while x not in found and x not in on:
                path.append(x)
                on.add(x)
                x = up[x]
            if x not in found:
                # A circle: its first mail is the root.
                first = min(path[path.index(x) :])
                turn = path.index(first)
                found[first] = (first, 0)
                rest = path[turn + 1 :]
                back = path[path.index(x) : turn]
                # Those before the first mail on the path reach it by it; those behind it go around.
                for i, y in enumerate(reversed(back), 1):
                    found[y] = (first, i)
                for i, y in enumerate(reversed(rest), 1):
                    found[y] = (first, i + len(back))
                path = path[: path.index(x)]
            root, depth = found[x]
            for i, y in enumerate(reversed(path), 1):
                found[y] = (root, depth + i)
        as_struct = lambda x: {"mbox": x[0], "seq": x[1]}
        out = [{"node": as_struct(x), "at": as_struct(found[x][0]), "steps": found[x][1]} for x in own]
        yield from pa.Table.from_pylist(out, schema=to_arrow_schema(schema)).to_batches()

    return rows.repartition(1).mapInArrow(run, schema)


def _resolve(parent: DataFrame, out: str, small: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the mails whose root is found, and the rest, which run into circles."""
    first = store(_start(parent), f"{out}/start")
    done, left = [first.where("done")], first.where("NOT done")
    before = None
    while (n := left.count()) and n != before:
        # In a round in which none ends, none of those left ever will.
        before = n
        everything = left
        for d in done:
            everything = everything.unionByName(d)
        if n <= small:
            rest = store(_followed(parent, left, everything.where("done")), f"{out}/rest")
            return [*done, rest.withColumns({"least": F.col("at"), "done": F.lit(True)})], left.limit(0)
        jumped = store(_jump(left, everything), f"{out}/round-{len(done)}")
        done.append(jumped.where("done"))
        left = jumped.where("NOT done")
    return done, left


def _circle_starts(left: DataFrame, out: str) -> DataFrame:
    """(node): the first mail of each circle, from pointers of mails that all run into circles."""
    n, reach = left.count(), 1
    now = left
    while reach <= n:
        now = store(_jump(now, now), f"{out}/circle-{reach}")
        reach *= 2
    # After more steps than there are mails a pointer is on the circle, and has been all around it.
    on = now.select("at").distinct().withColumnRenamed("at", "node")
    return now.join(on, "node").select(F.col("least").alias("node")).distinct()


def mail_threads(headers: DataFrame, small: int | None = None) -> DataFrame:
    """(mbox, seq, root_mbox, root_seq, depth, size) of every mail.

    ``small`` replaces ``SMALL``; nothing but the time depends on it.
    """
    small = SMALL if small is None else small
    out = scratch_dir(headers.sparkSession)
    parent = store(parents(store(headers, f"{out}/headers")), f"{out}/parents")
    done, left = _resolve(parent, f"{out}/a", small)
    if not left.isEmpty():
        starts = store(_circle_starts(left, f"{out}/b"), f"{out}/starts").withColumn("cut", F.lit(True))
        again = parent.join(left.select("node"), "node").join(starts, "node", "left")
        cut = F.when(F.col("cut").isNull(), F.col("parent"))
        more, _ = _resolve(again.select("node", cut.alias("parent")), f"{out}/c", small)
        done += more
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    rows = store(found.select("node", F.col("at").alias("root"), F.col("steps").alias("depth")), f"{out}/found")
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return join_left_hot(rows, sizes, "root", ["size"], "size").select(
        "node.mbox", "node.seq", F.col("root.mbox").alias("root_mbox"), F.col("root.seq").alias("root_seq"), "depth", "size"
    )
