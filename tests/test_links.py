"""Components, threads, change counts, sessions and hot joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from mailspark.functions.diff import change_counts
from mailspark.operators import analytics, graph, threads
from mailspark.operators.skew import join_left_hot


def least_reachable(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(root)}


def components(spark, edges, small=None):
    df = spark.createDataFrame(edges, "a string, b string")
    return {r["node"]: r["component"] for r in graph.components(df, small).collect()}


@pytest.mark.parametrize("n, small", [(10_000, None), (16, 0)])
def test_chain_hub_and_scattered_nodes(spark, n, small):
    chain = [(f"c{i:05}", f"c{i + 1:05}") for i in range(n)]
    hub = [("hub", f"h{i}") for i in range(n)]
    rng = random.Random(1)
    some = [(f"r{rng.randrange(6_000)}", f"r{rng.randrange(6_000)}") for _ in range(n // 2)]
    edges = chain + hub + some + [("self", "self")]
    assert components(spark, edges, small) == least_reachable(edges)


def test_no_edges(spark):
    assert components(spark, []) == {}
    assert components(spark, [("a", None), (None, "b")]) == {}


def test_join_left_hot(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i) for i in range(3_000)] + [(None, 1), ("missing", 2)]
    left = spark.createDataFrame(rows, "k string, n int")
    loads = {}
    for k, _ in rows:
        loads[k] = loads.get(k, 0) + 1
    right = spark.createDataFrame([(k, k.upper(), c) for k, c in loads.items() if k and k != "missing"], "key string, v string, c long")
    for parts in (4, 10_000):
        out = join_left_hot(left, right, "k", ["v"], "c", parts, key_of="key")
        assert out.columns == ["k", "n", "v"]
        want = [(k, n, k.upper() if k and k != "missing" else None) for k, n in rows]
        assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(map(repr, want))


def heads(spark, rows):
    """(mbox, seq, message_id, names) rows."""
    return spark.createDataFrame(rows, "mbox string, seq long, message_id string, names array<string>")


def walk(rows):
    ids, parent = {}, {}
    for mbox, seq, mid, _ in sorted(rows):
        if mid is not None:
            ids.setdefault(mid, (mbox, seq))
    for mbox, seq, _, names in rows:
        found = [ids[n] for n in names if n in ids and ids[n] != (mbox, seq)]
        parent[(mbox, seq)] = found[0] if found else None
    for start in sorted(parent):
        path, x = [], start
        while x is not None and x not in path:
            path.append(x)
            x = parent[x]
        if x is not None:
            parent[min(path[path.index(x) :])] = None
    out = {}
    for x in parent:
        y, depth = x, 0
        while parent[y] is not None:
            y, depth = parent[y], depth + 1
        out[x] = (y, depth)
    size = {}
    for root, _ in out.values():
        size[root] = size.get(root, 0) + 1
    return {x: (*root, depth, size[root]) for x, (root, depth) in out.items()}


def found_threads(spark, rows, small=None):
    found = threads.mail_threads(heads(spark, rows), small).collect()
    return {(r["mbox"], r["seq"]): (r["root_mbox"], r["root_seq"], r["depth"], r["size"]) for r in found}


@pytest.mark.parametrize("n, small", [(300, None), (12, 0)])
def test_threads(spark, n, small):
    chain = [("a", i, f"a{i}", [f"a{i - 1}"]) for i in range(n)]
    hub = [("b", 0, "b0", [])] + [("b", i, f"b{i}", ["gone", "b0"]) for i in range(1, n)]
    circles = [("c", i, f"c{i}", [f"c{(i + 1) % 7}"]) for i in range(7)] + [("d", 0, "d0", ["d1"]), ("d", 1, "d1", ["d0"])]
    tails = [("e", i, f"e{i}", [f"e{i - 1}" if i else "c3"]) for i in range(40)]
    odd = [("f", 0, "same", ["same"]), ("f", 1, "same", ["same"]), ("f", 2, None, ["f9", "same"]), ("f", 3, None, [])]
    rows = chain + hub + circles + tails + odd
    assert found_threads(spark, rows, small) == walk(rows)


def test_random_threads(spark):
    rng = random.Random(6)
    rows = [("m", i, f"x{i}", [f"x{rng.randrange(260)}" for _ in range(rng.randrange(3))]) for i in range(200)]
    assert found_threads(spark, rows) == walk(rows)
    assert found_threads(spark, []) == {}


def test_thread_headers(spark):
    raw = "Message-ID: <a@b>\nIN-REPLY-TO: your mail of today <p@q>\nReferences: <r1@x>\n <r2@x>\t<p@q>\n\n<no@header>"
    row = threads.thread_headers(spark.createDataFrame([("m", 1, raw), ("m", 2, "Subject: x\n\nb")], "mbox string, seq long, raw string")).collect()
    assert row[0]["message_id"] == "a@b" and row[0]["names"] == ["p@q", "r2@x", "r1@x"]
    assert row[1]["message_id"] is None and row[1]["names"] == []


PATCH = """Hello,
--- not a header
diff --git a/one.py b/one.py
index 1..2 100644
--- a/one.py
+++ b/one.py
@@ -1,4 +1,4 @@ def f():
 same
---- a/looks/like/a/header
+++ b/so/does/this

-gone
+@@ -1,9 +1,9 @@
@@ -10 +10,0 @@
-last
\\ No newline at end of file
diff --git a/new.txt b/new.txt
new file mode 100644
--- /dev/null
+++ b/new.txt
@@ -0,0 +1,2 @@
+a
+b
diff --git a/old name.c b/new name.c
similarity index 90%
rename from old name.c
rename to new name.c
diff --git a/x.png b/x.png
Binary files a/x.png and b/x.png differ
--- a/plain.c\t2024-01-01
+++ b/plain.c\t2024-01-02
@@ -5,3 +5,2 @@
 x
-y
this is no hunk line
+nor is this
@@ -50,1 +49,1 @@
-p
+q
-- 
signature
--- a/dead.c
+++ /dev/null
@@ -1 +0,0 @@
-z"""


def test_change_counts(value_of):
    want = [
        ("one.py", "one.py", "modified", 2, 2, 3), ("/dev/null", "new.txt", "added", 1, 2, 0), ("old name.c", "new name.c", "renamed", 0, 0, 0),
        ("x.png", "x.png", "binary", 0, 0, 0), ("plain.c", "plain.c", "modified", 2, 1, 2), ("dead.c", "/dev/null", "deleted", 1, 0, 1),
    ]
    for text in (PATCH, PATCH.replace("\n", "\r\n")):
        assert [tuple(f) for f in value_of(change_counts, text)] == want


@pytest.mark.parametrize("text", ["", "no diff at all", "+++ b/x\n@@ -1 +1 @@\n-a\n+b", "@@ -1 +1 @@\n+++ x", "--- a\ntext\n+++ b"])
def test_texts_without_a_diff(value_of, text):
    assert value_of(change_counts, text) == []


def test_sessions_across_blocks(spark):
    rng = random.Random(2)
    times = sorted({rng.randrange(40 * 86_400) for _ in range(120)}) + [50 * 86_400, 50 * 86_400 + 100]
    base = 1_704_067_200
    rows = [("m", i, f"{t}", ["r"] if i % 2 else ["r", "s"]) for i, t in enumerate(times)]
    mails = spark.createDataFrame(rows, "mbox string, seq long, t string, repos array<string>").withColumns({
        "date": F.date_format(F.timestamp_seconds(F.col("t").cast("long") + base), "d MMM yyyy HH:mm:ss +0000"),
        "sender": F.lit("x"), "tags": F.array().cast("array<string>"),
    })
    gap = 5 * 3_600
    want = {}
    for repo in ("r", "s"):
        own, sessions = [int(t) for _, _, t, of in rows if repo in of], []
        for t in own:
            if sessions and t - sessions[-1][1] <= gap:
                sessions[-1] = (sessions[-1][0], t, sessions[-1][2] + 1)
            else:
                sessions.append((t, t, 1))
        want |= {(repo, i): (a + base, b + base, n) for i, (a, b, n) in enumerate(sessions, 1)}
    for block in (3_600, 10**7):
        out = analytics.repo_sessions(mails, gap, block).select("repo", "session", F.unix_timestamp("first"), F.unix_timestamp("last"), "mails")
        assert {(r[0], r[1]): tuple(r[2:]) for r in out.collect()} == want
