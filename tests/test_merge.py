"""The merge against a one-mail-at-a-time model, on random and on skewed mailboxes."""

import random

import pytest
from pyspark.sql import functions as F

from mailspark import schemas
from mailspark.operators import merge as M
from mailspark.operators.ordering import with_rank


def mail(mbox, seq, prs, rng):
    words = ["x", "y", "z"]
    pick = lambda: sorted(rng.sample(words, rng.randint(1, 2))) if rng.random() < 0.6 else None
    made = {
        "mbox": mbox, "seq": seq, "subject": f"s{seq}", "sender": f"f{seq}", "date": f"d{seq}",
        "message_id": f"m{seq}", "pr_numbers": sorted(prs) or None, "pr_title": f"t{seq}",
        "repos": pick(), "tickets": pick(), "body": "" if rng.random() < 0.2 else f"b{seq}",
        "markdown": {
            "code_blocks": [f"c{seq}"] if rng.random() < 0.8 else None,
            "headings": [{"heading": None, "lines": [f"h{seq}"]}] if rng.random() < 0.9 else None,
            "lists": [f"- l{seq}", "- sonar"] if rng.random() < 0.8 else None,
        },
        "commits": [{"sha": "abcdef1", "short": "abcdef1", "message": None}] if rng.random() < 0.3 else None,
        "files_modified": pick(), "file_paths": pick(), "tags": pick(), "linked_prs": [seq % 3],
        "linked_tickets": pick(), "contributors": pick(),
    }
    return {**made, **{f"has_{k}": v is not None for k, v in made["markdown"].items()}}


def folded(mails, keep_unlinked=False):
    """Mails in file order, each added once to every leader of its PRs."""
    leaders, of_pr = [], {}
    for m in sorted(mails, key=lambda m: m["seq"]):
        prs = m["pr_numbers"] or []
        if not leaders or (keep_unlinked and not prs):
            leaders.append([m])
            of_pr.update({p: leaders[-1] for p in prs if p not in of_pr})
            continue
        joined = []
        for p in prs:
            if p not in of_pr:
                new = next((g for g in leaders if g[0] is m), None)
                if new is None:
                    new = [m]
                    leaders.append(new)
                    joined.append(new)
                of_pr[p] = new
            elif not any(of_pr[p] is g for g in joined):
                of_pr[p].append(m)
                joined.append(of_pr[p])
    return leaders


def summary(group):
    union = lambda f: sorted({x for m in group for x in m[f] or []}) or None
    kept = lambda k: (
        [x for m in group for x in m["markdown"][k]] if all(m["markdown"][k] for m in group) else None
    )
    lead = group[0]
    return {
        "mbox": lead["mbox"], "seq": lead["seq"], "members": len(group), "subject": lead["subject"],
        "pr_numbers": lead["pr_numbers"], "pr_title": lead["pr_title"],
        "body": "\n\n".join([lead["body"], *[m["body"] for m in group[1:] if m["body"]]]),
        **{f: union(f) for f in ["repos", "tickets", "files_modified", "tags", "contributors"]},
        "code_blocks": kept("code_blocks"), "lists": kept("lists"),
        "headings": kept("headings") and [h["lines"][0] for h in kept("headings")],
    }


def shown(merged):
    """The tables of merged mails put together, in the form of the model."""
    out = {}
    for r in merged.heads.collect():
        out[r["mbox"], r["seq"]] = {
            **{c: r[c] for c in ["mbox", "seq", "members", "subject", "pr_numbers", "pr_title", "tags"]}, "body": [],
            **dict.fromkeys(["repos", "tickets", "files_modified", "contributors", "code_blocks", "lists", "headings"]),
        }
    for r in merged.values.collect():
        if r["field"] in ("repos", "tickets", "files_modified", "contributors"):
            mail = out[r["mbox"], r["seq"]]
            mail[r["field"]] = sorted([*(mail[r["field"]] or []), r["value"]])
    for r in merged.markdown.orderBy("rank", "item").collect():
        mail = out[r["mbox"], r["seq"]]
        mail[r["key"]] = [*(mail[r["key"]] or []), r["text"]]
    for r in merged.texts.orderBy("rank").collect():
        out[r["mbox"], r["seq"]]["body"].append(r["body"])
    return [{**m, "body": "\n\n".join(m["body"])} for _, m in sorted(out.items())]


def table(spark, mails):
    return spark.createDataFrame(mails, schemas.MAILS).repartition(7, "subject")


@pytest.fixture(scope="module")
def mails():
    rng = random.Random(5)
    out = []
    for box in range(12):
        for seq in range(rng.randint(1, 30)):
            out.append(mail(f"box{box}", seq, set(rng.choices(range(1, 7), k=rng.choice([0, 1, 1, 1, 2, 3]))), rng))
    return out


def by_box(mails):
    boxes = {}
    for m in mails:
        boxes.setdefault(m["mbox"], []).append(m)
    return boxes.values()


@pytest.mark.parametrize("span", [2, 5, 65536])
def test_same_as_model(spark, mails, span):
    got = shown(M.merge_by_pr(table(spark, mails), M.members(table(spark, mails), span=span)))
    want = [summary(g) for box in by_box(mails) for g in folded(box)]
    assert got == sorted(want, key=lambda r: (r["mbox"], r["seq"]))


def test_options(spark, mails):
    kept = M.merge_by_pr(table(spark, mails), M.members(table(spark, mails), keep_unlinked=True)).heads.select("mbox", "seq").collect()
    want = {(g[0]["mbox"], g[0]["seq"]) for box in by_box(mails) for g in folded(box, True)}
    assert {tuple(r) for r in kept} == want
    quiet = M.merge_by_pr(table(spark, mails), skip_sonar=True, union_markdown=True).markdown
    assert {r["rank"] for r in quiet.where("text = '- sonar'").collect()} == {1}
    every = {(r["mbox"], r["seq"], r["text"]) for r in quiet.where("key = 'code_blocks'").collect()}
    assert every == {(g[0]["mbox"], g[0]["seq"], x) for b in by_box(mails) for g in folded(b) for m in g for x in m["markdown"]["code_blocks"] or []}


def test_values_are_distinct(spark, mails):
    t = table(spark, mails)
    rows = M.merged_values(M.members(t), t, ["commits", "repos"]).collect()
    assert len(rows) == len(set(rows)) and {r["field"] for r in rows} == {"commits", "repos"}
    assert {(r["value"], r["detail"]) for r in rows if r["field"] == "commits"} == {("abcdef1", None)}


def test_one_pr_with_a_third_of_all_mails(spark):
    """A hot PR's mails are as many rows; no row grows with their number."""
    rng = random.Random(1)
    mails = [mail("hot", i, {1} if i % 3 == 0 else {100 + i // 9}, rng) for i in range(3600)]
    t = table(spark, mails)
    merged = M.merge_by_pr(t, M.members(t, span=64))
    head = merged.heads.where("seq = 0").first()
    assert head["members"] == 1200 and head["subject"] == "s0" and len(head["tags"]) == 3
    bodies = merged.texts.where("seq = 0").orderBy("rank").collect()
    assert [r["body"] for r in bodies] == [m["body"] for m in mails[::3] if m["seq"] == 0 or m["body"]]
    assert merged.values.where("seq = 0 AND field = 'linked_prs'").count() == 1


def test_members_exchange_on_block(spark, mails):
    """The join of mails with their PR's leader spreads over blocks of positions."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.members(table(spark, mails))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line and "pr#" in line]
    assert joins and all("block#" in line for line in joins)
    assert any("hashpartitioning(mbox#" in x and "pr#" in x and "block#" in x for x in plan.split("\n"))


def test_rank_in_blocks(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", i * 3 + rng.randint(0, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long").withColumn("block", F.col("seq") - F.col("seq") % 16)
    got = with_rank(df, ["k"], ["block"], ["seq"], group_aggs={"top": (F.max("seq"), "max")}).collect()
    for k in "ab":
        want = sorted(s for kk, s in rows if kk == k)
        mine = sorted((r["rank"], r["seq"], r["top"]) for r in got if r["k"] == k)
        assert mine == [(i + 1, s, want[-1]) for i, s in enumerate(want)]
