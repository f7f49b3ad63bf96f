"""Nearest neighbours, lexical scores and lookups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.operators import context as C, knn as K, lexical as L, lookup as Q
from mailspark.operators.embed import BatchEncoder, HashedEncoder, embed_mails, unit_vectors, weighed_words
from mailspark.operators.merge import Merged
from mailspark.operators.rows import as_text, context_rows, full_text_rows
from mailspark.operators import cells
from mailspark.sinks.store import add_mails, index_mailboxes, manifest, read_index, write_index


@pytest.fixture(scope="module")
def points():
    """Vectors of which a third are copies of one, and questions next to and far from it."""
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(600, 16)).astype(np.float32)
    vecs[::3] = vecs[0]
    asks = np.vstack([vecs[:1], vecs[1:20], rng.normal(size=(30, 16))]).astype(np.float32)
    return vecs, asks


def frames(spark, points):
    vecs, asks = points
    v = spark.createDataFrame([(f"m{i % 5}", i, v.tolist()) for i, v in enumerate(vecs)], "mbox string, seq long, embedding array<float>")
    q = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(asks)], "query_id long, embedding array<float>")
    return v.repartition(5), q


def brute(points, k):
    vecs, asks = (x.astype(np.float64) for x in points)
    out = {}
    for i, a in enumerate(asks):
        dist = ((vecs - a) ** 2).sum(axis=1)
        order = sorted(range(len(vecs)), key=lambda j: (dist[j], f"m{j % 5}", j))[:k]
        out[i] = [(f"m{j % 5}", j) for j in order]
    return out


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["mbox"], r["seq"]))
    return out


@pytest.mark.parametrize("question_block,vector_block", [(16, 70), (4096, 20_000)])
def test_exact_neighbours(spark, points, question_block, vector_block):
    v, q = frames(spark, points)
    for k in (1, 5):
        assert hits(K.knn(v, q, k, ["mbox", "seq"], question_block, vector_block)) == brute(points, k)


def test_fewer_vectors_than_k(spark, points):
    v, q = frames(spark, points)
    found = K.knn(v.where("seq < 3"), q, 5, ["mbox", "seq"])
    assert {len(h) for h in hits(found).values()} == {3}
    assert K.knn(v, q.where("false"), 5, ["mbox", "seq"]).count() == 0


def test_hashed_neighbours(spark, points, monkeypatch):
    monkeypatch.setattr(K, "QUESTION_BLOCK", 16)
    monkeypatch.setattr(K, "VECTOR_BLOCK", 70)
    v, q = frames(spark, points)
    got = hits(K.knn_lsh(v, q, 5, ["mbox", "seq"], tables=12, bucket_length=3.0))
    want = brute(points, 5)
    recall = np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in want.items()])
    assert recall > 0.8
    # a question equal to a vector always meets it
    assert all(got[i][0] == want[i][0] for i in range(20))


def merged_rows(spark, n=90):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append({
            "mbox": f"m{i % 4}", "seq": i, "piece": 0, "members": 1, "subject": "s", "pr_numbers": [i % 12, 1000 + i],
            "pr_title": rng.choice(["Fix crash", "slow QUERY", None]), "repos": rng.choice([["o/r"], None]),
            "tickets": rng.choice([["AB-1", "AB-12"], None]), "body": f"body {i}",
            "commits": [{"sha": f"{i:07x}abc", "short": f"{i:07x}", "message": "note"}] if i % 2 else None,
            "files_modified": rng.choice([["src", "a", "x.py", ""], None]), "tags": ["bug"] if hot else ["ui", "api"],
            "contributors": rng.choice([["bob"], ["é-x"], None]),
        })
    heads = spark.createDataFrame(
        [[r[c] for c in ("mbox", "seq", "members", "subject", "pr_numbers", "pr_title", "tags")] for r in rows],
        "mbox string, seq long, members long, subject string, pr_numbers array<long>, pr_title string, tags array<string>",
    )
    values = [
        (r["mbox"], r["seq"], f, x, None) for r in rows for f in ("repos", "tickets", "files_modified", "contributors") for x in r[f] or []
    ] + [(r["mbox"], r["seq"], "commits", c["sha"], c["message"]) for r in rows for c in r["commits"] or []]
    markdown = [(r["mbox"], r["seq"], "lists", 1, 0, "- item") for r in rows if r["seq"] % 2]
    return rows, Merged(
        heads, spark.createDataFrame(values, "mbox string, seq long, field string, value string, detail string"),
        spark.createDataFrame(markdown, "mbox string, seq long, key string, rank long, item int, text string"),
        spark.createDataFrame([(r["mbox"], r["seq"], 1, r["body"]) for r in rows], "mbox string, seq long, rank long, body string"),
    )


QUESTIONS = [
    (1, "bug in O/R src for pr #1005"), (2, "slow query é-x AB-12"), (3, ""), (4, "nothing zzz"), (5, "0000003abc x.py bug ui"),
] + [(10 + i, "a bug, everyone asks") for i in range(20)]


def score(question, r):
    q = question.lower()
    has = lambda xs: sum(1 for x in xs or [] if x and x.lower() in q)
    return (
        6 * has(map(str, r["pr_numbers"])) + 3 * has(r["repos"]) + 2 * has(r["tickets"])
        + 4 * has([c["short"] for c in r["commits"] or []]) + 4 * has(r["files_modified"])
        + 5 * has([r["pr_title"]]) + 2 * has(r["tags"]) + 2 * has(r["contributors"])
    )


def test_lexical_top(spark):
    rows, merged = merged_rows(spark)
    questions = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    got = {}
    for r in L.lexical_top(L.mail_values(merged), questions, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["mbox"], r["seq"], r["score"]))
    for qid, text in QUESTIONS:
        scored = [(r["mbox"], r["seq"], float(score(text, r))) for r in rows]
        want = sorted([s for s in scored if s[2] > 0], key=lambda s: (-s[2], s[0], s[1]))[:7]
        assert got.get(qid, []) == want


def test_lexical_score_of_pairs(spark):
    rows, merged = merged_rows(spark)
    questions = spark.createDataFrame(QUESTIONS[:5], "query_id long, text string")
    pairs = merged.heads.select((F.pmod("seq", F.lit(5)) + 1).alias("query_id"), "mbox", "seq")
    got = {r["seq"]: r["score"] for r in L.lexical_scores(L.mail_values(merged), questions, pairs).collect()}
    texts = dict(QUESTIONS)
    assert got == {r["seq"]: score(texts[r["seq"] % 5 + 1], r) for r in rows}


def test_lookups_and_contexts(spark):
    rows, merged = merged_rows(spark)
    asks = [(1, "pr #5"), (2, "pr 5 again"), (3, "0000003"), (4, "0000003ab"), (5, "pr #777777"), (6, "0000005abc"), (7, "hello"), (8, "pr #0")]
    routed = Q.routes(spark.createDataFrame(asks, "query_id long, text string")).cache()
    modes = {r["query_id"]: r["mode"] for r in routed.collect()}
    assert modes == {1: "pr", 2: "pr", 3: "commit", 4: "commit", 5: "pr", 6: "commit", 7: "semantic", 8: "semantic"}
    prs, commits = Q.mail_pr(merged.heads), Q.mail_commit(merged.values)
    assert {(r["query_id"], r["seq"]) for r in Q.pr_lookup(routed, prs).collect()} == {
        (qid, r["seq"]) for qid in (1, 2) for r in rows if 5 in r["pr_numbers"]
    }
    assert {(r["query_id"], r["seq"]) for r in Q.commit_lookup(routed, commits).collect()} == {(3, 3), (6, 5)}
    prefix = Q.commit_lookup(routed, commits, prefix=True).collect()
    assert {(r["query_id"], r["seq"]) for r in prefix} == {(3, 3), (4, 3), (6, 5)}
    assert {r["query_id"] for r in Q.lookup_misses(routed, prs, commits).collect()} == {4, 5}

    near = spark.createDataFrame([(7, "m2", 2, 2), (7, "m0", 0, 1)], "query_id long, mbox string, seq long, position int")
    contexts = C.answer_contexts(routed, prs, commits, context_rows(merged), near)
    blocks = {(r["mbox"], r["seq"]): r["text"] for r in as_text(context_rows(merged), ["mbox", "seq"]).collect()}
    with_five = sorted((r["mbox"], r["seq"]) for r in rows if 5 in r["pr_numbers"])
    ruler = "\n\n============================\n\n"
    prompts = {r["query_id"]: r["prompt"] for r in C.prompt_texts(contexts).collect()}
    task = "You are an expert PR analyst.\nSummarize PR #5 using ONLY the context below.\n\n"
    assert prompts[1] == prompts[2] == task + ruler.join(blocks[m] for m in with_five)
    assert prompts[7].endswith("context below.\n\n" + blocks["m0", 0] + ruler + blocks["m2", 2])
    assert set(prompts) == {1, 2, 3, 6, 7}
    as_rows = C.prompts(contexts).where("query_id = 1").orderBy("position", "mbox", "seq", "section", "rank", "item", "text").collect()
    assert as_rows[0]["text"] == task and {(r["mbox"], r["seq"]) for r in as_rows[1:]} == set(with_five)


def test_rendered_text(spark):
    _, merged = merged_rows(spark, 4)
    of = lambda rows: as_text(rows.where("seq = 3"), ["mbox", "seq"]).first()["text"]
    full, context = of(full_text_rows(merged)), of(context_rows(merged))
    assert full.startswith("Tags: bug\n\n") and full.endswith("\n\nbody 3")
    assert "PR Numbers: 3, 1003" in full and "0000003,note" in full
    assert "Commits:\n- 0000003 note" in context and context.endswith("Email Body:\nbody 3")
    assert "\n\nMarkdown Sections:\n## lists\n- - item\n\n" in context


def test_encoders(spark):
    rows, merged = merged_rows(spark, 20)
    native = HashedEncoder(full_text_rows(merged))
    vecs = native.mails().collect()
    assert len(vecs) == 20 and all(len(r["embedding"]) == 64 and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-4 for r in vecs)
    asks = spark.createDataFrame([(1, "bug body 3"), (2, "..."), (3, "unheard of")], "query_id long, text string")
    assert {r["query_id"] for r in native.questions(asks).collect()} == {1, 3}

    def make_predict():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("bug")] for t in texts], dtype=np.float32)

    given = embed_mails(merged, BatchEncoder(make_predict, batch_size=4)).collect()
    assert len(given) == 20 and all(len(r["embedding"]) == 2 and r["embedding"][0] > 0 for r in given)


def test_index_of_mailboxes(spark, tmp_path):
    box = tmp_path / "in" / "r.mbox"
    box.mkdir(parents=True)
    head = "From x Mon Jan  1 00:00:00 2024\nSubject: "
    (box / "mbox").write_text(f"{head}[o/r] Fix (PR #7)\n\none\n\n{head}Re: (PR #7)\n\nabcdef1 two\n\n{head}none\n\nthree\n")
    index_mailboxes(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    tables = read_index(spark, str(tmp_path / "out"))
    heads = tables["merged_heads"].collect()
    assert len(heads) == 1 and heads[0]["members"] == 2
    assert [r["body"].strip() for r in tables["merged_texts"].orderBy("rank").collect()] == ["one", "abcdef1 two"]
    assert tables["mail_pr"].collect() == [(7, "r", 0)]
    assert {r["key"] for r in tables["mail_commit"].collect()} == {"abcdef1", "two"}
    assert tables["vectors"].count() == 1
    assert tables["mails"].count() == 3


def test_cells(spark, points, tmp_path):
    v, q = frames(spark, points)
    index = cells.write_cells(v, str(tmp_path / "cells"), cells=20, block=50)
    assert index.vectors.select("mbox", "seq").distinct().count() == 600
    exact = brute(points, 5)
    found = {i: [] for i in exact}
    for r in cells.knn_cells(index, q, 5, probe=1.0).orderBy("rank").collect():
        found[r["query_id"]].append((r["mbox"], r["seq"]))
    assert all(len(f) == 5 for f in found.values())
    # Copies have equal distances, so that distances and not ids are compared.
    vecs, asks = (x.astype(np.float64) for x in points)
    away = lambda i, hits: [round(float(((vecs[s] - asks[i]) ** 2).sum()), 6) for _, s in hits]
    assert all(away(i, found[i]) == away(i, exact[i]) for i in exact)
    few = cells.knn_cells(index, q.where("query_id < 2"), 5, probe=0.2)
    assert few.where("rank = 1").count() == 2
    assert cells.compared(index, q, 0.2).first()["codes"] < cells.compared(index, q, 1.0).first()["codes"]


def test_probing_reads_probed_folders_only(spark, points, tmp_path):
    v, q = frames(spark, points)
    index = cells.write_cells(v, str(tmp_path / "cells"), cells=20)
    asked = cells.probes(index, q.where("query_id = 30"), 0.1)
    stored = cells.probed_vectors(index, asked)
    assert stored.select("cell").distinct().count() == 2 < index.vectors.select("cell").distinct().count()
    assert "PartitionFilters: [cell" in stored._jdf.queryExecution().toString()


def test_cells_without_vectors(spark, tmp_path):
    v = spark.createDataFrame([("m", 1, None)], "mbox string, seq long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.5, 0.5])], "query_id long, embedding array<float>")
    assert cells.knn_cells(cells.write_cells(v, str(tmp_path / "none")), q).count() == 0


def mails_of(spark, boxes):
    from mailspark.operators.extract import extract

    rows = [(b, i, f"[o/{b}] Fix crash (PR #{i % 3 + 1}) TCK-{i}", "a@x", "d", "<i>", f"word{i} common body of {b}") for b in boxes for i in range(6)]
    return extract(spark.createDataFrame(rows, "mbox string, seq long, subject string, sender string, date string, message_id string, body string"))


def test_added_mailboxes_equal_a_whole_index(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write_index(mails_of(spark, "abc"), one)
    write_index(mails_of(spark, "ac"), two)
    before = read_index(spark, two)
    with pytest.raises(ValueError, match="already"):
        add_mails(mails_of(spark, "cd"), two)
    add_mails(mails_of(spark, "b"), two)
    whole, grown = read_index(spark, one), read_index(spark, two)
    for name in whole:
        rows = lambda t: sorted(map(repr, t.collect()))
        assert rows(whole[name]) == rows(grown[name]), name
    assert before["mails"].count() == 12 and {r["generation"] for r in manifest(spark, two)} == {1}


def test_unfinished_index_is_refused(spark, tmp_path, monkeypatch):
    from mailspark.sinks import store

    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no finished index"):
        read_index(spark, out)

    def stopped(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(store, "finish", stopped)
    with pytest.raises(RuntimeError):
        write_index(mails_of(spark, "a"), out)
    with pytest.raises(ValueError, match="no finished index"):
        read_index(spark, out)


def test_questions_read_no_mail_text(spark, tmp_path):
    from mailspark.sinks.store import terms_in

    write_index(mails_of(spark, "ab"), str(tmp_path / "out"))
    terms = terms_in(read_index(spark, str(tmp_path / "out")))
    asks = spark.createDataFrame([(1, "common crash word1")], "query_id long, text string")
    plan = HashedEncoder(terms).questions(asks)._jdf.queryExecution().toString()
    assert "terms_frequency" in plan and "merged_" not in plan and "/mails" not in plan


def test_budget(spark):
    rng = random.Random(3)
    columns = "query_id long, mode string, key string, position int, mbox string, seq long, section int, label string, rank long, item int, text string"
    rows = []
    for query in range(3):
        for mail in range(3):
            rows += [(query, "pr", "1", 0, "m", mail, 1, "Tags: ", 0, 0, "bug")]
            rows += [(query, "pr", "1", 0, "m", mail, 6, "Commits:", 0, 0, f"- {i:03}") for i in range(rng.randrange(30))]
            rows += [(query, "pr", "1", 0, "m", mail, 12, C.BODY, r, 0, "x" * rng.randrange(1, 90)) for r in range(1, 40)]
    df = spark.createDataFrame(rows, columns).repartition(7)

    def by_hand(budget, max_body):
        out = []
        for query in range(3):
            used, body, open_ = 0, {}, True
            for r in sorted((r for r in rows if r[0] == query), key=lambda r: r[3:7] + r[8:]):
                text = r[-1]
                if max_body is not None and r[7] == C.BODY:
                    room = max_body - body.get(r[4:6], 0)
                    body[r[4:6]] = body.get(r[4:6], 0) + len(text) + 2
                    if room <= 0:
                        continue
                    text = text[:room]
                open_ = open_ and used + len(text) <= budget
                used += len(text) + 1
                if open_:
                    out.append((*r[:-1], text))
        return sorted(map(repr, out))

    for budget, body, span in ((500, None, 2), (3_000, 200, 2), (3_000, 200, 1_024), (2, 0, 8)):
        got = sorted(repr(tuple(r)) for r in C.budgeted(df, budget, body, span).collect())
        assert got == by_hand(budget, body), (budget, body, span)
    assert all(len(r["prompt"]) < 3_500 for r in C.budgeted_prompts(df, 2_000, 200).collect())


def test_widened_questions_find_what_their_hits_are_about(spark):
    from mailspark.operators import expand
    from mailspark.operators.embed import terms_of

    _, merged = merged_rows(spark, 30)
    terms = terms_of(full_text_rows(merged))
    asks = spark.createDataFrame([(1, "pr 1003"), (2, "nothing known")], "query_id long, text string")
    hits = L.lexical_top(L.mail_values(merged), asks, 3)
    added = expand.expansion(hits, expand.entity_rows(merged), terms).collect()
    assert {r["query_id"] for r in added} == {1} and "1003" in {r["word"] for r in added}
    assert abs(sum(r["w"] ** 2 for r in added) - 0.25) < 1e-9
    vectors = expand.augmented_questions(asks, spark.createDataFrame(added), terms).collect()
    assert {r["query_id"] for r in vectors} == {1, 2}


def test_budgeted_answers_are_those_of_whole_contexts(spark):
    rng = random.Random(5)
    rows = []
    for mail in range(4):
        rows += [("m", mail, 1, "Tags: ", 0, 0, "bug")] + [("m", mail, 6, "Commits:", 0, 0, f"- {i:07}") for i in range(rng.randrange(300))]
        rows += [("m", mail, 9, "## lists", r, i, "- " + "y" * rng.randrange(60)) for r in range(1, 50) for i in range(rng.randrange(3))]
        rows += [("m", mail, 12, C.BODY, r, 0, "x" * rng.randrange(1, 90)) for r in range(1, 400)]
    rows = spark.createDataFrame(rows, "mbox string, seq long, section int, label string, rank long, item int, text string").repartition(5)
    asked = [(1, "pr", "7", 0, "m", s) for s in (0, 1, 2)] + [(2, "semantic", None, 3 - s, "m", s) for s in (1, 2, 3)] + [(3, "pr", "8", 0, "m", 1)] * 2
    hits = spark.createDataFrame(asked, "query_id long, mode string, key string, position int, mbox string, seq long")
    for budget, body in ((300, None), (2_000, 200), (9_000, 500), (60_000, None), (5, 0)):
        got, whole = C.budgeted_answers(hits, rows, budget, body), C.budgeted_prompts(C.contexts_of(hits, rows), budget, body)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect())), (budget, body)
    # A body of 400 texts and a list of hundreds of items give the first few blocks only.
    assert C.first_rows(hits, rows, 300, 100).count() < 4 * 120 < rows.count()


def test_few_hits_move_no_text(spark, tmp_path):
    from mailspark.sinks.scratch import store

    _, merged = merged_rows(spark, 60)
    merged = merged.map(lambda name, table: store(table, str(tmp_path / name)))
    routed = store(Q.routes(spark.createDataFrame([(1, "pr 1003"), (2, "PR #1005 and more"), (3, "other")], "query_id long, text string")), str(tmp_path / "routes"))
    near = merged.heads.select(F.lit(3).cast("long").alias("query_id"), "mbox", "seq", F.lit(1).alias("position")).limit(2)
    hits = store(C.context_hits(routed, Q.mail_pr(merged.heads), Q.mail_commit(merged.values), near), str(tmp_path / "hits"))
    contexts = C.contexts_of(hits, context_rows(merged))
    assert {r["query_id"] for r in contexts.collect()} == {1, 2, 3}
    plan = contexts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_words_of_members_are_those_of_rendered_rows(spark, tmp_path):
    from mailspark.operators.embed import word_counts
    from mailspark.operators.extract import extract
    from mailspark.operators.merge import members, merge_by_pr
    from mailspark.operators.rows import word_rows
    from mailspark.sinks.scratch import store

    text = "# Notes (v1)\n- Ärger über x_1\r\n\n* und\tmehr sonar  \n```sql\nselect 1\n```\nSummary (v2)\nabc1234 Das ΌΔΟΣ\n"
    raw = spark.range(12).select(
        F.lit("box").alias("mbox"), F.col("id").alias("seq"), F.concat(F.lit("[o/r] Fix crash (PR #"), F.col("id") % 5, F.lit(") TCK-1 @dev")).alias("subject"),
        F.lit("a@b").alias("sender"), F.lit("").alias("date"), F.lit("<x>").alias("message_id"),
        F.when(F.col("id") % 7 == 3, "").otherwise(F.concat(F.lit(text), F.col("id"))).alias("body"),
    )
    mails = store(extract(raw), str(tmp_path / "mails"))
    who = store(members(mails), str(tmp_path / "members"))
    merged = merge_by_pr(mails, who, union_markdown=True, skip_sonar=True)
    assert word_rows(merged).count() < full_text_rows(merged).count()
    got, want = (sorted(map(repr, word_counts(rows, ["mbox", "seq"]).collect())) for rows in (word_rows(merged), full_text_rows(merged)))
    assert got == want and got


@pytest.mark.parametrize("union", [False, True])
def test_words_of_sections_are_counted_in_the_body(spark, tmp_path, union):
    from mailspark.operators.embed import word_counts
    from mailspark.operators.extract import extract
    from mailspark.operators.merge import members, merge_by_pr
    from mailspark.operators.rows import word_rows
    from mailspark.sinks.scratch import store

    bodies = [
        "plain words x_1", "# Summary (kept)\nwords", "Summary (gone Ärger)\r\nmore\x0bSUMMARY(v1)  \nSummary", "", None, " \n\t",
        "##  \n#x\n1. one\n```\ncode ΌΔΟΣ\n```\nWhat changed? (a) (b)\nΌΔΟΣ", "Description of (it)\nchangelog\u2028File Changes (x)\u00a0\n(y)",
    ]
    # One request of all bodies, one without the blank ones, the latter twice; their words are those of the rendered rows.
    rows = [("box", i, f"[o/r] Fix (PR #{pr})", "a@b", "", "<x>", body) for i, (pr, body) in enumerate(
        [(1, b) for b in bodies] + [(2, b) for b in bodies * 2 if b and b.strip()])]
    raw = spark.createDataFrame(rows, "mbox string, seq long, subject string, sender string, date string, message_id string, body string")
    mails = store(extract(raw), str(tmp_path / "mails"))
    who = store(members(mails), str(tmp_path / "members"))
    # Mails that were not extracted here bring their sections' text.
    for given in (mails, mails.drop("heading_rest")):
        merged = merge_by_pr(given, who, union_markdown=union)
        got, want = (sorted(map(repr, word_counts(r, ["mbox", "seq"]).collect())) for r in (word_rows(merged), full_text_rows(merged)))
        assert got == want and got
        assert (",headings:" in merged.members._jdf.queryExecution().executedPlan().toString()) == (given is not mails)


def test_searches_write_no_mail_text(spark, monkeypatch):
    from mailspark.plans import registry

    written, plain = [], registry.store
    monkeypatch.setattr(registry, "store", lambda df, path: written.append(path.rsplit("/", 1)[1]) or plain(df, path))
    registry.searched_mails(spark, "/root/testdata/sf0.001")
    assert written == ["heads", "values"]


def test_distances_are_held_in_slices(spark, points, tmp_path, monkeypatch):
    v, q = frames(spark, points)
    whole = hits(cells.knn_cells(cells.write_cells(v, str(tmp_path / "a"), cells=20), q, 5))
    monkeypatch.setattr(cells, "PAIRS", 300)
    cut = hits(cells.knn_cells(cells.write_cells(v, str(tmp_path / "b"), cells=20), q, 5))
    assert cut == whole
    monkeypatch.undo()
    for rows, width in ((10_000, 4_096), (4_096, 20_000), (3, 10**9), (5, 0)):
        slices = cells._slices(rows, width)
        assert [i for s in slices for i in range(rows)[s]] == list(range(rows))
        assert all(len(range(rows)[s]) * width <= max(cells.PAIRS, width) for s in slices)


def test_vectors_need_no_sections(spark, tmp_path):
    from mailspark.functions import body as B, tags as T
    from mailspark.plans import registry as R

    bodies = ["Intro db\n# Notes on API\n- Item\r\n\nSummary (v1)\nfix", "## only", "", None, "\n \n", "x Description\ny ŻÓŁW", "Changelog\nChangelog (2)\nz"]
    rows = [(i, bodies[i % 7], "en", f"s{i % 2}", len(bodies[i % 7] or "")) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    texts = spark.createDataFrame([(b or "",) for b in bodies], "body string").select(B.body_lines(F.col("body")).alias("lines"))
    both = texts.select(T.lines_text(F.col("lines")).alias("a"), T.sections_text(B.sections_of_lines(F.col("lines"))).alias("b"), F.size("lines").alias("n"))
    assert all(r["a"] == (r["b"] or "") and (r["b"] is not None or r["n"] == 0 or not r["a"]) for r in both.collect())
    merged, whole = R.searched_mails(spark, str(tmp_path)), R.stored_merged(spark, str(tmp_path))
    # Neither built nor written, so no reader can take their absence for their content.
    assert merged.markdown is None and whole.markdown.where("key = 'headings'").count() > 0
    encoders = [HashedEncoder(R.stored_terms(m)) for m in (merged, whole)]
    got, want = (sorted(map(tuple, e.mails().collect())) for e in encoders)
    assert got == want and len(got) > 20
    # A word's place is worked out once, beside its frequency, not once a mail.
    plan = encoders[0].mails()._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Aggregate") < plan.index("Join") < plan.index("md5(")
    assert [(m, [round(x, 5) for x in v]) for *m, v in got] == [
        (m, [round(x, 5) for x in v]) for *m, v in sorted(map(tuple, unit_vectors(weighed_words(encoders[0].terms.counts, encoders[0].terms), ["mbox", "seq"]).collect()))
    ]
