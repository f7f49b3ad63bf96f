"""Operators over whole tables against brute force and edge cases, and the pipeline."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from mailspark.llm import decontaminate, line_dedup, mixing, near_dup, sharding
from mailspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, key int, block int, slot string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, "x") for i, t, s in rows], DOC)


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def variants(rng, base, n, edits):
    """Texts that drift apart: each is an earlier one with a few words changed."""
    out = [list(base)]
    for _ in range(n):
        t = list(rng.choice(out))
        for _ in range(edits):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append(t)
    return out


def corpus(rng):
    """Groups of copies and drifting copies, a passage that many share, short and odd texts."""
    texts = [" ".join(words(rng, rng.randint(1, 80))) for _ in range(80)]
    texts += [" ".join(t) for t in variants(rng, words(rng, 60), 150, 1)]
    passage = words(rng, 40)
    texts += [" ".join(words(rng, rng.randint(5, 20)) + passage + words(rng, 5)) for _ in range(60)]
    texts += [texts[90].upper()] * 5 + ["one two three"] * 3 + ["", None, " \n", "x", "x y", "X", "a b c d", "a  b\nc d"]
    texts += [" ".join(words(rng, 30_000))] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [(i, t, rng.choice(["a", "a", "b", None])) for i, t in rows]


# --- 4: near-duplicates -----------------------------------------------------------------


def brute_components(rows, n, percent=80):
    parent = {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t, n) for i, t, _ in rows}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    # Small limits, so that all three ways of the completion are taken.
    for name, value in (("FEW", 6), ("CELL", 8), ("OUTSIDE_BLOCK", 8), ("BLOCK", 16), ("MOST_OUTSIDE", 12), ("STAR_MATCHES", 60)):
        monkeypatch.setattr(near_dup, name, value)
    rows = corpus(random.Random(8))
    out = near_dup.op4_components(spark, docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute_components(rows, 4)
    assert len(out) == len(rows)


def test_near_duplicates_edges(spark):
    rows = [(1, "same words in here today", "a"), (1, "same words in here today", "a"), (None, "Same words in here today", "a"), (7, None, "b"), (8, "", "b")]
    out = near_dup.op4_components(spark, docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in out) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (7, 0, 7), (8, 0, 8)]
    assert near_dup.op4_components(spark, docs(spark, [])).count() == 0
    left = near_dup.one_of_each(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [1, 7, 8]
    assert near_dup.one_of_each(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus(random.Random(9))
    want = brute_components(rows, 5)
    assert {r["doc_id"] for r in near_dup.one_of_each(docs(spark, rows)).collect()} == {i for i, (_, _, kept) in want.items() if kept}


# --- 3: contamination -------------------------------------------------------------------


def test_contamination_by_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.randint(1, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "lone"), (3, "twice the same id here now")]
    rows = []
    for i in range(120):
        text = words(rng, rng.randint(0, 4000))
        for _, t in rng.sample(items[:40], 2):
            part = t.split()
            at = rng.randint(0, len(text))
            k = rng.choice([0, 0, 1, len(part) // 2])
            text[at:at] = part[k:] if rng.random() < 0.8 else part[: len(part) // 3] + words(rng, 3) + part[len(part) // 3 :]
        rows.append((i, " ".join(text), "s"))
    rows += [(200, None, "s"), (201, "Lone", "s"), (None, items[0][1], "s"), (202, "", "s")]
    want = set()
    for i, t, _ in rows:
        s = shingles(t, 5)
        for j, x in items:
            q = shingles(x, 5)
            if q and len(q & s) * 100 >= 80 * len(q):
                want.add((i, j, len(q & s)))
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    out = decontaminate.contaminations(docs(spark, rows), table).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in out} == want and len(out) == len(want)
    left = decontaminate.without_contaminated(docs(spark, rows), table)
    assert {r["doc_id"] for r in left.collect()} == {i for i, *_ in rows} - {i for i, *_ in want}
    assert left.columns == docs(spark, rows).columns
    assert decontaminate.contaminations(docs(spark, rows), table.where("false")).count() == 0
    assert decontaminate.contaminations(docs(spark, []), table).count() == 0


def test_items_of_few_shingles(spark):
    """An item of one or two shingles inside a long document is always found."""
    rng = random.Random(8)
    rows, items = [], []
    for i in range(600):
        text, n = words(rng, 120, 10**6), 5 + i % 3
        at = rng.randrange(110)
        rows.append((i, " ".join(text), "s"))
        items.append((i, " ".join(text[at : at + n])))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.op3_contaminations(spark, docs(spark, rows), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(i, i) for i in range(600)]


# --- 7: shards --------------------------------------------------------------------------


def test_communication_matrix():
    rng = random.Random(1)
    sizes = [rng.randrange(50) for _ in range(40)] + [0, 10_000]
    matrix = sharding.communication_matrix(sizes, 7, 3)
    assert [sum(r) for r in matrix] == sizes
    columns = [sum(c) for c in zip(*matrix)]
    assert max(columns) - min(columns) <= 1


def test_hypergeometric_law():
    rng = random.Random(2)
    draws = [sharding.hypergeometric(rng, 6, 14, 5) for _ in range(20_000)]
    from math import comb

    for k in range(6):
        assert abs(draws.count(k) / 20_000 - comb(6, k) * comb(14, 5 - k) / comb(20, 5)) < 0.015
    big = [sharding.hypergeometric(rng, 10**10, 2 * 10**10, 30_000) for _ in range(200)]
    assert abs(sum(big) / 200 - 10_000) < 60


def test_shards(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.choice(["a", None, "bb"]), "s") for _ in range(1000)] + [(None, "z", None)] * 301
    out = sharding.shard(docs(spark, rows), n_shards=8, blocks=32).collect()
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert sorted(map(len, shards.values())) == [162] * 3 + [163] * 5
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t) for i, t, _ in rows)
    assert sharding.shard(docs(spark, [])).count() == 0
    few = sharding.shard(docs(spark, rows[:3]), n_shards=8).collect()
    assert sorted(r["slot"] for r in few) == [0, 0, 0]


def test_shard_query(spark):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_hypergeometric_shards"](spark, SF).collect():
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)


# --- 8: lines ---------------------------------------------------------------------------


def brute_removed(rows):
    seen, order, removed = {}, [], set()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(w for w in re.split(r"[\x09-\x0D ]+", line) if w)
            if s and s in seen:
                removed.add((i, k))
            elif s:
                if any(100 * len(s & x) >= 80 * len(s | x) for x in order):
                    removed.add((i, k))
                seen[s] = (i, k)
                order.append(s)
    return removed


def test_lines_by_brute_force(spark):
    rng = random.Random(6)
    lines = [" ".join(words(rng, rng.randint(0, 30), 200)) for _ in range(150)] + ["", "  ", "a", "a b c", "a b c d", "a b c d e", "c  b a"]
    lines += [" ".join(t) for t in variants(rng, words(rng, 40), 60, 2)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))), "s") for i in range(150)]
    rows += [(500, None, "s"), (501, "", "s"), (None, lines[0] + "\nfresh line", "s"), (502, " ".join(words(rng, 20_000, 50_000)), "s")]
    rng.shuffle(rows)
    table = docs(spark, rows)
    removed = line_dedup.removed_lines(table).collect()
    want = brute_removed(rows)
    assert {tuple(r) for r in removed} == want and len(removed) == len(want)
    out = {r["doc_id"]: r for r in line_dedup.without_removed(table, line_dedup.removed_lines(table)).collect()}
    for i, t, _ in rows:
        kept = t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)
        assert out[i]["text"] == kept
    assert line_dedup.op8_removed(spark, table).count() == len(rows)
    assert line_dedup.op8_removed(spark, docs(spark, [])).count() == 0


def test_lines_are_cut_once_and_settled_by_one_match(spark, monkeypatch):
    rng = random.Random(16)
    near = variants(rng, words(rng, 40), 30, 1)
    blanks = ["a\tb\x0bc \x0c d", " d c\rb  a", "\t \x0b", "e\x1cf e"]
    rows = [(i, "\n".join([" ".join(t), rng.choice(blanks)]), "s") for i, t in enumerate(near)]
    rounds, real = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *more: rounds.append(pairs.select("a", "b").collect()) or real(pairs, *more))
    removed = line_dedup.removed_lines(docs(spark, rows))
    assert {tuple(r) for r in removed.collect()} == brute_removed(rows)
    first, second = [Counter(r["b"] for r in pairs) for pairs in rounds]
    # One pair of each class is verified first; what it settles is not verified again.
    assert set(first.values()) == {1} and len(first) > 20 and sum(second.values()) < len(first)
    # The lines were written: removing them cuts no text again.
    assert "explode" not in removed._jdf.queryExecution().toString().lower()


def test_near_copies_do_not_meet_by_the_square(spark, monkeypatch):
    rng = random.Random(26)
    near = [variants(rng, base, 1, 2)[1] for base in (words(rng, 40), words(rng, 61)) for _ in range(400)]
    rows = [(i, "\n".join([" ".join(t), " ".join(words(rng, 12, 300))]), "s") for i, t in enumerate(near)]
    met, real = [], line_dedup.candidate_pairs
    monkeypatch.setattr(line_dedup, "candidate_pairs", lambda *args: met.append(real(*args)) or met[-1])
    removed = {tuple(r) for r in line_dedup.removed_lines(docs(spark, rows)).collect()}
    want = brute_removed(rows)
    assert removed == want and len(want) > 700
    # All pairs of the two groups are some 160,000.
    assert met[0].count() < 40 * len(rows)


# --- 9: mixing --------------------------------------------------------------------------


def test_period_schedule_is_fair():
    for weights in ({"a": 1}, {"a": 5, "b": 3, "c": 0.1}, {i: 1 + i % 7 for i in range(50)}):
        parts = mixing.shares(weights, 1024)
        slots = mixing.period_schedule(parts, 1024)
        assert sum(parts.values()) == 1024 and sorted(x for s in slots.values() for x in s) == list(range(1024))
        for s, own in slots.items():
            had = 0
            for t in range(1025):
                assert abs(had - t * parts[s] / 1024) < 1
                had += t in set(own[had : had + 1])


def test_mixture(spark):
    rows = [(i, f"t{i % 50}", "hot" if i % 3 else ["a", "b", None][i % 9 // 3]) for i in range(3000)] + [(5, "again", "a")] * 40
    table = docs(spark, rows)
    weights = {"hot": 1.0, "a": 1.0, "b": 2.0, None: 0.5}
    mixed = mixing.positions(mixing.schedule(table, weights, block=8)).collect()
    assert sorted(r["position"] for r in mixed) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in mixed) == Counter(rows)
    parts = mixing.shares(weights, mixing.PERIOD)
    blocks = defaultdict(set)
    for r in mixed:
        assert r["release"] <= r["slot"] < r["deadline"]
        blocks[r["source"]].add(r["slot"])
    # Until a source runs out, each has had its share of blocks, less than one off.
    end = min(max(s) for s in blocks.values())
    for t in range(0, end, 5):
        for s, own in blocks.items():
            assert abs(sum(x < t for x in own) - t * parts[s] / mixing.PERIOD) < 1
    assert mixing.schedule(docs(spark, []), {}).count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        mixing.schedule(table, {"hot": 1.0}).collect()


def test_shares_are_the_weights_given(spark):
    even = {"hot": 0.5} | {f"s{i}": 0.5 / 49 for i in range(49)}
    for weights in (even, {"a": 0.999, "b": 0.00033, "c": 0.00067}, {"a": 2**0.5, "b": 3**0.5, "c": 0.01}):
        total = sum(weights.values())
        slots = mixing.period_schedule(mixing.shares(weights, mixing.UNIT), mixing.UNIT, 10_000)
        for s, own in slots.items():
            own = set(own)
            had = 0
            for t in range(10_000):
                assert abs(had - t * weights[s] / total) < 1
                had += t in own
    # Over a table of more blocks than the former period.
    table = docs(spark, [(i, "t", "hot" if i % 2 else f"s{i // 2 % 49}") for i in range(4900)])
    out = mixing.schedule(table, even, block=1).select("source", "release", "slot", "deadline").collect()
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    for t in (1024, 2048, 4000):
        had = Counter(r["source"] for r in out if r["slot"] < t)
        assert all(abs(had[s] - t * w) < 1 for s, w in even.items())


def test_blocks_grow_with_the_table_and_the_bound_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SLOTS", 1 << 11)
    sources = ["hot", "hot", "hot", "a", "b", "b"]
    rows = [(i, f"t{i}", sources[i % 6]) for i in range(5000)] + [(9999, "one", "rare")]
    weights = {"hot": 0.3, "a": 2**0.5, "b": 1.1, "rare": 1e-9}
    out = mixing.positions(mixing.schedule(docs(spark, rows), weights, block=1)).collect()
    assert sorted(r["position"] for r in out) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter(rows)
    sizes = Counter(r[2] for r in rows)
    used = mixing.raised(weights)
    total = sum(used.values())
    parts = mixing.shares(used, mixing.UNIT)
    block, slots = mixing.fitting_block(sizes, parts, 1)
    assert block > 1 and slots <= 1 << 11
    owners = defaultdict(set)
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"] and r["block"] == r["rank_in_source"] // block
        owners[r["slot"]].add((r["source"], r["block"]))
    assert all(len(o) == 1 for o in owners.values())
    taken = {s: sorted(t for t, o in owners.items() if next(iter(o))[0] == s) for s in sizes}
    for s, own in taken.items():  # until it runs out
        for t in range(own[-1] + 1):
            assert abs(sum(x < t for x in own) - t * float(used[s] / total)) < 1
    # At any size the schedule stays within the slots that are worked out, and every block within its own.
    monkeypatch.undo()
    for n in (10**6, 10**8, 10**10, 10**12):
        sizes = {"hot": n // 3, "b": n // 2, "tiny": 3}
        weights = {s: k**0.5 for s, k in sizes.items()}
        parts = mixing.shares(mixing.raised(weights), mixing.UNIT)
        for repeat in (False, True):
            block, slots = mixing.fitting_block(mixing.rows_dealt(sizes, parts, repeat), parts, mixing.BLOCK)
            assert slots <= mixing.MOST_SLOTS and (n > 10**6 or block == mixing.BLOCK)
        assert min(mixing.epochs(sizes, weights).values()) >= 1


def test_mixed_order_is_the_order_of_the_table(spark, tmp_path):
    table = docs(spark, [(i, "t", "hot" if i % 4 else "b") for i in range(2000)])
    path = str(tmp_path / "mixed")
    scheduled = mixing.schedule(table, {"hot": 1.0, "b": 1.0}, block=4)
    mixing.in_mixed_order(scheduled).write.parquet(path)
    import glob

    import pyarrow.parquet as pq

    slots = [s for f in sorted(glob.glob(f"{path}/*.parquet")) for s in pq.read_table(f)["slot"].to_pylist()]
    assert slots == sorted(slots) and len(slots) == 2000


# --- the pipeline -----------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, before = table.columns, {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        after = {r["doc_id"]: tuple(r[c] for c in columns) for r in out.collect()}
        gone = set(before) - set(after)
        assert all(before[i] == r for i, r in after.items()), name
        texts = [(i, r[1], None) for i, r in before.items()]
        if name == "toxicity":
            assert sum(truth.get(i) == 0 for i in gone) <= 0.02 * len(truth)
        elif name == "near_duplicates":
            assert gone == {i for i, (_, _, kept) in brute_components(texts, 5).items() if not kept}
        elif name == "decontamination":
            items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert gone == {i for i, t, _ in texts if any(q and len(q & shingles(t, 5)) * 100 >= 80 * len(q) for q in items)}
        else:
            assert not gone
        if name != "sharding":
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        table, before = spark.read.parquet(path), after
    assert sorted(out.columns) == sorted([*columns, "shard", "slot"])


def test_mixing_stage_decides_the_shares(spark):
    sizes = {"hot": 2500, "a": 400, "b": 100, None: 1}
    rows = [(i, f"t{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    mixed = corpus_pipeline.mixing(spark, docs(spark, rows), None)
    for out in (mixed, corpus_pipeline.sharding(spark, mixed, None)):
        got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.select("doc_id", "text", "source").collect())
        assert set(got) == set(rows)
        had = Counter()
        for (_, _, s), n in got.items():
            had[s] += n
        # The root of a size, of 50 for the largest: 2500, 1000, 500 and 50 rows.
        assert all(abs(had[s] - 50 * n**0.5) <= 1 for s, n in sizes.items())
        for s in sizes:
            times = [n for (_, _, x), n in got.items() if x == s]
            assert max(times) - min(times) <= 1


def test_pipeline_run_and_empty_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    odd = docs(spark, [(1, None, None), (None, "", "a"), (2, "a clean text of some words", "a"), (2, "a clean text of some words", "a")])
    for table in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "/root/testdata/sf0.01")
            assert out.count() >= (3 if table is odd else 0)
