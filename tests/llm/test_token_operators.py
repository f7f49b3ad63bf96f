"""Hard negatives, BPE and fill-in-the-middle against brute force, the library, and edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from mailspark.llm import bpe, fim, hard_negatives
from mailspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, output string, ids string, _row int, form string, decoded string, n int"
ODD = [
    (1, "some words here. And more!\nA second line"), (2, None), (3, ""), (None, "no id at all"), (4, "same"), (4, "same"),
    (5, "é日本語😀" * 3), (6, "long " * 9_000), (7, "\x00 zero \x00"), (8, "   \n\t "), (9, "a <S> b"), (10, "x" * 40_000),
    (11, "<|endoftext|>a  <|endoftext|>" * 900 + "'ll"), (12, "日本語" * 9_000), (13, "   x\x1c y" * 2_000),
]


def docs(spark, rows):
    """Documents with further columns, some of whose names operators use inside."""
    return spark.createDataFrame([(i, t, "o", "i", 3, "f", "d", 5) for i, t in rows], DOC)


# --- 13: fill in the middle ------------------------------------------------------------


def by_hand(doc_id, text):
    """Form and output from the rule, with plain slices."""
    t, n = text or "", len(text or "")
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_fill_in_middle(spark):
    rows = ODD + [(i, f"text number {i} <with < signs>\n" * (i % 5 + 1)) for i in range(100, 400)]
    out = fim.fill_in_middle(docs(spark, rows)).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    assert got == sorted((repr(i), *by_hand(i, t)) for i, t in rows)
    assert {(r["doc_id"], r["back"]) for r in out} == {(i, t or "") for i, t in rows}
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


def test_units_of_several_code_points(spark):
    units = fim.regex.compile(r"(\X)*")
    n, form, a, size, output = fim.rewrite("éx👩‍👩‍👧", (1, 2, 0, 50), units)
    assert (n, form, a, size) == (3, "psm", 2, 1) and output == "<P>é<S>👩‍👩‍👧<M>x"
    # A text that is not made of units stays as it is.
    assert fim.rewrite("ab1", (1, 2, 0, 50), fim.regex.compile("([a-z])*"))[:2] == (0, "plain")


# --- 12: BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def merges():
    return bpe.Bpe(bpe.read_tokenizer(path("byte_bpe_50k.json")))


ATOMS = [
    "hello", " ", "  ", "\n", "'s", "'ll", "'", "l", "re", "日本語", "é", "!!!", "?!'", "123", " foo", "\t", "　", "\xa0", "😀",
    "a" * 50, "ab" * 30, "'ve", "<|endoftext|>", "<|endo", "\x1c", "ذلك", "==",
]


def test_tree_concatenation_equals_the_library(tokenizer, merges):
    rng = random.Random(3)
    for _ in range(600):
        atoms = rng.sample(ATOMS, rng.randint(1, 6))
        text = "".join(rng.choice(atoms) for _ in range(rng.choice([1, 4, 15, 60])))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(merges.encode(text), "<u4").tolist() == want
        most, got = rng.choice([1, 2, 5, 17]), []
        for part, token in merges.segments(text):
            leaves = [(part[a:b], np.frombuffer(merges.encode(part[a:b]), "<u4")) for a, b in bpe.halves(len(part), most)]
            got += [token] if token is not None else merges.join_all(leaves, most=most).tolist()
        assert got == want, (most, text)
        assert merges.decode(np.array(want, "<u4").tobytes()) == tokenizer.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "日本語中文漢字", "!?'-=#", "aé"])
def test_windows_inside_one_long_word(tokenizer, merges, monkeypatch, letters):
    monkeypatch.setattr(bpe, "WINDOW", 1)  # so that windows have to grow
    rng = random.Random(letters)
    for n in (40, 500, 5_000):
        word = "".join(rng.choice(letters) for _ in range(n))
        leaves = [(word[a:b], np.frombuffer(merges.encode(word[a:b]), "<u4")) for a, b in bpe.halves(n, 30)]
        assert merges.join_all(leaves, most=30).tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_encode_and_decode_rows(spark, tokenizer):
    spec = bpe.read_tokenizer(path("byte_bpe_50k.json"))
    source = docs(spark, ODD)
    for long, piece in ((bpe.LONG, bpe.PIECE), (50, 30)):
        out = bpe.decode(bpe.encode(source, spec, long=long, piece=piece), spec).collect()
        assert sorted((repr(r["doc_id"]), r["decoded"]) for r in out) == sorted((repr(i), t or "") for i, t in ODD)
        want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in ODD}
        assert all(np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want[r["doc_id"]] for r in out)
        assert {r["output"] for r in out} == {"o"} and {r["_row"] for r in out} == {3}
    both = bpe.encode(source, spec, decoded="n", long=50, piece=30).collect()
    assert sorted((repr(r["doc_id"]), r["n"]) for r in both) == sorted((repr(i), t or "") for i, t in ODD)
    assert bpe.encode(docs(spark, []), spec).count() == 0


def test_tokenizers_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.read_tokenizer(path("word_bpe_49k.json"))


def test_bpe_query_against_the_library(spark, tokenizer):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    out = QUERIES["op12_bpe_tokens"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == want


# --- 11: hard negatives ----------------------------------------------------------------

VEC = "vec_id bigint, embedding array<float>, label int, row int, pivot string, block int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "p", 2, 3) for i, v, y in rows], VEC)


def mined(rows):
    """Every pair, by the rule."""
    use = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, y, v) in enumerate(use):
        if i % 50:
            continue
        score = lambda b: sum(p * q for p, q in zip(v, use[b][2]))
        ranked = sorted((-score(b), use[b][0], b) for b in range(len(use)) if b != a)
        for p, pid, _ in [r for r in ranked if use[r[2]][1] == y][:5]:
            fits = [r for r in ranked if use[r[2]][1] != y and 50 * -p <= 100 * -r[0] <= 95 * -p]
            out += [(i, pid, k, n, -p, -s) for k, (s, n, _) in enumerate(fits[:3], 1)]
    return sorted(out)


def clouds(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(int(i), (centres[i % 12] + spread * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("width, spread", [(3, 0.05), (16, 0.3), (40, 2.0)])
def test_hard_negatives(spark, monkeypatch, width, spread):
    monkeypatch.setattr(hard_negatives, "BLOCK", 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "CHILDREN", 4)
    rows = clouds(width, 1_000, width, spread)
    out = hard_negatives.op11_mined(spark, vectors(spark, rows)).collect()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r[c] for c in columns) for r in out) == mined(rows) and out


def test_hard_negatives_of_odd_rows(spark):
    rows = clouds(5, 300, 4, 0.2)
    rows += [(50, None, 3), (100, [1.0, None], 3), (150, [math.nan, 1.0], 3), (200, [math.inf, 1.0], 3), (250, [1.0] * 4, None)]
    rows += [(300 + i, [0.5, 0.25, 0.1, 0.0], i % 4) for i in range(400)]  # copies of one vector
    rows += [(400, [0.5, 0.25, 0.1, 0.0], 0)] * 2 + [(800, [], 1), (850, [0.5], 2), (801, [0.5, 0.25, 0.1, 0.0, 1.0], 1)]
    out = hard_negatives.op11_mined(spark, vectors(spark, rows)).collect()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r[c] for c in columns) for r in out) == mined(rows)
    assert hard_negatives.op11_mined(spark, vectors(spark, [])).count() == 0
    assert hard_negatives.op11_mined(spark, vectors(spark, [(50, [1.0], 1)])).count() == 0


def test_large_components_stay_exact():
    q, x = np.array([[3 * 10**8, 1]]), np.array([[3 * 10**9, 7], [3 * 10**9, 8]])
    assert hard_negatives.products(q, x).tolist() == [[9 * 10**17 + 7, 9 * 10**17 + 8]]


def test_nodes_cover_their_points():
    rng = np.random.default_rng(1)
    points, labels = rng.integers(-300, 300, size=(2_000, 8)), rng.integers(0, 5, 2_000)
    order, nodes = hard_negatives.cover_tree(points, labels)
    assert sorted(order) == list(range(2_000))
    x = hard_negatives.augmented(points)[order]
    for start, size, centre, radius, child, children, low, high in nodes:
        assert start <= centre < start + size
        assert hard_negatives.distances(x[start : start + size], x[centre]).max() <= radius + 1e-9
        own = labels[order][start : start + size]
        assert (low, high) == (own.min(), own.max())
        parts = nodes[child : child + children]
        assert not children or sum(p[1] for p in parts) == size
