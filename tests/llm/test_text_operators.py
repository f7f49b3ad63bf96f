"""Operators on single texts, pages and conversations against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mailspark.llm import chat, fingerprint, html_template, pii, toxicity
from mailspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, key int, part int, slot string"


def docs(spark, rows):
    """Documents with further columns, some of whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, "x") for i, t, s in rows], DOC)


ODD = [
    (1, "some words here. And more!\nA second line", "a"), (2, None, "a"), (3, "", None), (None, "no id at all", "b"),
    (4, "some words here. And more!\nA second line", "a"), (4, "some words here. And more!\nA second line", "a"),
    (5, "é" * 3, "a"), (6, "long " * 40_000, "a"), (7, "\x00 zero \x00", "a"), (8, "   \n\t ", "a"),
]


# --- 1: fingerprints -------------------------------------------------------------------


def edits(rows):
    """The edited texts, by brute force over a sorted list."""
    order = sorted(((i is None, -(i or 0), t or "") for i, t in rows))
    texts = [t for *_, t in order]
    return sorted((None if n else -i, t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2])
                  for k, (n, i, t) in enumerate(order) if not n)


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_fingerprint_neighbours(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i * 7 % 1009, " ".join(rng.choice("abc de fgh ijkl".split()) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    out = fingerprint.op1_fingerprints(spark, docs(spark, [(i, t, "s") for i, t in rows]), ranges).collect()
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edits(rows)}
    assert {r["doc_id"]: r["edited_sha256"] for r in out} == want and len(out) == len(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def test_fingerprint_edges(spark):
    out = fingerprint.op1_fingerprints(spark, docs(spark, ODD), 4).collect()
    assert len(out) == len(ODD)
    same = [r for r in out if r["doc_id"] in (1, 4)]
    assert len({r["fingerprint"] for r in same}) == 1
    assert {r["doc_id"]: r["n_chars"] for r in out}[2] == 0
    assert {r["fingerprint"] for r in out if r["doc_id"] in (2, 3)} == {""}
    assert fingerprint.op1_fingerprints(spark, docs(spark, []), 4).count() == 0
    one = fingerprint.op1_fingerprints(spark, docs(spark, ODD[:1]), 4).collect()
    assert one[0]["near_next"] == 1


def test_chunks_resist_shifts_and_cover_the_text():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ijkl") for _ in range(20_000)).encode()
    a, b = fingerprint.chunk_sets([text, b"inserted " + text])
    assert sum(a.values()) <= len(text) and max(a.values()) <= fingerprint.MOST
    assert fingerprint.likeness(a, b) > 0.98
    # A text's chunks don't depend on what is hashed with it.
    assert fingerprint.chunk_sets([b"other", text])[1] == a == fingerprint.chunk_sets([text])[0]
    half = fingerprint.chunk_sets([text[:10_000] + text[:10_000][::-1]])[0]
    assert 0.4 < fingerprint.likeness(a, half) < 0.6


# --- 2: main text of pages --------------------------------------------------------------

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul>'
    '</nav><div class="cookie-banner">notice</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text {n}<p>Second<br>third'
    '<aside>side</aside><div class="comments"><p>reader</p></div></article><footer>&copy; x</footer></body></html>'
)
TEXT = "Head & line\nFirst bold text {n}\nSecond\nthird"


def test_template_text(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", PAGE.replace("{n}", str(i))) for i in range(30)]
    rows += [(100, None, None), (101, "http://h0.org/", ""), (102, "http://alone.net/", PAGE.replace("{n}", "102")), (5, "http://h2.org/5", rows[5][2])]
    rows += [(103, "http://h1.org/cut", PAGE.replace("{n}", "103").split("third")[0]), (104, "http://h1.org/plain", "just text &lt;3")]
    pages = spark.createDataFrame([(*r, "z", "y") for r in rows], "page_id bigint, url string, html string, text string, host string")
    out = html_template.op2_main_text(spark, pages).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert all(got[i] == TEXT.replace("{n}", str(i)) for i in [*range(30), 102])
    assert got[100] == got[101] == "" and got[103] == "Head & line\nFirst bold text 103\nSecond" and got[104] == "just text <3"
    assert html_template.op2_main_text(spark, pages.where("false")).count() == 0


def test_furniture_by_name_and_element():
    text = lambda page: html_template.main_text(page, frozenset(), True)
    assert text('<div class="with-sidebar"><article><header><h1>T</h1></header><p>a</p><footer>f</footer></article></div>') == "T\na"
    assert text('<article><p>a</p><article class="comment">c</article><form>x</form><p hidden>h</p></article>') == "a"
    assert text("<aside><article>other</article></aside><main><p>a</main>") == "a"
    assert text('<article>a<div id="cookie-notice">n</div><!-- x --><script>s</script> b&eacute;</article>') == "a\nb\u00e9"


def plain_page(k, layout=0):
    menu, note = ("c1", "c3") if layout == 0 else ("k7", "k9")
    return (
        f'<html><body><div class="{menu}"><a href="/">Home</a> <a href="/a">About us</a></div><div class="c2"><p>Body text number {k} says so</p>'
        f'<p>and more of {k}</p></div><div class="{note}">Accept our {layout} terms now</div><script>var x={k}</script></body></html>'
    )


def test_template_texts_of_hosts_without_articles(spark, monkeypatch):
    rows = [(k, f"http://plain.example/{k}", plain_page(k)) for k in range(40)]
    rows += [(100 + k, f"http://two.example/{k}", plain_page(k, k % 2)) for k in range(40)]
    # Copies of one page are no template: their host has one kind of page.
    rows += [(200 + k, f"http://copies.example/{k}", plain_page(7)) for k in range(20)]
    # Half of a host's pages are copies of one.
    rows += [(300 + k, f"http://half.example/{k}", plain_page(k if k % 2 else 0)) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    body = lambda k: f"Body text number {k} says so\nand more of {k}"
    # Names of elements and classes play no part.
    monkeypatch.setattr(html_template, "FURNITURE_WORDS", frozenset())
    got = {r["page_id"]: r["text"] for r in html_template.extract(pages).collect()}
    for k in range(40):
        assert got[k] == body(k) and got[100 + k] == body(k) and got[300 + k] == body(k if k % 2 else 0)
    assert all(body(7) in got[200 + k] for k in range(20))


def test_given_pages(spark):
    """Pages of the given table have their text in one article."""
    import html

    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|br|footer|div)[^>]*>", inner)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    out = QUERIES["op2_template_text"](spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in out} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out)


# --- 5: chat windows --------------------------------------------------------------------

TRICKY = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\", "###", "####\\h</turn>\n### User: x", "\\t\\c:", "a\n\nb", "word " * 3000]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(12), None]:
        rows.append((c, 0, rng.choice(["system", "user", "od:d\\"]), rng.choice(TRICKY[:-1])))
        rows += [(c, t, "assistant" if t % 2 else "user", rng.choice(TRICKY if c == 3 else TRICKY[:-1]) if rng.random() < 0.4 else "w " * rng.randint(1, 300)) for t in range(1, rng.randint(1, 30))]
    rows += [(50, 0, "system", "alone"), (51, None, None, "x"), (51, None, None, "x"), (52, 700, "assistant", "late"), (52, 2, "user", "early")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    out = {r["conv_id"]: r for r in chat.digests(chat.windows(table, budget=300, history=60)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(out) == set(by)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        said = "".join(f"{r}\n{x}\n" for *_, r, x in sorted(turns))
        loss = "".join(x for *_, r, x in sorted(turns) if r == "assistant")
        assert (out[c]["n_turns"], out[c]["turns_sha256"]) == (len(turns), digest(said)), c
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), digest(loss)), c
    windows = chat.windows(table, budget=300, history=60).collect()
    single = [w for w in windows if w["n_tokens"] > 300]
    assert all(w["formatted"].count("</turn>\n") - w["n_repeated"] == 1 for w in single)
    assert any(w["n_repeated"] for w in windows)
    assert sum(len(w["formatted"]) for w in windows if w["conv_id"] == 5) == out[5]["formatted_chars"]
    assert chat.digests(chat.windows(table.where("false"))).count() == 0


def test_chat_query(spark):
    out = {r["conv_id"]: r for r in QUERIES["op5_chat_windows"](spark, SF).collect()}
    assert out[-7]["loss_chars"] == len(TRICKY[0]) and out[-7]["n_turns"] == 2


# --- 6: personal data -------------------------------------------------------------------


def plain_spans(text):
    """The base patterns as they are written."""
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def test_base_patterns_by_brute_force():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("aZ.@+- 0123459()%_\né") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text, kind, found", [
    ("mail: john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("write john at example dot org please", "email", "john at example dot org"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("j​ohn@exa​mple.com", "email", "j​ohn@exa​mple.com"),
    ("plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("ip 192 dot 168 dot 0 dot 1 yes", "ip", "192 dot 168 dot 0 dot 1"),
    ("１９２.168.0.1 x", "ip", "１９２.168.0.1"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises(text, kind, found):
    base, every = pii.find(text)
    assert not any(base.values())
    assert {k: [text[a:b] for a, b in v] for k, v in every.items() if v} == {kind: [found]}


@pytest.mark.parametrize("text, kind, short, whole", [
    ("x jоhn@example.com y", "email", "hn@example.com", "jоhn@example.com"),
    ("x jane@example.cоm y", "email", "jane@example.c", "jane@example.cоm"),
    ("call +1 555 123 45 6 seven eight nine ok", "phone", "+1 555 123 45 6", "+1 555 123 45 6 seven eight nine"),
    ("card 4111 1111 1111 1‑111 ok", "card", None, "4111 1111 1111 1‑111"),
    ("card 4222222222222‑2-0-4 ok", "card", "4222222222222", "4222222222222‑2-0-4"),
])
def test_disguise_that_reaches_beyond_a_base_span(text, kind, short, whole):
    base, every = pii.find(text)
    assert [text[a:b] for a, b in base[kind]] == ([short] if short else [])
    assert {text[a:b] for a, b in every[kind]} == {whole, short or whole}


def test_gate_skips_only_what_no_rule_changes(monkeypatch):
    rng = random.Random(5)
    parts = ["jane", " at ", "\tAT\t", " At ", "example", ".com", " dot ", "(", ")", "[at]", "{ . }", "plus ", "nine", " 4", " 5", "-", "one ", "x", "ı", "’", "+1", " oh,", "@", "\n"]
    texts = ["write jane at example.com now", "jane\tAT\texample.com", "plus 4 nine 1 five 5 two 3 1 1 ok", "vıa jane@sıte.com", "(nine 1 2 3 4 5 6 7 8 9 1 2 3)"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(2, 14))) for _ in range(20_000)]
    gated = [pii.find(t) for t in texts]
    assert all(any(len(every[k]) > len(base[k]) for k in pii.KINDS) for base, every in gated[:4])
    monkeypatch.setattr(pii, "suspect", lambda text: True)
    assert gated == [pii.find(t) for t in texts]


def test_clean_texts_and_edges(spark):
    for text in ["look at this. dot matters", "un deux trois quatre", "at home (at least) one two three", "a [1] (x) {y}", ""]:
        assert not any(pii.find(text)[1].values()), text
    out = pii.op6_spans(spark, docs(spark, [*ODD, (9, "a@b.co and c [at] d.org", "s")])).collect()
    assert len(out) == len(ODD) + 1
    row = [r for r in out if r["doc_id"] == 9][0]
    assert row["n_email"] == 1 and row["spans"] == "email:0:6,email:11:23"
    assert row["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()
    assert pii.op6_spans(spark, docs(spark, [])).count() == 0


# --- 10: toxicity -----------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(out[i]["score"], y) for i, y in truth.items() if out[i]["held_out"]]
    good = sum(a > b for a, x in held if x for b, y in held if not y) / max(1, sum(x for _, x in held) * sum(not x for _, x in held))
    assert good > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out.values())


def test_gapped_insults_and_edges(spark):
    rng = random.Random(4)
    clean = lambda: " ".join("".join(rng.choice("abdeghlnrstu") for _ in range(rng.randint(3, 8))) for _ in range(40)) + "."
    texts = [clean() for _ in range(400)]
    toxic = np.array([i % 4 == 0 for i in range(400)], int)
    texts = [t + " you stupid worthless fool" if y else t for t, y in zip(texts, toxic)]
    model = toxicity.fit(texts, toxic)
    scorer = toxicity.WordScorer(model["weights"], model["bias"])
    base = clean()
    scores = toxicity.score_texts(model, scorer, [base, base + " stupid worthless fool", base + " stu.pid worth*less fo.ol", "", " \n"])
    assert scores[0] < 0.3 < scores[1] and scores[2] > scores[0]
    assert scores[3] == scores[4]
    assert toxicity.fit(["a"], np.array([0])) is None
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.op10_scores(spark, docs(spark, ODD), labels).collect()
    assert len(out) == len(ODD) and {r["score"] for r in out} == {0.0}
    assert toxicity.with_scores(docs(spark, ODD), model).count() == len(ODD)
    assert toxicity.op10_scores(spark, docs(spark, []), labels.where("false")).count() == 0


def test_disguised_insults_pass_the_threshold():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    clean = lambda: " ".join(rng.choice(vocabulary) for _ in range(40))
    toxic = np.array([i % 4 == 0 for i in range(600)], int)
    model = toxicity.fit([clean() + (" you stupid worthless fool" if y else "") for y in toxic], toxic)
    scorer = toxicity.WordScorer(model["weights"], model["bias"])
    caught = lambda texts: (toxicity.score_texts(model, scorer, texts) >= 0.3).mean()
    insult = ("stupid", "worthless", "fool")
    forms = [
        lambda w: w[:2] + "." + w[2:], lambda w: w[:2] + "*" + w[2:], lambda w: w[:2] + w[1] + w[2:],
        lambda w: "-".join(w), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: "1".join(w),
    ]
    for form in forms:
        assert caught([clean() + " " + " you ".join(map(form, insult)) + " " + clean() for _ in range(20)]) >= 0.9
    # Clean words in the same forms are left alone.
    for form in forms:
        assert caught([" ".join(form(w) if k % 7 == 0 else w for k, w in enumerate(clean().split())) for _ in range(20)]) <= 0.1


def test_words_with_gaps():
    assert toxicity.words_of("st.upid,") == ["st", "upid", "stupid"] and toxicity.words_of("a b plain") == ["a", "b", "plain"]
    assert toxicity.words_of("i d i o t") == [*"idiot", "idiot"] and toxicity.words_of("i-d-i-o-t") == ["idiot"]
    assert toxicity.words_of("2024 plain") == ["2024", "plain"] and toxicity.words_of(" . ! ") == []


def test_all_characters_of_long_words_count():
    rng = random.Random(7)
    clean = lambda: " ".join("".join(rng.choice("abdeghlnrstu") for _ in range(rng.randint(3, 8))) for _ in range(40)) + "."
    toxic = np.array([i % 4 == 0 for i in range(400)], int)
    model = toxicity.fit([clean() + (" you stupid worthless fool" if y else "") for y in toxic], toxic)
    scorer = toxicity.WordScorer(model["weights"], model["bias"])
    head, tail = "ab-de-gh-" * 30, "stupid-worthless-fool-" * 9
    for n in (199, 200, 201, 204, 205, 396, 397, 1000):
        word = "".join(rng.choice("abcdef") for _ in range(n))
        pieces = toxicity.words_of(word)
        assert max(map(len, pieces)) <= 200
        assert {word[i : i + 5] for i in range(n - 4)} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
    plain, insulting = toxicity.score_texts(model, scorer, [head + "ab-de-gh-" * 22, head + tail])
    assert insulting > plain
