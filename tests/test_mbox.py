"""Mailbox files against the standard library's mailbox and email modules."""

import base64
import mailbox

import pytest
from pyspark.sql import functions as F

from mailspark.operators.extract import mail_parts, parse_mails
from mailspark.sources.mbox import read_mbox

ENVELOPE = "From bot@example.com Mon Jan  1 00:00:00 2024\n"
B64 = base64.encodebytes("naïve text\nline two, padded".encode()).decode()

BOXES = {
    "plain": (
        ENVELOPE + "Subject: [o/r] Fix (PR #7)\nFrom: a@x\nDate: d1\nMessage-ID: <o/r/pull/7/a@x>\n\nfirst body\n\n"
        + ENVELOPE + "subject: Re: [o/r] Fix (PR #7)\nFROM: b@x\n\nabcdef1 message\nM src/a.py\n```\ncode\n```\n\n"
    ),
    "bare": (
        "text before the first mail\n\n" + ENVELOPE + "Subject: folded\n line\nX: y\n\n>From quoted\nbody\n"
        + ENVELOPE + "Date: d\n\n\n" + ENVELOPE + "Subject: no body\n\n" + ENVELOPE + "\nno headers\n\n\n"
    ),
    "nested": (
        ENVELOPE + 'Subject: nested\nContent-Type: multipart/mixed; boundary="out.er+1"\n\npreamble\n'
        '--out.er+1\nContent-Type: multipart/alternative;\n boundary=inner\n\n'
        "--inner\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"
        "caf=C3=A9 50%+x =3D soft=\nnext\n--inner\nContent-Type: text/html\n\n<p>hidden</p>\n--inner--\n"
        f"--out.er+1\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n{B64}--out.er+1\n"
        "Content-Type: application/pdf\n\npdf\n--out.er+1--\nepilogue\n\n"
        + ENVELOPE + "Subject: page\nContent-Type: multipart/alternative; boundary=b2\n\n"
        "--b2\nContent-Type: text/html; charset=utf-8\n\n<p>Hello <b>you</b></p><p>there</p>\n--b2--\n\n"
        + ENVELOPE + "Subject: single page\nContent-Type: text/html\n\n<p>raw</p>\n\n"
        + ENVELOPE + "Subject: forwarded\nContent-Type: multipart/mixed; boundary=f1\n\n"
        "--f1\nContent-Type: text/plain\n\nabove\n--f1\nContent-Type: message/rfc822\n\nSubject: in\n\ninside\n--f1--\n\n"
        + ENVELOPE + "Subject: no boundary\nContent-Type: multipart/mixed\n\nstays\n\n"
    ),
    "empty": "",
}


def expected_body(msg):
    """Body rule over the standard library's parts; the HTML of these boxes is tags and text."""
    if not msg.is_multipart():
        return msg.get_payload(decode=True).decode(errors="ignore")
    leaves = [(p.get_content_type(), p.get_payload(decode=True)) for p in msg.walk()]
    plain = [b.decode(errors="ignore") for t, b in leaves if t == "text/plain" and b is not None]
    pages = [b for t, b in leaves if t == "text/html" and b is not None]
    if plain:
        return "\n".join(plain)
    return "Hello\nyou\nthere" if pages else ""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("boxes")
    for name, text in BOXES.items():
        (root / f"{name}.mbox").mkdir()
        (root / f"{name}.mbox" / "mbox").write_bytes(text.encode())
    (root / "other.txt").write_text("not a mailbox")
    (root / "bad.mbox").mkdir()
    return root


@pytest.mark.parametrize("name", list(BOXES))
def test_same_mails_as_standard_library(spark, root, name):
    rows = parse_mails(read_mbox(spark, str(root))).where(F.col("mbox") == name).orderBy("seq").collect()
    want = list(mailbox.mbox(str(root / f"{name}.mbox" / "mbox")))
    assert len(rows) == len(want)
    for row, msg in zip(rows, want):
        assert row["subject"] == msg.get("subject", "")
        assert row["sender"] == msg.get("from", "")
        assert row["date"] == msg.get("date", "")
        assert row["message_id"] == msg.get("message-id", "")
        assert row["body"] == expected_body(msg)


def test_leaves(spark, root):
    parts = mail_parts(read_mbox(spark, str(root))).where("mbox = 'nested' and seq = 0").orderBy("part").collect()
    assert [(p["ctype"], p["encoding"]) for p in parts] == [
        ("text/plain", "quoted-printable"), ("text/html", ""), ("text/plain", "base64"), ("application/pdf", ""),
    ]
    assert parts[0]["payload"] == "café 50%+x = softnext"


def test_bad_bytes_and_crlf(spark, tmp_path):
    (tmp_path / "raw.mbox").mkdir()
    text = ENVELOPE.encode() + b"Subject: x\r\n\r\nab\xffcd\r\n" + ENVELOPE.encode() + b"Subject: y\r\n\r\nz\r\n"
    (tmp_path / "raw.mbox" / "mbox").write_bytes(text)
    rows = parse_mails(read_mbox(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r["subject"], r["body"]) for r in rows] == [("x", "abcd\n"), ("y", "z\n")]


def test_order_across_splits(spark, tmp_path):
    """A file cut into many splits keeps its order, whatever the split size."""
    (tmp_path / "big.mbox").mkdir()
    mails = [f"{ENVELOPE}Subject: n{i}\n\n{'body ' * (i % 7)}{i}\n\n" for i in range(500)]
    (tmp_path / "big.mbox" / "mbox").write_text("".join(mails))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    before_open = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ["997", "4096", "134217728"]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = parse_mails(read_mbox(spark, str(tmp_path))).orderBy("seq").collect()
            assert [r["seq"] for r in rows] == list(range(500))
            assert [r["subject"] for r in rows] == [f"n{i}" for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", before_open)


QUOTED = "Content-Type: multipart/mixed; boundary=zz\n\n--zz\ninner text\n--zz--\nlast line"
NESTED = {
    "quoted source": 'Subject: a\nContent-Type: multipart/mixed; boundary="b1"\n\npre\n--b1\nContent-Type: text/plain\n\n' + QUOTED + "\n--b1--\nepi\n",
    "nested": 'Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/alternative; boundary="i"\n\n--i\n\nA\n--i\n'
    "Content-Type: text/html\n\n<p>B\n--i--\nmid\n--o\n\nC\n--o--\n",
    "unclosed": 'Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/alternative; boundary="i"\n\n--i\n\nA\n--o\n\nC\n--i\nstill C\n--o--\n',
    "folded": "Subject: x\n" + "".join(f" fold{i}\n" for i in range(20_000)) + "Content-Type: multipart/mixed;\n boundary=o\n\n--o\n\nA\n"
    + "Content-Type: multipart/mixed\n" + " y\n" * 20_000 + "--o--",
    "enclosed mail": "Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: message/rfc822\n\nSubject: in\n"
    "Content-Type: multipart/mixed; boundary=k\n\n--k\n\nIN\n--k--\n--o\n\nC\n--o--\n",
    "plain": "Subject: s\n\nhello " + QUOTED,
}


def test_bodies_as_the_standard_library_has_them(spark):
    import email

    df = spark.createDataFrame([(k, 1, v) for k, v in NESTED.items()], "mbox string, seq bigint, raw string")
    got = {r["mbox"]: r["body"] for r in parse_mails(df).collect()}
    for name, raw in NESTED.items():
        m = email.message_from_string(raw)
        plain = [p.get_payload(decode=True).decode() for p in m.walk() if p.get_content_type() == "text/plain"]
        assert got[name] == ("\n".join(plain) if m.is_multipart() else m.get_payload()), name
