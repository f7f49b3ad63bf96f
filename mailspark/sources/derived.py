"""Mails and questions made from the ``documents`` and ``benchmark`` tables.

The tables hold no mailbox, so each document becomes one notification mail: its whole text with
review lines around it. Each benchmark item becomes one question.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PR_BASE, PR_COUNT = 1000, 23
# Openings of a subject, some with words that the tag rules know; the document's own words follow.
TITLES = [
    "Resolve crash on empty input of", "Cache the query plan for", "Wider dashboard for", "Let the endpoint take",
    "Check auth tokens of", "Lower latency of", "Rename", "Describe", "Move the login page to", "Drop the db table of",
]
# Capitalised words of the whole text, which are few.
SUBJECT_WORD = "[A-Z][a-z]{7,}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int, rest: int, *parts):
    """The text of ``parts`` for every n-th mail, NULL (left out) for the others."""
    return F.when(F.col("doc_id") % n == rest, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _num(c):
    return c.cast("string")


def _mails_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pr = _num(PR_BASE + i % PR_COUNT)
    second_pr = _num(PR_BASE + (i + 7) % PR_COUNT)
    sha = F.md5(_num(i))
    pr_text = (
        F.when((i % 11 == 0) | (i % 17 == 3), F.lit(""))
        .when(i % 13 == 0, F.concat(F.lit(" (PR #"), pr, F.lit(") pull request #"), second_pr))
        .otherwise(F.concat(F.lit(" (PR #"), pr, F.lit(")")))
    )
    words = F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(SUBJECT_WORD), F.lit(0))), " ")
    title = F.concat(F.get(F.lit(TITLES), (i % len(TITLES)).cast("int")), F.lit(" "), words)
    subject = F.concat(
        F.lit("["), "lang", F.lit("/"), "source", F.lit("] "), title,
        F.coalesce(_every(7, 0, " TCK-", _num(i % 97)), F.lit("")),
        F.coalesce(_every(19, 4, " @dev-", _num(i % 5)), F.lit("")),
        pr_text,
    )
    kind = F.when(i % 11 == 0, F.lit("/issue/")).otherwise(F.lit("/pull/"))
    message_id = F.concat(F.lit("<"), "lang", F.lit("/"), "source", kind, pr, F.lit("/c"), _num(i), F.lit("@example.com>"))
    body = F.concat_ws(
        "\n",
        "text",
        _every(3, 0, "Summary (v1)\nThis change fixes the index display."),
        _every(4, 0, "# Notes\n- first item\n* second item ", _num(i), "\n1. third"),
        _every(6, 1, "```sql\nselect ", _num(i % 3), "\n```"),
        _every(5, 1, F.left(sha, F.lit(12)), " commit message ", _num(i % 10)),
        _every(10, 4, F.left(sha, F.lit(7))),
        _every(2, 0, "M a/src/db/x", _num(i % 9), ".py\nA web/ui/view.css"),
        _every(8, 3, "R100 a/old/p.go b/new/p.go"),
        _every(9, 2, "see https://github.com/o/r/pull/", pr, " here"),
        _every(12, 5, "Relates to PROJ-", _num(i % 50)),
        _every(14, 6, "cc @dev-", _num(i % 7)),
    )
    documents = read_table(spark, sf_dir, "documents")
    return documents.select(
        F.col("source").alias("mbox"),
        i.alias("seq"),
        subject.alias("subject"),
        F.concat(F.lit("dev-"), _num(i % 7), F.lit("@example.com")).alias("sender"),
        F.concat(F.lit("Mon, 1 Jan 2024 00:00:"), F.lpad(_num(i % 60), 2, "0"), F.lit(" +0000")).alias("date"),
        message_id.alias("message_id"),
        body.alias("body"),
        "text",
    )


def derived_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mbox, seq, subject, sender, date, message_id, body)."""
    return _mails_with_text(spark, sf_dir).drop("text")


def derived_raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_mails``: the document's text in four mail layouts, some subjects folded."""
    i = F.col("seq")
    subject = F.when(i % 5 == 0, F.replace("subject", F.lit("] "), F.lit("]\n "))).otherwise(F.col("subject"))
    head = F.concat(
        F.lit("Received: by mail\nSubject: "), subject, F.lit("\nFROM: "), "sender",
        F.lit("\ndate: "), "date", F.lit("\nMessage-ID: "), "message_id",
    )
    text = F.col("text")
    plain, html = "\n--b1\nContent-Type: text/plain; charset=utf-8\n", "\n--b1\nContent-Type: text/html\n\n"
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    page = F.concat(F.lit("<html><body><p>"), escaped, F.lit("</p></body></html>"))
    quoted = F.replace(F.replace(text, F.lit("="), F.lit("=3D")), F.lit(" "), F.lit("=\n "))
    boundary = '\nContent-Type: multipart/alternative;\n boundary="b1"\n\npreamble'
    closing = "\n--b1--\nepilogue\n"
    raw = (
        F.when(i % 4 == 0, F.concat(head, F.lit("\n\n"), text))
        .when(i % 4 == 1, F.concat(
            head, F.lit(boundary + plain + "Content-Transfer-Encoding: Quoted-Printable\n\n"), quoted,
            F.lit(html), page, F.lit(closing)))
        .when(i % 4 == 2, F.concat(
            head, F.lit(boundary + plain + "Content-Transfer-Encoding: base64\n\n"),
            F.base64(F.encode(text, "UTF-8")), F.lit(closing)))
        .otherwise(F.concat(head, F.lit(boundary + html), page, F.lit(closing)))
    )
    return _mails_with_text(spark, sf_dir).select("mbox", "seq", raw.alias("raw"))


def derived_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): each benchmark item's whole text behind one of eight openings."""
    i = F.col("item_id")
    pr = _num(PR_BASE + i % PR_COUNT)
    opening = (
        F.when(i % 8 == 0, F.concat(F.lit("pr #"), pr, F.lit(" commits and file changes. ")))
        .when(i % 8 == 1, F.concat(F.lit("What did commit "), F.left(F.md5(_num(i * 5 + 1)), F.lit(7)), F.lit(" change? ")))
        .when(i % 8 == 2, F.concat(F.lit("  Pull Request # "), pr, F.lit(" summary ")))
        .when(i % 8 == 3, F.lit("why is the database query slow in the dashboard ui? "))
        .when(i % 8 == 4, F.lit("status of PR 99999 "))
        .when(i % 8 == 5, F.concat(F.lit("api and security of src15 view.css "), pr, F.lit(" TCK-7 ")))
        .when(i % 8 == 6, F.concat(F.lit("pull #"), pr, F.lit(" and pr #1 ")))
        .otherwise(F.lit(""))
    )
    return read_table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.concat(opening, "text").alias("text")
    )


def derived_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_mails`` with reply headers: every third mail answers one of a handful, the others form long
    chains; some name mails that do not exist, some themselves, and some pairs name each other."""
    i = F.col("doc_id")
    name = lambda n: F.concat(F.lit("<m"), n.cast("string"), F.lit("@example.com>"))
    reply = (
        F.when(i % 101 == 7, F.concat(F.lit("In-Reply-To: "), name(i), F.lit("\n")))
        .when(i % 103 == 10, F.concat(F.lit("In-Reply-To: "), name(i + 3), F.lit("\n")))
        .when(i % 89 == 5, F.lit(""))
        .when(i % 3 == 0, F.concat(F.lit("in-reply-to: your mail "), name(F.lit(1) + i % 4), F.lit("\n")))
        .when(i % 7 == 2, F.concat(F.lit("References: "), name(i - 9), F.lit("\n "), name(i - 3), F.lit(" <gone@example.com>\n")))
        .when(i % 7 == 3, F.concat(F.lit("In-Reply-To: <lost@example.com>\nReferences: "), name(i - 3), F.lit("\n")))
        .otherwise(F.concat(F.lit("In-Reply-To: "), name(i - 3), F.lit("\n")))
    )
    raw = F.concat(F.lit("Subject: Re: "), "source", F.lit("\nMessage-ID: "), name(i), F.lit("\n"), reply, F.lit("\n"), "text")
    return read_table(spark, sf_dir, "documents").select(F.col("source").alias("mbox"), i.alias("seq"), raw.alias("raw"))


def derived_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mbox, seq, body): each document's lines as the hunk of a patch, some with further files around it.

    The first word of a line gives it its sign; some lines look like headers once signed.
    """
    i = F.col("doc_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    signed = F.transform(
        lines,
        lambda x, n: F.when((n + i) % 4 == 0, F.concat(F.lit("+"), x)).when((n + i) % 4 == 1, F.concat(F.lit("-"), x))
        .when((n + i) % 11 == 2, F.concat(F.lit("--- a/"), F.left(x, F.lit(5)))).when((n + i) % 13 == 3, F.lit("+@@ -1,2 +3,4 @@"))
        .otherwise(F.concat(F.lit(" "), x)),
    )
    body = F.col("signed")
    n_old = F.size(F.filter(body, lambda x: ~F.startswith(x, F.lit("+")))).cast("string")
    n_new = F.size(F.filter(body, lambda x: ~F.startswith(x, F.lit("-")))).cast("string")
    name = F.concat(F.lit("src/"), "source", F.lit("/f"), (i % 9).cast("string"), F.lit(".py"))
    header = (
        F.when(i % 5 == 0, F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n")))
        .when(i % 5 == 1, F.concat(F.lit("--- a/"), name, F.lit("\t2024-01-01\n+++ b/"), name, F.lit("\n")))
        .when(i % 5 == 2, F.concat(F.lit("diff --git a/old.py b/"), name, F.lit("\nrename from old.py\nrename to "), name, F.lit("\n--- a/old.py\n+++ b/"), name, F.lit("\n")))
        .otherwise(F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nindex 1..2 100644\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n")))
    )
    more = (
        F.when(i % 6 == 0, F.lit("\ndiff --git a/pic.png b/pic.png\nBinary files a/pic.png and b/pic.png differ"))
        .when(i % 6 == 1, F.lit("\n\\ No newline at end of file\n@@ -90 +90,2 @@ def f():\n-old\n+new\n+newer\nbye"))
        .when(i % 6 == 2, F.lit("\ndiff --git a/gone.txt b/gone.txt\ndeleted file mode 100644\n--- a/gone.txt\n+++ /dev/null\n@@ -1,5 +0,0 @@\n-a\n-b\ncut off\n+stray"))
        .otherwise(F.lit("\n-- \nsignature"))
    )
    documents = read_table(spark, sf_dir, "documents").withColumn("signed", signed)
    patch = F.concat(F.lit("Please review.\n\n"), header, F.lit("@@ -1,"), n_old, F.lit(" +1,"), n_new, F.lit(" @@\n"), F.array_join("signed", "\n"), more)
    return documents.select(F.col("source").alias("mbox"), i.alias("seq"), patch.alias("body"))


def derived_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived mails with dates of their own: days and zones by number, in several forms, some unreadable."""
    i = F.col("seq")
    day, hour = 1 + (i * 7) % 28, (i * 5) % 24
    month = F.get(F.lit(["Jan", "Feb", "Mar"]), ((F.floor(i / 40)) % 3).cast("int"))
    clock = F.concat(F.lpad(_num(hour), 2, "0"), F.lit(":"), F.lpad(_num(i % 60), 2, "0"))
    date = (
        F.when(i % 23 == 0, F.lit("yesterday"))
        .when(i % 5 == 0, F.concat(_num(day), F.lit(" "), month, F.lit(" 24 "), clock, F.lit(" EST (New York)")))
        .when(i % 5 == 1, F.concat(F.lit("Mon, "), _num(day), F.lit(" "), F.lower(month), F.lit(" 2024 "), clock, F.lit(":30 +0530")))
        .when(i % 5 == 2, F.concat(F.lit("Tue, "), F.lpad(_num(day), 2, "0"), F.lit(" "), month, F.lit(" 2024 "), clock, F.lit(":00 GMT")))
        .otherwise(F.concat(F.lit("Wed,  "), _num(day), F.lit(" "), month, F.lit(" 2024 "), clock, F.lit(":05 -0800")))
    )
    sender = F.concat(F.lit("dev-"), _num((i * 31) % 211), F.lit("@example.com"))
    return derived_mails(spark, sf_dir).withColumns({"date": date, "sender": sender})
