"""Raw mails to mails: headers, body, and every extracted column."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import body as B
from ..functions import mime, subject as S, tags as T
from ..functions.text import none_if_blank, none_if_empty, to_bigints
from ..schemas import MARKDOWN

HEADERS = {"subject": "subject", "sender": "from", "date": "date", "message_id": "message-id"}


def mail_headers(raw_mails: DataFrame) -> DataFrame:
    """(mbox, seq, subject, sender, date, message_id)."""
    return raw_mails.withColumn("head", mime.head_of(F.col("raw"))).select(
        "mbox", "seq", *[mime.header(F.col("head"), h).alias(c) for c, h in HEADERS.items()]
    )


def mail_parts(raw_mails: DataFrame) -> DataFrame:
    """(mbox, seq, part, ctype, encoding, payload): leaves of each mail, decoded, in order.

    The outer explode keeps the optimizer from adding a filter on ``size(parts)``, which would
    parse every mail a second time at the scan.
    """
    return (
        mime.with_parts(raw_mails)
        .select("mbox", "seq", F.posexplode_outer("parts").alias("part", "p"))
        .where("p IS NOT NULL")
        .select("mbox", "seq", "part", "p.ctype", "p.encoding", "p.payload")
    )


def parse_mails(raw_mails: DataFrame, clean_single_part: bool = False) -> DataFrame:
    """(mbox, seq, subject, sender, date, message_id, body) of raw mails, row by row."""
    with_parts = mime.with_parts(raw_mails)
    return with_parts.select(
        "mbox", "seq", *[mime.header(F.col("head"), h).alias(c) for c, h in HEADERS.items()],
        mime.body_of(F.col("parts"), F.col("multipart"), clean_single_part).alias("body"),
    )


def extract(mails: DataFrame) -> DataFrame:
    """All columns of ``mails`` from (mbox, seq, subject, sender, date, message_id, body).

    Steps that later columns read are columns of their own, so each is computed once.
    """
    subject, body = F.col("subject"), F.col("body")
    return (
        mails.withColumn("subject", F.coalesce(subject, F.lit("")))
        .withColumn("body", F.coalesce(body, F.lit("")))
        .withColumns({
            "pr_numbers": S.mail_prs(subject, F.col("message_id")),
            "pr_title": S.clean_title(subject),
            "repos": none_if_empty(S.subject_repos(subject)),
            "tickets": none_if_empty(S.subject_tickets(subject)),
            "contributors": S.contributors(subject),
            "_lines": B.body_lines(body),
            "commits": B.commits(body),
            "file_paths": B.file_paths(body),
            "linked_prs": B.linked_prs(body),
            "linked_tickets": B.linked_tickets(body),
            "_code": B.code_blocks(body),
            "_lists": B.list_items(body),
        })
        .withColumns({
            "_headings": B.sections_of_lines(F.col("_lines")),
            "files_modified": B.file_components(F.col("file_paths")),
        })
        .withColumns({
            "_title_text": T.lowered(F.col("pr_title")),
            "_files_text": T.files_text(F.col("files_modified")),
            "_section_text": T.lines_text(F.col("_lines")),
        })
        .withColumns({
            "markdown": F.struct(
                F.col("_code").alias("code_blocks"),
                F.col("_headings").alias("headings"),
                F.col("_lists").alias("lists"),
            ),
            "tags": none_if_empty(T.combined_tags(
                T.word_tags(F.col("_title_text")),
                T.file_tags(F.col("_files_text")),
                T.word_tags(F.col("_section_text")),
            )),
        })
        .select(
            "mbox", "seq", "subject", "sender", "date", "message_id", "pr_numbers", "pr_title",
            "repos", "tickets", "body", "markdown", "commits", "files_modified", "file_paths",
            "tags", "linked_prs", "linked_tickets", "contributors",
            # From the lines, so that a reader without sections builds none.
            *[(F.size("_lines") > 0 if key == "headings" else F.col(f"markdown.{key}").isNotNull()).alias(f"has_{key}") for key in MARKDOWN.names],
            B.heading_rest(F.col("_lines")).alias("heading_rest"),
        )
    )


def normalise_mails(mails: DataFrame) -> DataFrame:
    """Null rules of a mail: PR digit strings to numbers, empty lists and a blank title to NULL."""
    lists = ["repos", "tickets", "commits", "files_modified", "tags", "contributors"]
    present = [c for c in lists if c in mails.columns]
    return mails.withColumns({
        "pr_numbers": none_if_empty(to_bigints(F.col("pr_numbers"))),
        "pr_title": none_if_blank(F.col("pr_title")),
        **{c: none_if_empty(F.col(c)) for c in present},
    })
