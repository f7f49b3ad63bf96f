"""Columns taken from the subject and the Message-ID header."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import extract_all, none_if_blank, none_if_empty, sorted_set, to_bigints


def subject_prs(subject: Column) -> Column:
    """Digit strings after ``PR #``, ``pull request #`` or ``#``, in order."""
    return extract_all(subject, P.SUBJECT_PR)


def subject_repos(subject: Column) -> Column:
    return extract_all(subject, P.SUBJECT_REPO)


def subject_tickets(subject: Column) -> Column:
    return extract_all(subject, P.SUBJECT_TICKET)


def clean_title(subject: Column) -> Column:
    """Subject without its ``[repo]`` parts, PR markers and tickets; NULL when nothing is left."""
    no_repo = F.aggregate(
        subject_repos(subject), subject,
        lambda acc, r: F.replace(acc, F.concat(F.lit("["), r, F.lit("]")), F.lit("")),
    )
    no_pr = F.aggregate(
        subject_prs(subject), no_repo,
        lambda acc, n: F.regexp_replace(acc, F.concat(F.lit("(?i)" + P.PR_MARK), n), F.lit("")),
    )
    no_ticket = F.aggregate(
        subject_tickets(subject), no_pr,
        lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"\b"), t, F.lit(r"[:\-\s]*")), F.lit("")),
    )
    return none_if_blank(F.btrim(no_ticket, F.lit(P.TITLE_TRIM)))


def message_id_pr(message_id: Column) -> Column:
    return F.regexp_extract(message_id, P.MESSAGE_ID_PR, 1).try_cast("bigint")


def mail_prs(subject: Column, message_id: Column) -> Column:
    """Distinct PR numbers of a mail; a 0 in the Message-ID does not count."""
    from_id = message_id_pr(message_id)
    numbers = F.concat(
        to_bigints(subject_prs(subject)), F.array_compact(F.array(F.when(from_id != 0, from_id)))
    )
    return none_if_empty(sorted_set(numbers))


def contributors(text: Column) -> Column:
    """Distinct ``@name`` mentions of a subject or a body."""
    return none_if_empty(sorted_set(extract_all(text, P.MENTION)))
