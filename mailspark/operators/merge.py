"""Mails of one pull request become one mail, per mailbox.

The first mail of a mailbox that carries a PR leads it; every mail carrying the PR is a member of
its leader, once. A merged mail is kept as rows of four tables, so that one with millions of members
is like any other: one header row, its distinct list values, its Markdown items and its texts in
order. No member is left out and nothing depends on the number of members.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.body import is_sonar
from ..functions.render import section_line
from .ordering import SPAN, span_of, with_rank

MAIL = ["mbox", "seq"]
LEADER = ["mbox", "leader_seq"]
HEADER_FIELDS = ["subject", "sender", "date", "message_id", "pr_title", "pr_numbers"]
VALUE_FIELDS = [
    "repos", "tickets", "commits", "files_modified", "file_paths", "linked_prs", "linked_tickets", "contributors",
]
MARKDOWN_KEYS = ["code_blocks", "headings", "lists"]


def pr_leaders(mails: DataFrame, span: int = SPAN) -> DataFrame:
    """(mbox, pr, block, leader_seq): the first mail carrying each PR, per block of positions."""
    firsts = (
        mails.select("mbox", "seq", F.explode_outer("pr_numbers").alias("pr"), span_of(F.col("seq"), span).alias("block"))
        .where("pr IS NOT NULL")
        .groupBy("mbox", "pr", "block")
        .agg(F.min("seq").alias("first_seq"))
    )
    return firsts.select(
        "mbox", "pr", "block", F.min("first_seq").over(Window.partitionBy("mbox", "pr")).alias("leader_seq")
    )


def members(mails: DataFrame, keep_unlinked: bool = False, span: int = SPAN) -> DataFrame:
    """(mbox, leader_seq, seq, rank, members, all_*): who merges into whom, narrow rows only.

    The first mail of a mailbox always leads itself; other mails without a PR are dropped unless
    ``keep_unlinked``. ``all_<key>`` tells whether every member has that Markdown key.
    """
    flags = [f"has_{k}" for k in MARKDOWN_KEYS]
    narrow = mails.select("mbox", "seq", "pr_numbers", *flags).withColumn("block", span_of(F.col("seq"), span))

    by_pr = (
        narrow.withColumn("pr", F.explode_outer("pr_numbers"))
        .where("pr IS NOT NULL")
        .drop("pr_numbers")
        .join(pr_leaders(mails, span), ["mbox", "pr", "block"])
    )
    if keep_unlinked:
        alone = narrow.where("pr_numbers IS NULL").withColumn("leader_seq", F.col("seq"))
    else:
        first = narrow.groupBy("mbox").agg(F.min_by(F.struct("seq", "block", *flags), "seq").alias("m"))
        alone = first.select("mbox", "m.*").withColumn("leader_seq", F.col("seq"))

    place = [*LEADER, "block"]
    columns = [*place, "seq", *flags]
    distinct = by_pr.select(*columns).union(alone.select(*columns)).dropDuplicates([*place, "seq"])
    return with_rank(
        distinct, LEADER, ["block"], ["seq"],
        group_aggs={
            "members": (F.count(F.lit(1)), "sum"),
            **{f"all_{k}": (F.min(f"has_{k}"), "min") for k in MARKDOWN_KEYS},
        },
    ).drop("block", *flags)


def merged_heads(who: DataFrame, mails: DataFrame) -> DataFrame:
    """(mbox, seq, members, header fields, tags): one row per leader, with its own header fields.

    ``tags`` are those of all members, of which the rules know a handful.
    """
    lead = who.where("seq = leader_seq").join(mails.select(*MAIL, *HEADER_FIELDS), MAIL)
    tags = (
        who.select(*LEADER, "seq").join(mails.select(*MAIL, F.explode("tags").alias("tag")), MAIL)
        .select(*LEADER, "tag").distinct()
        .groupBy(*LEADER).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    )
    return lead.join(tags, LEADER, "left").select(*MAIL, "members", *HEADER_FIELDS, "tags")


def merged_values(who: DataFrame, mails: DataFrame, fields: list[str] = VALUE_FIELDS) -> DataFrame:
    """(mbox, seq, field, value, detail): distinct values of list fields per leader, as text.

    A commit's value is its SHA and its detail the message. The distinct runs on all columns, so
    repeats collapse before the shuffle and a large leader spreads over its values.
    """

    def pairs_of(field: str):
        def pair(x):
            value, detail = (x["sha"], x["message"]) if field == "commits" else (x.cast("string"), F.lit(None).cast("string"))
            return F.struct(F.lit(field).alias("field"), value.alias("value"), detail.alias("detail"))

        return F.coalesce(F.transform(F.col(field), pair), F.array().cast("array<struct<field:string,value:string,detail:string>>"))

    pairs = F.concat(*[pairs_of(f) for f in fields])
    return (
        who.select(*LEADER, "seq")
        .join(mails.select(*MAIL, pairs.alias("pairs")), MAIL)
        .select("mbox", F.col("leader_seq").alias("seq"), F.explode("pairs").alias("p"))
        .select(*MAIL, "p.field", "p.value", "p.detail")
        .distinct()
    )


def _member_items(union_markdown: bool, skip_sonar: bool, keys: list[str] = MARKDOWN_KEYS) -> Column:
    """Markdown items of a member that its leader keeps: ``array<struct<key, item, text>>``, from :func:`_with_leads`."""

    def items_of(key: str):
        shown = section_line if key == "headings" else (lambda x: x)
        pair = lambda x, i: F.struct(F.lit(key).alias("key"), i.alias("item"), shown(x).alias("text"))
        items = F.coalesce(F.transform(F.col(f"markdown.{key}"), pair), F.array().cast("array<struct<key:string,item:int,text:string>>"))
        if key == "lists" and skip_sonar:
            items = F.filter(items, lambda x: F.col("leads") | ~is_sonar(x["text"]))
        return items if union_markdown else F.when(F.col(f"all_{key}"), items).otherwise(F.filter(items, lambda _: F.lit(False)))

    return F.concat(*[items_of(k) for k in keys])


def _with_leads(who: DataFrame, mails: DataFrame) -> DataFrame:
    return who.join(mails, MAIL).withColumn("leads", F.col("seq") == F.col("leader_seq"))


def merged_markdown(who: DataFrame, mails: DataFrame, union_markdown: bool = False, skip_sonar: bool = False) -> DataFrame:
    """(mbox, seq, key, rank, item, text): Markdown items of the members in order.

    A key stays only if all members have it, unless ``union_markdown``.
    """
    joined = _with_leads(who, mails.select(*MAIL, "markdown"))
    return joined.select(
        "mbox", F.col("leader_seq").alias("seq"), "rank", F.explode(_member_items(union_markdown, skip_sonar)).alias("p")
    ).select(*MAIL, "p.key", "rank", "p.item", "p.text")


def merged_texts(who: DataFrame, mails: DataFrame) -> DataFrame:
    """(mbox, seq, rank, body): the leader's body and every other body that is not empty, in order."""
    joined = who.select(*LEADER, "seq", "rank").join(mails.select(*MAIL, "body"), MAIL)
    return joined.where("seq = leader_seq OR body <> ''").select("mbox", F.col("leader_seq").alias("seq"), "rank", "body")


def member_texts(who: DataFrame, mails: DataFrame, union_markdown: bool = False, skip_sonar: bool = False) -> DataFrame:
    """(mbox, seq, text, times): the words of :func:`merged_markdown` and :func:`merged_texts` of one member, each text
    with how often its words count.

    For words only. Sections are the body's lines once more, but for the ``heading_rest`` of extracted mails: where
    they are kept the body counts twice, less the rest, and they are not read. Mails without that column bring
    their sections' text.
    """
    extracted = "heading_rest" in mails.columns
    keys = [k for k in MARKDOWN_KEYS if not (extracted and k == "headings")]
    markdown = F.struct(*[F.col(f"markdown.{k}").alias(k) for k in keys]).alias("markdown")
    joined = _with_leads(who, mails.select(*MAIL, markdown, "body", *(["heading_rest"] if extracted else [])))
    items = F.transform(_member_items(union_markdown, skip_sonar, keys), lambda x: x["text"])
    row = lambda text, times: F.struct(text.alias("text"), times.cast("bigint").alias("times"))
    if extracted:
        twice = F.lit(True) if union_markdown else F.col("all_headings")
        rows = [row(F.col("body"), F.when(twice, 2).otherwise(1)), row(F.when(twice, F.col("heading_rest")), F.lit(-1))]
    else:
        rows = [row(F.col("body"), F.lit(1))]
    rows = F.filter(F.array(*rows, row(F.array_join(items, "\n"), F.lit(1))), lambda r: r["text"] != "")
    return joined.select("mbox", F.col("leader_seq").alias("seq"), F.explode(rows).alias("r")).select(*MAIL, "r.text", "r.times")


class Merged:
    """The tables of the merged mails; where they come from the mails themselves, also the members' texts."""

    NAMES = ("heads", "values", "markdown", "texts")

    def __init__(self, heads: DataFrame, values: DataFrame, markdown: DataFrame, texts: DataFrame, members: DataFrame | None = None):
        self.heads, self.values, self.markdown, self.texts, self.members = heads, values, markdown, texts, members

    def map(self, use) -> "Merged":
        """``use(name, table)`` for each table, such as storing it."""
        return Merged(*[use(name, getattr(self, name)) for name in self.NAMES], self.members)


def merge_by_pr(
    mails: DataFrame, who: DataFrame | None = None, union_markdown: bool = False, skip_sonar: bool = False
) -> Merged:
    """The merged mails of ``mails`` by their ``members``. Both should be stored tables: each result
    reads all of the one and some columns of the other."""
    who = members(mails) if who is None else who
    return Merged(
        merged_heads(who, mails), merged_values(who, mails),
        merged_markdown(who, mails, union_markdown, skip_sonar), merged_texts(who, mails),
        member_texts(who, mails, union_markdown, skip_sonar),
    )
