r"""Conversations as budgeted training windows.

Template: a turn is ``### Role: text</turn>\n``. Control strings inside texts are escaped, and the
escape is undone by reading from the left: ``\`` is ``\\``, ``###`` is ``\h``, ``</turn>`` is ``\t``.
Roles other than user, assistant and system are written ``@role``, escaped the same way with ``:``
as ``\c``.

Windows: prefix sums of turn tokens cut a conversation into spans. With ``stride`` = budget less the
system turn less the history, a turn lies in stride k when it starts there; a turn that crosses into
the next stride is a span of its own. So the new turns of a span never exceed the stride unless one
turn alone does, and nothing depends on a walk from turn to turn. Each window has the system turn,
then the turns before it that reach back at most ``history`` tokens, then its span. Only assistant
texts of the span are under the loss mask: repeated ones are masked.

A turn longer than the budget is a window over the budget, never cut. The system turn is the first
turn if its role is ``system``; one that leaves less than a quarter of the budget makes windows over
the budget too.

Order in a conversation: turn, then role, then text; NULL turns come first. Repeated rows are turns
of their own. NULL text and NULL role are empty texts; a NULL conv_id is one conversation. Other
columns are ignored. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_on

BUDGET = 1024
HISTORY = 256
#: Turn numbers that are summed together; a conversation's sums are then over few rows.
SPAN = 256
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
OPEN, CLOSE = "### ", "</turn>\n"
#: Tokens of a turn's marks.
MARK_TOKENS = 8


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\h"))
    return F.replace(out, F.lit("</turn>"), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """Split at escaped backslashes, read from the left; what lies between has other escapes only."""
    plain = lambda p: F.replace(
        F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>")), F.lit("\\c"), F.lit(":")
    )
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def header(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, shown in NAMES.items():
        known = F.when(role == name, F.lit(shown)).otherwise(known)
    other = F.concat(F.lit("@"), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    return F.concat(F.lit(OPEN), F.coalesce(known, other), F.lit(": "))


def role_of(shown: Column) -> Column:
    known = unescape(F.substring(shown, 2, 1 << 30))
    for name, mark in NAMES.items():
        known = F.when(shown == mark, F.lit(name)).otherwise(known)
    return known


def token_count(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("bigint") + MARK_TOKENS


def prefix_sums(conversations: DataFrame) -> DataFrame:
    """Turns with ``index`` and ``before``, the tokens before the turn, summed in two levels."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"tokens": token_count(F.col("text")), "part": F.floor(F.col("turn") / SPAN)})
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        turns.groupBy("conv_id", "part")
        .agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        .select(
            "conv_id", "part",
            F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("part_before"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_index"),
        )
    )
    numbered = turns.withColumns({
        "in_before": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"),
        "in_index": F.row_number().over(inside) - 1,
    })
    return join_on(numbered, parts, ["conv_id", "part"]).select(
        "conv_id", "role", "text", "tokens",
        (F.col("in_before") + F.col("part_before")).alias("before"),
        (F.col("in_index") + F.col("part_index")).alias("index"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: ``conv_id, window, formatted, loss_spans, n_repeated, n_tokens``.

    ``window`` grows along the conversation; ``loss_spans`` are (start, length) in code points of
    ``formatted``; the first ``n_repeated`` turns of a window have been in an earlier one.
    """
    turns = prefix_sums(conversations)
    is_system = (F.col("index") == 0) & (F.col("role") == "system")
    systems = turns.where(is_system).select(
        "conv_id", F.col("text").alias("system_text"), F.col("tokens").alias("system_tokens")
    )
    with_system = join_on(turns, systems.drop("system_text"), ["conv_id"], "left").withColumn(
        "system_tokens", F.coalesce("system_tokens", F.lit(0))
    )
    stride = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(budget // 4))
    start = F.greatest(F.col("before") - F.col("system_tokens"), F.lit(0))
    first, last = F.floor(start / stride), F.floor((start + F.col("tokens") - 1) / stride)
    spans = with_system.select(
        "conv_id", "index", "role", "text", "tokens", start.alias("start"), is_system.alias("is_system"),
        F.when(is_system, F.lit(-1)).otherwise(2 * first + (last > first).cast("int")).cast("bigint").alias("span"),
    )

    said = spans.where("NOT is_system")
    starts = said.groupBy("conv_id", "span").agg(F.min("start").alias("span_start"))
    near = starts.select("conv_id", F.col("span").alias("window"), "span_start", F.floor(F.col("span_start") / history).alias("reach"))
    back = said.withColumn("first_reach", F.floor(F.col("start") / history)).withColumn(
        "reach", F.explode(F.array(F.col("first_reach"), F.col("first_reach") + 1))
    )
    reached = (F.col("span") < F.col("window")) & (F.col("span_start") - F.col("start") <= history)
    repeated = join_on(back, near, ["conv_id", "reach"], where=reached).select(
        "conv_id", "window", F.lit(1).alias("kind"), "index", "role", "text", "tokens"
    )

    # A conversation of a system turn alone has one window, 0.
    alone = systems.select("conv_id", F.lit(0).cast("bigint").alias("window"), F.lit(True).alias("is_alone"))
    opening = (
        starts.select("conv_id", F.col("span").alias("window"), F.lit(False).alias("is_alone"))
        .unionByName(alone)
        .groupBy("conv_id")
        .agg(F.coalesce(F.min(F.when(~F.col("is_alone"), F.col("window"))), F.lit(0)).alias("opening"))
    )
    headed = join_on(systems, opening, ["conv_id"])
    later = join_on(
        starts.select("conv_id", F.col("span").alias("window")), headed, ["conv_id"], where=F.col("window") > F.col("opening")
    )
    system_rows = (
        headed.select("conv_id", F.col("opening").alias("window"), F.lit(2).alias("kind"), "system_text", "system_tokens")
        .unionByName(later.select("conv_id", "window", F.lit(0).alias("kind"), "system_text", "system_tokens"))
        .select(
            "conv_id", "window", "kind", F.lit(0).cast("bigint").alias("index"), F.lit("system").alias("role"),
            F.col("system_text").alias("text"), F.col("system_tokens").alias("tokens"),
        )
    )
    rows = (
        said.select("conv_id", F.col("span").alias("window"), F.lit(2).alias("kind"), "index", "role", "text", "tokens")
        .unionByName(repeated)
        .unionByName(system_rows)
    )
    rows = rows.select(
        "conv_id", "window", "tokens",
        F.struct(
            "kind", "index", header(F.col("role")).alias("head"), escape(F.col("text")).alias("body"),
            ((F.col("role") == "assistant") & (F.col("kind") == 2)).alias("learn"),
        ).alias("turn"),
    )
    grouped = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.sum("tokens").alias("n_tokens")
    )
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    length = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)
    no_spans = F.array().cast("array<struct<start:int,length:int>>")
    placed = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), no_spans.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + length(t)).alias("at"),
            F.when(
                t["learn"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return grouped.select(
        "conv_id", "window", shown.alias("formatted"), placed["spans"].alias("loss_spans"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"), "n_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows with their new ``turns`` (role, text) and ``loss_text``, read from the text alone."""
    pieces = F.split("formatted", "</turn>\n")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    shown = lambda p: F.regexp_extract(p, r"(?s)^### (.*?): ", 1)
    turns = F.transform(
        new,
        lambda p: F.struct(
            role_of(shown(p)).alias("role"),
            unescape(F.substring(p, F.length(shown(p)) + len(OPEN) + 3, F.lit(1 << 30))).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what ``read_back`` finds.

    A digest is over a whole conversation, so its text is gathered in one row.
    """
    parts = read_back(formatted).select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.col("loss_text").alias("loss"),
        ).alias("part"),
        F.size("turns").cast("bigint").alias("n"),
        F.length("formatted").cast("bigint").alias("chars"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_digests(spark, conversations: DataFrame) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    return digests(windows(conversations.select("conv_id", "turn", "role", "text").unionByName(added)))
