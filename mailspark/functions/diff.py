"""Changed lines of unified diffs inside a text, per file, as one fold over its lines.

The fold is a small state machine. Outside a hunk a line may open a file (``diff --git``, or ``---`` with
``+++`` on the next line), say what happens to it (new, deleted, renamed, binary) or open a hunk. A hunk's
header says how many old and new lines follow, and so many are counted whatever they look like: a removed
line ``-- a/x`` is no file header, and a diff quoted inside a hunk is text. A line that can't belong to a
hunk ends it. Text between diffs is skipped.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import once

GIT_HEADER = r"^diff --git (?:\"?a/)(.*?)\"? \"?b/(.*?)\"?$"
OLD_FILE = r"^--- (?:a/)?([^\t]+?)\s*(?:\t.*)?$"
NEW_FILE = r"^\+\+\+ (?:b/)?([^\t]+?)\s*(?:\t.*)?$"
HUNK = r"^@@ -(\d{1,9})(?:,(\d{1,9}))? \+(\d{1,9})(?:,(\d{1,9}))? @@"
BINARY = r"^(?:Binary files .* differ|GIT binary patch)$"
NONE = "/dev/null"

FILE = T.StructType([
    T.StructField("old_path", T.StringType()),
    T.StructField("new_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("hunks", T.IntegerType()),
    T.StructField("added", T.IntegerType()),
    T.StructField("removed", T.IntegerType()),
])
_FIELDS = ["files", "file", "minus", "old", "new"]


def _state(**parts: Column) -> Column:
    return F.struct(*[parts[n].alias(n) for n in _FIELDS])


def _file(old: Column, new: Column) -> Column:
    zero = F.lit(0)
    status = F.when(old == NONE, F.lit("added")).when(new == NONE, F.lit("deleted")).otherwise(F.lit("modified"))
    fields = [old, new, status, zero, zero, zero]
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(fields, FILE.fields)])


def _with(file: Column, **new: Column) -> Column:
    return F.struct(*[new.get(n, file[n]).alias(n) for n in FILE.names])


def _step(acc: Column, line: Column) -> Column:
    nothing = F.lit(None).cast("string")
    zero = F.lit(0)
    file, sign = acc["file"], F.left(line, F.lit(1))
    keep = lambda **new: _state(**({n: acc[n] for n in _FIELDS} | new))
    ended = F.when(file.isNull(), acc["files"]).otherwise(F.array_append(acc["files"], file))

    def count(i: int) -> Column:
        text = F.regexp_extract(line, HUNK, i)
        return F.when(text == "", 1).otherwise(text.cast("int"))

    # Inside a hunk a context line may have lost its blank.
    in_hunk = (acc["old"] > 0) | (acc["new"] > 0)
    context = ((sign == " ") | (line == "")) & (acc["old"] > 0) & (acc["new"] > 0)
    plus, minus = (sign == "+") & (acc["new"] > 0), (sign == "-") & (acc["old"] > 0)
    inside = (
        F.when(plus, keep(file=_with(file, added=file["added"] + 1), new=acc["new"] - 1))
        .when(minus, keep(file=_with(file, removed=file["removed"] + 1), old=acc["old"] - 1))
        .when(context, keep(old=acc["old"] - 1, new=acc["new"] - 1))
        .when(sign == "\\", acc)
    )

    has_file = file.isNotNull()
    # A file that ``diff --git`` opened and that has no hunk yet gets its paths from the next two lines.
    fresh = has_file & (file["hunks"] == 0) & (file["status"] != "binary")
    paths = _file(acc["minus"], F.regexp_extract(line, NEW_FILE, 1))
    status = F.when(file["status"] == "renamed", file["status"]).otherwise(paths["status"])
    git = line.rlike(GIT_HEADER)
    outside = (
        F.when(git, _state(
            files=ended, file=_file(F.regexp_extract(line, GIT_HEADER, 1), F.regexp_extract(line, GIT_HEADER, 2)), minus=nothing, old=zero, new=zero))
        .when(acc["minus"].isNotNull() & line.rlike(NEW_FILE), F.when(
            fresh, keep(file=_with(file, old_path=paths["old_path"], new_path=paths["new_path"], status=status), minus=nothing, old=zero, new=zero)
        ).otherwise(_state(files=ended, file=paths, minus=nothing, old=zero, new=zero)))
        .when(line.rlike(OLD_FILE), keep(minus=F.regexp_extract(line, OLD_FILE, 1), old=zero, new=zero))
        .when(has_file & line.rlike(HUNK), keep(file=_with(file, hunks=file["hunks"] + 1), minus=nothing, old=count(2), new=count(4)))
        .when(fresh & F.startswith(line, F.lit("new file mode ")), keep(file=_with(file, status=F.lit("added")), minus=nothing, old=zero, new=zero))
        .when(fresh & F.startswith(line, F.lit("deleted file mode ")), keep(file=_with(file, status=F.lit("deleted")), minus=nothing, old=zero, new=zero))
        .when(fresh & F.startswith(line, F.lit("rename to ")), keep(file=_with(file, status=F.lit("renamed")), minus=nothing, old=zero, new=zero))
        .when(fresh & line.rlike(BINARY), keep(file=_with(file, status=F.lit("binary")), minus=nothing, old=zero, new=zero))
        .otherwise(keep(minus=nothing, old=zero, new=zero))
    )
    return F.when(in_hunk, F.coalesce(inside, outside)).otherwise(outside)


def change_counts(text: Column) -> Column:
    """``array<struct<old_path, new_path, status, hunks, added, removed>>`` of the files in a text's diffs.

    ``status`` is added, deleted, modified, renamed or binary. A text without a diff, or NULL, has none.
    """
    file = F.lit(None).cast(FILE)
    zero = F.lit(0)
    start = _state(files=F.array().cast(T.ArrayType(FILE)), file=file, minus=F.lit(None).cast("string"), old=zero, new=zero)
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    folded = once(
        F.aggregate(lines, start, _step),
        lambda acc: F.when(acc["file"].isNull(), acc["files"]).otherwise(F.array_append(acc["files"], acc["file"])),
    )
    # Most mails hold no diff at all.
    return F.when(F.contains(text, F.lit("+++ ")) | F.contains(text, F.lit("diff --git ")), folded).otherwise(F.array().cast(T.ArrayType(FILE)))
