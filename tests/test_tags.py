import json
from pathlib import Path

from mailspark.functions import tags as T

GIVEN = json.loads((Path(__file__).parent / "data/tag_titles.json").read_text())["titles"]
TITLES = [
    *map(tuple, GIVEN),
    ("sql_injection and SQL-injection", ["security", "sql"]),
    ("sqlinjection", ["security"]),
    ("stop sql injection!", ["security", "sql"]),
    ("sql  injection", ["sql"]),
    ("nosql injections", []),
    ("authorization, endpoints", ["api", "security"]),
    ("fixé préfix fix_me unfix", []),
    ("optimising optimi optimisation", ["performance"]),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TITLES)], "i int, title string")
    got = {r["i"]: r["tags"] for r in df.select("i", T.tags_of_text(df["title"]).alias("tags")).collect()}
    assert [got[i] for i in range(len(TITLES))] == [want for _, want in TITLES]


def test_file_rules(spark):
    rows = [
        (["src", "ui", "view.css"], ["ui"]),
        (["src/ui/view.txt"], ["ui"]),
        (["a/auth/x"], ["authentication", "security"]),
        (["UserDao"], []),
        (["LoginController.JAVA"], ["api", "authentication", "backend"]),
        (["main.ts"], ["backend"]),
        ([], []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(rows)], "i int, files array<string>")
    got = {r["i"]: r["t"] for r in df.select("i", T.tags_of_files(df["files"]).alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_substring_rules(value_of):
    assert value_of(T.tags_by_substring, "Rebuild OAuth table, prefix") == [
        "auth", "authentication", "bug", "database", "fix", "sql", "ui"
    ]
    assert value_of(T.tags_by_substring, None) == []
