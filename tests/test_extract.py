from mailspark.functions import body as B, route as R, subject as S
from mailspark.functions.html import html_to_text


def test_subject_markers(value_of):
    assert value_of(S.subject_prs, "PR #311, pull request #12 and #90, pr#7") == ["311", "12", "90", "7"]
    assert value_of(S.subject_tickets, "LAMP-19 QQ-70001 qq-1") == ["LAMP-19", "QQ-70001"]
    assert value_of(S.subject_repos, "[a/b] x [c] []") == ["a/b", "c"]


def test_clean_title(value_of):
    assert value_of(S.clean_title, "[tools/lamp] PR #311: Dim light LAMP-19") == "Dim light"
    assert value_of(S.clean_title, "[oven] #90 - Preheat") == "Preheat"
    assert value_of(S.clean_title, "[only] #1") is None
    # #12 is also taken out of #123, in list order
    assert value_of(S.clean_title, "a #12 b #123 c") == "a  b 3 c"


def test_pr_numbers(spark):
    rows = [
        (1, "PR #5 and #5", "<o/r/pull/7/c1@x>", [5, 7]),
        (2, "nothing", "<o/r/pull/0/c1@x>", None),
        (3, "#0", "", [0]),
        (4, "#99999999999999999999999 #3", "", [3]),
        (5, "nothing", None, None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "i int, s string, m string")
    got = {r["i"]: r["p"] for r in df.select("i", S.mail_prs(df["s"], df["m"]).alias("p")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_contributors(value_of):
    assert value_of(S.contributors, "cc @bob @al-x, x@example.com @bob") == ["al-x", "bob", "example"]
    assert value_of(S.contributors, "none") is None


def test_commits(value_of):
    text = "  abcdef1 first  \nabcdef2\nnext line\nnot abcdef3\nABCDEF4 no\nabc no\nabcdef5"
    assert [tuple(c) for c in value_of(B.commits, text)] == [
        ("abcdef1", "abcdef1", "first"),
        ("abcdef2", "abcdef2", "next line"),
        ("abcdef5", "abcdef5", None),
    ]
    assert value_of(B.commits, "abcdef0123456789 m")[0]["short"] == "abcdef0"
    assert value_of(B.commits, "") is None


def test_files(value_of):
    text = "M lamp.js\nA lib/oven/heat.py\nD gone/dial.c\nR100 a/knob b/knob\n M a/x/y\nX z\nMM q"
    assert value_of(B.file_paths, text) == ["lamp.js", "lib/oven/heat.py", "gone/dial.c", "knob", "x/y"]
    assert value_of(lambda c: B.file_components(B.file_paths(c)), text) == sorted(
        {"lamp.js", "lib", "oven", "heat.py", "gone", "dial.c", "knob", "x", "y"}
    )


def test_links_and_tickets(value_of):
    text = "see https://github.com/o/r/pull/12 and HTTP://GITHUB.COM/o/r/pull/12; AB-1 A-2 ABC12-1234567 Q9-77"
    assert value_of(B.linked_prs, text) == [12, 12]
    assert value_of(B.linked_tickets, text) == ["AB-1", "Q9-77"]


def test_code_and_lists(value_of):
    text = "```py\n x = 1 \n```\n- one\n  2. two\n* \nthree\n-no"
    assert value_of(B.code_blocks, text) == ["x = 1"]
    assert value_of(B.list_items, text) == ["- one", "2. two", "* \nthree"]
    assert value_of(B.list_markers, text) == ["-", "2.", "*"]


def test_sections(spark):
    text = "intro \n\n# Title \nline 1\r\n   \nSummary (v2)\nsummary\nwhat changed?\nlast\x0bmore\n## \n"
    df = spark.createDataFrame([(text,), ("",), ("# only",)], "b string").select(B.body_lines(F_col("b")).alias("l"))
    got = [r["s"] and [(s["heading"], s["lines"]) for s in r["s"]] for r in df.select(B.sections_of_lines(df["l"]).alias("s")).collect()]
    assert got[0] == [
        (None, ["intro"]), ("Title", ["line 1"]), ("Summary", []), ("summary", []),
        ("what changed?", ["last", "more", "##"]),
    ]
    assert got[1] is None
    assert got[2] == [("only", [])]


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_html(value_of):
    page = (
        "<!DOCTYPE html><p> a &lt;b&gt; <b>c</b>d</p><script>x<y</script><style>p{}</style>"
        "<!-- gone --> 1 < 2 &amp;lt; &#65;&#x42;&#150;&unknown; caf&eacute;"
    )
    assert value_of(html_to_text, page) == "a <b>\nc\nd\n1 < 2 &lt; AB\N{EN DASH}&unknown; café"
    assert value_of(html_to_text, "<p></p>") == ""
    assert value_of(html_to_text, "&#1114112; &#xD800;") == "\N{REPLACEMENT CHARACTER} \N{REPLACEMENT CHARACTER}"


def test_routing(value_of):
    assert value_of(R.question_commit, "what is ABCDEF1?") == "abcdef1"
    assert value_of(R.question_commit, "pr 12") is None
    assert value_of(R.question_pr, "pr #1234 commits and file changes") == 1234
    assert value_of(R.question_pr, "pull #5 or PR # 6") == 6
    assert value_of(R.question_pr, "PR 77 now") == 77
    assert value_of(R.question_pr, "pr #12 in 1234567") is None
    assert value_of(R.question_pr, "price 3") is None


def test_html_attributes(value_of):
    assert value_of(html_to_text, '<a title="x>y" href="z">link</a>') == "link"
    assert value_of(html_to_text, "<p a='>'>b<br/>c &#62; &#x3e; &amp;gt;") == "b\nc > > &gt;"
    assert value_of(html_to_text, '<a title="open>text</a>') == "text"
    assert value_of(html_to_text, "<p " + 'a="b" ' * 5000 + ">x") == "x"
