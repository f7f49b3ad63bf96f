"""DuckDB SQL that gives the same rows as each query, stated in its own way where it can be."""

from html.entities import html5

from ..functions import patterns as P
from ..sources.derived import PR_BASE, PR_COUNT, SUBJECT_WORD, TITLES

SEP = "\x1f"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """Pattern literal for RE2, which has no ``d`` flag."""
    return q(pattern.replace("(?md)", "(?m)").replace("(?imd)", "(?im)"))


def strip(x: str) -> str:
    return f"trim({x}, {q(P.SPACES)})"


def some(x: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN {x} END"


def csv(x: str) -> str:
    return f"array_to_string({x}, {q(SEP)})"


def text_list(x: str) -> str:
    return csv(f"list_transform({x}, lambda v: CAST(v AS VARCHAR))")


def every(n: int, rest: int, text: str) -> str:
    return f"CASE WHEN doc_id % {n} = {rest} THEN {text} END"


NL = "chr(10)"
PR = f"CAST({PR_BASE} + doc_id % {PR_COUNT} AS VARCHAR)"
PR2 = f"CAST({PR_BASE} + (doc_id + 7) % {PR_COUNT} AS VARCHAR)"
ID = "CAST(doc_id AS VARCHAR)"

MAILS = f"""m AS (
  SELECT source AS mbox, doc_id AS seq, text AS doc_text,
    '[' || lang || '/' || source || '] ' || ([{', '.join(q(t) for t in TITLES)}])[doc_id % {len(TITLES)} + 1]
      || ' ' || array_to_string(list_reduce(regexp_extract_all(text, {q(SUBJECT_WORD)}), lambda seen, w: CASE WHEN list_contains(seen, w) THEN seen ELSE list_append(seen, w) END, []::VARCHAR[]), ' ')
      || coalesce({every(7, 0, "' TCK-' || (doc_id % 97)")}, '')
      || coalesce({every(19, 4, "' @dev-' || (doc_id % 5)")}, '')
      || CASE WHEN doc_id % 11 = 0 OR doc_id % 17 = 3 THEN ''
              WHEN doc_id % 13 = 0 THEN ' (PR #' || {PR} || ') pull request #' || {PR2}
              ELSE ' (PR #' || {PR} || ')' END AS subject,
    'dev-' || (doc_id % 7) || '@example.com' AS sender,
    'Mon, 1 Jan 2024 00:00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || ' +0000' AS date,
    '<' || lang || '/' || source || CASE WHEN doc_id % 11 = 0 THEN '/issue/' ELSE '/pull/' END || {PR}
      || '/c' || doc_id || '@example.com>' AS message_id,
    concat_ws({NL}, text,
      {every(3, 0, f"'Summary (v1)' || {NL} || 'This change fixes the index display.'")},
      {every(4, 0, f"'# Notes' || {NL} || '- first item' || {NL} || '* second item ' || doc_id || {NL} || '1. third'")},
      {every(6, 1, f"'```sql' || {NL} || 'select ' || (doc_id % 3) || {NL} || '```'")},
      {every(5, 1, f"left(md5({ID}), 12) || ' commit message ' || (doc_id % 10)")},
      {every(10, 4, f"left(md5({ID}), 7)")},
      {every(2, 0, f"'M a/src/db/x' || (doc_id % 9) || '.py' || {NL} || 'A web/ui/view.css'")},
      {every(8, 3, "'R100 a/old/p.go b/new/p.go'")},
      {every(9, 2, f"'see https://github.com/o/r/pull/' || {PR} || ' here'")},
      {every(12, 5, "'Relates to PROJ-' || (doc_id % 50)")},
      {every(14, 6, "'cc @dev-' || (doc_id % 7)")}) AS body
  FROM documents)"""


def find(col: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({col}, {rx(pattern)}, {group})"


def numbers(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda v: TRY_CAST(v AS BIGINT)), lambda v: v IS NOT NULL)"


TITLE = (
    "nullif(trim(list_reduce(s_tickets, lambda acc, t: regexp_replace(acc, '\\b' || t || '[:\\-\\s]*', '', 'g'),"
    f" list_reduce(s_prs, lambda acc, p: regexp_replace(acc, '(?i)' || {q(P.PR_MARK)} || p, '', 'g'),"
    " list_reduce(s_repos, lambda acc, r: replace(acc, '[' || r || ']', ''), subject))), ' -:_'), '')"
)
MSG_PR = f"TRY_CAST(regexp_extract(message_id, {rx(P.MESSAGE_ID_PR)}, 1) AS BIGINT)"
COMMITS = (
    f"list_transform(list_zip({find('body', P.COMMIT_LINE, 1)}, {find('body', P.COMMIT_LINE, 2)}), "
    f"lambda z: {{'sha': z[1], 'short': left(z[1], 7), 'message': nullif({strip("coalesce(z[2], '')")}, '')}})"
)
PATHS = find("body", P.FILE_LINE)
PARTS = f"list_sort(list_distinct(flatten(list_transform({PATHS}, lambda p: string_split(p, '/')))))"
CODE = f"list_transform({find('body', P.CODE_FENCE)}, lambda b: {strip('b')})"
LISTS = f"list_transform({find('body', P.LIST_LINE, 0)}, lambda b: {strip('b')})"

SUBJECTS = f"""s AS (
  SELECT *, {find('subject', P.SUBJECT_PR)} AS s_prs, {find('subject', P.SUBJECT_REPO)} AS s_repos,
    {find('subject', P.SUBJECT_TICKET)} AS s_tickets
  FROM m),
x AS (
  SELECT mbox, seq, subject, sender, date, message_id, body, s_prs, s_repos, s_tickets,
    {TITLE} AS pr_title,
    {some(f"list_sort(list_distinct(list_concat({numbers('s_prs')}, CASE WHEN {MSG_PR} <> 0 THEN [{MSG_PR}] ELSE [] END)))")} AS pr_numbers,
    {some('s_repos')} AS repos, {some('s_tickets')} AS tickets,
    {some(f"list_sort(list_distinct({find('subject', P.MENTION)}))")} AS contributors
  FROM s)"""

BODIES = f"""b AS (
  SELECT *, {some(COMMITS)} AS commits, {some(PATHS)} AS file_paths, {some(PARTS)} AS files_modified,
    {some(numbers(find('body', P.BODY_PR_LINK)))} AS linked_prs,
    {some(find('body', P.BODY_TICKET))} AS linked_tickets,
    {some(CODE)} AS code_blocks, {some(LISTS)} AS lists
  FROM x)"""

# Lines numbered, a running count of headings as section number.
SECTIONS = f"""l AS (
  SELECT mbox, seq, unnest(string_list) AS raw_line, generate_subscripts(string_list, 1) AS pos
  FROM (SELECT mbox, seq, regexp_split_to_array(body, {q(P.LINE_BREAK)}) AS string_list FROM m)),
l2 AS (
  SELECT mbox, seq, pos, rtrim(raw_line, {q(P.SPACES)}) AS line FROM l),
l3 AS (
  SELECT *, CASE WHEN regexp_matches(line, {q(P.HASH_HEADING)}) THEN {strip(f"regexp_extract(line, {q(P.HASH_HEADING)}, 1)")}
                 WHEN regexp_matches(line, {q(P.PLAIN_HEADING)}) THEN {strip(f"regexp_extract(line, {q(P.PLAIN_HEADING)}, 1)")} END AS heading
  FROM l2 WHERE line <> ''),
l4 AS (
  SELECT *, count(heading) OVER (PARTITION BY mbox, seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM l3),
sec AS (
  SELECT mbox, seq, sec, max(heading) AS heading,
    coalesce(list(line ORDER BY pos) FILTER (heading IS NULL), []) AS lines
  FROM l4 GROUP BY mbox, seq, sec),
heads AS (
  SELECT mbox, seq, list({{'heading': heading, 'lines': lines}} ORDER BY sec) AS headings FROM sec GROUP BY mbox, seq)"""


def word_tags(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    cases = []
    for tag, words in P.WORD_TAGS.items():
        phrase = [P.PHRASE_TAGS[tag][1]] if tag in P.PHRASE_TAGS else []
        pattern = f"(?:^|{P.NOT_WORD})(?:{'|'.join(words + phrase)})(?:$|{P.NOT_WORD})"
        cases.append(f"CASE WHEN regexp_matches({low}, {q(pattern)}) THEN {q(tag)} END")
    return f"list_sort(list_filter([{', '.join(cases)}], lambda v: v IS NOT NULL))"


def file_tags(x: str) -> str:
    cases = []
    for tag, needles in P.FILE_TAGS.items():
        tests = " OR ".join(f"contains(lower(f), {q(n)})" for n in needles)
        cases.append(f"CASE WHEN len(list_filter(coalesce({x}, []), lambda f: {tests})) > 0 THEN {q(tag)} END")
    return f"list_sort(list_filter([{', '.join(cases)}], lambda v: v IS NOT NULL))"


def substring_tags(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    parts = [
        f"CASE WHEN {' OR '.join(f'contains({low}, {q(n)})' for n in needles)} THEN [{', '.join(map(q, tags))}] ELSE [] END"
        for needles, tags in P.SUBSTRING_TAGS
    ]
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


SECTION_TAGS = word_tags("array_to_string(flatten(list_transform(headings, lambda h: h.lines)), ',')")
EXTRACTED = f"""e AS (
  SELECT b.*, h.headings,
    {some(f"list_sort(list_distinct(flatten([{word_tags('pr_title')}, {file_tags('files_modified')}, {SECTION_TAGS}])))")} AS tags
  FROM b LEFT JOIN heads h USING (mbox, seq))"""

STACK = f"{MAILS},\n{SUBJECTS},\n{BODIES},\n{SECTIONS},\n{EXTRACTED}"

MEMBERS = """lead AS (
  SELECT mbox, seq, min(seq) OVER (PARTITION BY mbox, pr) AS leader
  FROM (SELECT mbox, seq, unnest(pr_numbers) AS pr FROM e)),
who AS (
  SELECT mbox, seq, leader FROM lead
  UNION SELECT mbox, min(seq), min(seq) FROM e GROUP BY mbox)"""
MEMBERS_ALL = MEMBERS.replace(
    "SELECT mbox, min(seq), min(seq) FROM e GROUP BY mbox", "SELECT mbox, seq, seq FROM e WHERE pr_numbers IS NULL"
)


def union_of(c: str) -> str:
    return f"list_sort(list_distinct(flatten(list({c}) FILTER ({c} IS NOT NULL)))) AS {c}"


UNIONS = ["repos", "tickets", "commits", "files_modified", "file_paths", "tags", "linked_prs", "linked_tickets", "contributors"]


def merged(members: str = MEMBERS) -> str:
    """r: members with their leader; g: one row per leader with arrays; v, md, tx: the row tables."""
    header = ["subject", "sender", "date", "message_id", "pr_title", "pr_numbers"]
    keys = {"code_blocks": "x", "headings": SECTION_LINE, "lists": "x"}
    flags = ", ".join(f"bool_and({c} IS NOT NULL) OVER (PARTITION BY mbox, leader) AS all_{c}" for c in keys)
    values = " UNION ".join(
        f"SELECT mbox, leader AS seq, {q(f)} AS field, CAST(x AS VARCHAR) AS value, NULL AS detail FROM (SELECT mbox, leader, unnest({f}) AS x FROM r)"
        for f in UNIONS if f not in ("tags", "commits")
    )
    items = " UNION ALL ".join(
        f"SELECT mbox, leader AS seq, {q(k)} AS key, rank, item - 1 AS item, {text} AS text, all_{k} AS every, seq = leader AS leads "
        f"FROM (SELECT mbox, leader, seq, rank, all_{k}, unnest({k}) AS x, generate_subscripts({k}, 1) AS item FROM r)"
        for k, text in keys.items()
    )
    return f"""{members},
r AS (
  SELECT e.*, leader, row_number() OVER (PARTITION BY mbox, leader ORDER BY seq) AS rank,
    count(*) OVER (PARTITION BY mbox, leader) AS members, {flags}
  FROM who JOIN e USING (mbox, seq)),
g AS (
  SELECT mbox, leader AS seq, max(members) AS members,
    {', '.join(f"any_value({c}) FILTER (seq = leader) AS {c}" for c in header)},
    {', '.join(union_of(c) for c in UNIONS)}
  FROM r GROUP BY mbox, leader),
v AS (
  {values}
  UNION SELECT mbox, leader, 'commits', x.sha, x.message FROM (SELECT mbox, leader, unnest(commits) AS x FROM r)),
md AS ({items}),
tx AS (SELECT mbox, leader AS seq, rank, body FROM r WHERE seq = leader OR body <> '')"""


SECTION_LINE = "CASE WHEN x.heading IS NULL THEN '' ELSE x.heading || ': ' END || array_to_string(x.lines, ' | ')"
SECTIONS_TEXT = csv("list_transform(headings, lambda s: coalesce(s.heading, '-') || ':' || array_to_string(s.lines, '|'))")
HEAD_COLUMNS = f"""mbox, seq, members, subject, sender, date, message_id, pr_title,
  {text_list('pr_numbers')} AS pr_numbers, {csv('tags')} AS tags"""
MERGED = f"{STACK},\n{merged()}"


def rendered(sections: list[tuple[str, str, str]]) -> str:
    """Rows of a rendered mail from (source, label, text expression)."""
    out = []
    for n, (source, label, text) in enumerate(sections, 1):
        table, place = {
            "head": ("g", "0, 0"), "text": ("tx", "rank, 0"),
        }.get(source, ("v", "0, 0"))
        where = f"WHERE {text} <> ''" if source == "head" else f"WHERE field = {q(source)}"
        if source == "text":
            where = ""
        if source.startswith("md "):
            table, place, where = "md", "rank, item", f"WHERE key = {q(source[3:])} AND every"
        rank, item = place.split(", ")
        out.append(f"SELECT mbox, seq, {n} AS section, {q(label)} AS label, {rank} AS rank, {item} AS item, {text} AS text FROM {table} {where}")
    return " UNION ALL ".join(out)


_MARKDOWN = [(f"md {k}", f"## {k}", "'- ' || text") for k in ["code_blocks", "headings", "lists"]]
_TAGS, _NUMBERS = "array_to_string(tags, ', ')", "array_to_string(list_transform(pr_numbers, lambda n: CAST(n AS VARCHAR)), ', ')"
FULL_TEXT = rendered([
    ("head", "Tags: ", _TAGS), ("head", "Title: ", "pr_title"), ("head", "PR Numbers: ", _NUMBERS), ("repos", "Repos: ", "value"),
    ("tickets", "Tickets: ", "value"), *_MARKDOWN, ("commits", "", "left(value, 7) || ',' || coalesce(detail, '')"),
    ("files_modified", "", "value"), ("linked_prs", "Linked PRs: ", "value"), ("linked_tickets", "Linked Tickets: ", "value"),
    ("contributors", "Contributors: ", "value"), ("text", "", "body"),
])
CONTEXT_ROWS = rendered([
    ("head", "Tags: ", _TAGS), ("head", "PR Numbers: ", _NUMBERS), ("repos", "Repos: ", "value"), ("tickets", "Tickets: ", "value"),
    ("head", "Title: ", "pr_title"), ("commits", "Commits:", "'- ' || concat_ws(' ', left(value, 7), detail)"),
    ("files_modified", "Files Changed:", "'- ' || value"), *_MARKDOWN, ("contributors", "Contributors: ", "value"),
    ("text", "Email Body:", "body"),
])


ITEM_PR = f"CAST({PR_BASE} + item_id % {PR_COUNT} AS VARCHAR)"
QUESTIONS = f"""qs AS (
  SELECT item_id AS query_id, CASE item_id % 8
      WHEN 0 THEN 'pr #' || {ITEM_PR} || ' commits and file changes. '
      WHEN 1 THEN 'What did commit ' || left(md5(CAST(item_id * 5 + 1 AS VARCHAR)), 7) || ' change? '
      WHEN 2 THEN '  Pull Request # ' || {ITEM_PR} || ' summary '
      WHEN 3 THEN 'why is the database query slow in the dashboard ui? '
      WHEN 4 THEN 'status of PR 99999 '
      WHEN 5 THEN 'api and security of src15 view.css ' || {ITEM_PR} || ' TCK-7 '
      WHEN 6 THEN 'pull #' || {ITEM_PR} || ' and pr #1 '
      ELSE '' END || text AS text
  FROM benchmark)"""
_PR_HITS = ", ".join(f"nullif(regexp_extract(lower(question), {q(p)}, 1), '')" for p in P.QUESTION_PRS)
ROUTES = f"""{QUESTIONS},
r1 AS (SELECT query_id, {strip('text')} AS question FROM qs),
r2 AS (SELECT *, nullif(regexp_extract(lower(question), {q(P.QUESTION_COMMIT)}, 0), '') AS commit FROM r1),
r3 AS (SELECT *, CASE WHEN commit IS NULL THEN TRY_CAST(coalesce({_PR_HITS}) AS BIGINT) END AS pr FROM r2),
r4 AS (SELECT *, CASE WHEN commit IS NOT NULL THEN 'commit' WHEN pr <> 0 THEN 'pr' ELSE 'semantic' END AS mode FROM r3),
routes AS (SELECT *, CASE mode WHEN 'commit' THEN commit WHEN 'pr' THEN CAST(pr AS VARCHAR) END AS key FROM r4)"""

KEYS = """mail_pr AS (SELECT unnest(pr_numbers) AS pr, mbox, seq FROM g),
mail_commit AS (
  SELECT DISTINCT k AS key, mbox, seq FROM (
    SELECT unnest([value, left(value, 7), detail]) AS k, mbox, seq FROM v WHERE field = 'commits')
  WHERE k IS NOT NULL)"""
LOOKUPS = f"{MERGED},\n{KEYS},\n{ROUTES}"
KEY_CONTEXTS = f"""hits AS (
  SELECT DISTINCT mode, key, mbox, seq FROM (
    SELECT mode, routes.key, mbox, seq FROM routes JOIN mail_commit ON routes.commit = mail_commit.key WHERE mode = 'commit'
    UNION ALL SELECT mode, key, mbox, seq FROM routes JOIN mail_pr USING (pr) WHERE mode = 'pr')),
cr AS ({CONTEXT_ROWS}),
key_contexts AS (SELECT mode, key, mbox, seq, section, label, rank, item, text FROM hits JOIN cr USING (mbox, seq))"""

# The native encoder: words by inverse document frequency, hashed with a sign to 64 places.
_ASK_WORDS = "SELECT query_id, w, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM asks) GROUP BY ALL"


def _unit(counts: str, keys: str) -> str:
    return f"""(SELECT {keys}, list(CAST(round(coalesce(x, 0) / norm, 6) + 0.0 AS FLOAT) ORDER BY place) AS embedding FROM (
      SELECT {keys}, place, x, sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS norm
      FROM (SELECT DISTINCT {keys} FROM {counts}) CROSS JOIN (SELECT unnest(range(64)) AS place)
      LEFT JOIN (
        SELECT {keys}, CAST('0x' || left(md5(w), 4) AS INTEGER) % 64 AS place,
          sum(n * (ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0)
            * CASE WHEN CAST('0x' || substr(md5(w), 5, 1) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x
        FROM {counts} LEFT JOIN df USING (w) CROSS JOIN (SELECT count(DISTINCT (mbox, seq)) AS total FROM ft)
        GROUP BY ALL) USING ({keys}, place)) WHERE norm > 0 GROUP BY {keys})"""


def vectors(asks: str = "qs") -> str:
    """mv: vectors of merged mails, qv: of questions."""
    return f"""ft AS ({FULL_TEXT}),
asks AS (SELECT query_id, text FROM {asks}),
mw AS (
  SELECT mbox, seq, w, count(*) AS n FROM (
    SELECT mbox, seq, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ft) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM mw GROUP BY w),
qw AS ({_ASK_WORDS}),
mv AS {_unit('mw', 'mbox, seq')},
qv AS {_unit('qw', 'query_id')}"""


DIST = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2))"


def nearest(k: int, questions: str = "benchmark", qid: str = "item_id") -> str:
    return f"""near AS (
  SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank
  FROM (SELECT a.{qid} AS query_id, v.vec_id, {DIST.format('qv.embedding', 'v.embedding')} AS dist
        FROM {questions} a JOIN embeddings qv ON qv.vec_id = a.{qid} CROSS JOIN embeddings v)
  QUALIFY rank <= {k})"""


def knn(k: int, questions: str = "benchmark", qid: str = "item_id") -> str:
    return f"WITH {nearest(k, questions, qid)} SELECT query_id, vec_id, rank, round(dist, 4) AS dist FROM near"


def mail_near(k: int) -> str:
    """Mails near each question by the native encoder."""
    return f"""near AS (
  SELECT query_id, mbox, seq, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, mbox, seq) AS rank
  FROM (SELECT query_id, mbox, seq, {DIST.format('qv.embedding', 'mv.embedding')} AS dist FROM qv CROSS JOIN mv)
  QUALIFY rank <= {k})"""


def boosted(question: str) -> str:
    return f"3 * len(list_filter(coalesce(tags, []), lambda t: contains(lower({question}), lower(t))))"


ANSWERS = f"""{LOOKUPS},
{KEY_CONTEXTS},
asked AS (SELECT query_id, question AS text FROM routes WHERE mode = 'semantic'),
{vectors('asked')},
{mail_near(5)},
reranked AS (
  SELECT query_id, mbox, seq, row_number() OVER (PARTITION BY query_id ORDER BY {boosted('text')} DESC, rank) AS position
  FROM near JOIN g USING (mbox, seq) JOIN asked USING (query_id)),
all_contexts AS (
  SELECT query_id, routes.mode, routes.key, 0 AS position, mbox, seq, section, label, rank, item, text
  FROM routes JOIN key_contexts USING (mode, key)
  UNION ALL
  SELECT query_id, 'semantic', NULL, position, mbox, seq, section, label, rank, item, text FROM reranked JOIN cr USING (mbox, seq))"""


def _prompt() -> str:
    cases = []
    for mode, form in P.PROMPTS.items():
        cases.append(f"WHEN {q(mode)} THEN replace({q(form.removesuffix('{context}'))}, '{{key}}', coalesce(key, '')) ")
    return "CASE mode " + " ".join(cases) + " END"


_SCORED = [
    ("pr", "CAST(v AS VARCHAR)", "pr_numbers"), ("repo", "v", "repos"), ("ticket", "v", "tickets"),
    ("commit", "v.short", "commits"), ("file", "v", "files_modified"), ("title", "v", "[pr_title]"),
    ("tag", "v", "tags"), ("contributor", "v", "contributors"),
]
SCORE = " + ".join(
    f"{P.SCORE_WEIGHTS[f]} * len(list_filter(coalesce({c}, []), lambda v: {e} <> '' AND contains(lower(text), lower({e}))))"
    for f, e, c in _SCORED
)


def lexical(k: int) -> str:
    return f"""scored AS (
  SELECT query_id, mbox, seq, CAST({SCORE} AS DOUBLE) AS score FROM qs CROSS JOIN g),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mbox, seq) AS rank
  FROM scored WHERE score > 0 QUALIFY rank <= {k})"""


FOLDED = "CASE WHEN seq % 5 = 0 THEN replace(subject, '] ', ']' || chr(10) || ' ') ELSE subject END"
_NAMES = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in html5.items()) + "}"
_OPENING = "list_max(list_transform(list_filter(map_keys(names), lambda k: NOT ends_with(k, ';') AND starts_with(substr(r, 2), k)), lambda k: {'n': length(k), 'k': k})).k"
# Stated apart from the column expression, in RE2's terms.
_REFERENCE = r"&(?:#\d+|#[xX][\da-fA-F]+|[a-zA-Z][a-zA-Z\d]*);?"
_MARKUP = (
    r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[^>]*>|\z)|<style\b.*?(?:</style[^>]*>|\z)"""
    r"""|<template\b.*?(?:</template[^>]*>|\z)|<[!/?a-z](?:"[^"]*"|'[^']*'|[^"'>])*>"""
)


def html_text(col: str) -> str:
    """Text nodes of HTML, named references decoded (the pages hold no numeric ones)."""
    decoded = (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array(n, {q(_REFERENCE)}), "
        f"list_transform(regexp_extract_all(n, {q(_REFERENCE)}, 0), lambda r: coalesce(names[substr(r, 2)], names[{_OPENING}] || substr(r, 2 + length({_OPENING})), r))), "
        "lambda z: z[1] || coalesce(z[2], '')), '')"
    )
    nodes = f"list_transform(regexp_split_to_array({col}, {q(_MARKUP)}), lambda n: {strip(decoded)})"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), chr(10))"


def over_mails(columns: str, source: str = "m") -> str:
    with_ = {"m": MAILS, "x": f"{MAILS},\n{SUBJECTS}", "b": f"{MAILS},\n{SUBJECTS},\n{BODIES}", "e": STACK}[source]
    return f"WITH {with_} SELECT mbox, seq, {columns} FROM {source}"


PLAIN_PART = "CASE seq % 4 WHEN 1 THEN 'quoted-printable' WHEN 2 THEN 'base64' ELSE '' END"
PAGE_PART = """'<html><body><p>' || replace(replace(replace(doc_text, '&', '&amp;'), '<', '&lt;'), '>', '&#62;') || '</p></body></html>'"""

# What mails name, and what can be reached from each node.
LINKS = f"""{STACK},
lk AS (
  SELECT DISTINCT mbox, seq, kind, value FROM (
    SELECT mbox, seq, 'pr' AS kind, CAST(unnest(list_concat(coalesce(pr_numbers, []), coalesce(linked_prs, []))) AS VARCHAR) AS value FROM e
    UNION ALL SELECT mbox, seq, 'ticket', unnest(list_concat(coalesce(tickets, []), coalesce(linked_tickets, []))) FROM e
    UNION ALL SELECT mbox, seq, 'commit', c.sha FROM (SELECT mbox, seq, unnest(commits) AS c FROM e)))"""
REACHED = f"""{LINKS},
one AS (
  SELECT 'mail/' || mbox || '/' || seq AS a, CASE kind WHEN 'pr' THEN 'pr/' || mbox || '/' || value ELSE kind || '/' || value END AS b FROM lk),
two AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reached AS (SELECT a AS node, a AS other FROM two UNION SELECT node, b FROM reached JOIN two ON other = a),
comp AS (SELECT node, min(other) AS component FROM reached GROUP BY node)"""

_M = lambda n: f"'<m' || ({n}) || '@example.com>'"
# The walk up from each mail: to a mail without a parent, or to one it has been at.
THREADS = f"""h AS (
  SELECT source AS mbox, doc_id AS seq, {_M('doc_id')} AS mid,
    CASE WHEN doc_id % 101 = 7 THEN [{_M('doc_id')}] WHEN doc_id % 103 = 10 THEN [{_M('doc_id + 3')}] WHEN doc_id % 89 = 5 THEN []
      WHEN doc_id % 3 = 0 THEN [{_M('1 + doc_id % 4')}] WHEN doc_id % 7 = 2 THEN ['<gone@example.com>', {_M('doc_id - 3')}, {_M('doc_id - 9')}]
      WHEN doc_id % 7 = 3 THEN ['<lost@example.com>', {_M('doc_id - 3')}] ELSE [{_M('doc_id - 3')}] END AS names
  FROM documents),
known AS (SELECT mid, min({{'mbox': mbox, 'seq': seq}}) AS mail FROM h GROUP BY mid),
p AS (
  SELECT {{'mbox': mbox, 'seq': seq}} AS node, min_by(mail, place) AS parent
  FROM (SELECT mbox, seq, unnest(CASE WHEN len(names) = 0 THEN [NULL] ELSE names END) AS name, generate_subscripts(CASE WHEN len(names) = 0 THEN [NULL] ELSE names END, 1) AS place FROM h)
  LEFT JOIN known ON name = mid AND mail <> {{'mbox': mbox, 'seq': seq}} GROUP BY ALL),
walk AS (
  SELECT node, node AS here, 0 AS steps, [node] AS path, false AS round FROM p
  UNION ALL
  SELECT walk.node, p.parent, steps + 1, list_append(path, p.parent), list_contains(path, p.parent)
  FROM walk JOIN p ON walk.here = p.node AND NOT round WHERE p.parent IS NOT NULL),
circles AS (SELECT DISTINCT list_min(list_slice(path, list_position(path, here), len(path))) AS start FROM walk WHERE round),
found AS (
  SELECT node, here AS root, steps AS depth FROM walk
  WHERE here IN (SELECT start FROM circles) OR here IN (SELECT node FROM p WHERE parent IS NULL)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY steps) = 1)"""

# Patches: each document's lines signed, then read again line by line.
_NAME = "'src/' || source || '/f' || (doc_id % 9) || '.py'"
PATCHES = f"""sg AS (
  SELECT source AS mbox, doc_id, {_NAME} AS name, list_transform(string_split(coalesce(text, ''), {NL}), lambda x, n:
    CASE WHEN (n - 1 + doc_id) % 4 = 0 THEN '+' || x WHEN (n - 1 + doc_id) % 4 = 1 THEN '-' || x
      WHEN (n - 1 + doc_id) % 11 = 2 THEN '--- a/' || left(x, 5) WHEN (n - 1 + doc_id) % 13 = 3 THEN '+@@ -1,2 +3,4 @@' ELSE ' ' || x END) AS ls
  FROM documents),
pt AS (
  SELECT mbox, doc_id AS seq, string_split('Please review.' || {NL} || {NL} || CASE doc_id % 5
      WHEN 0 THEN concat_ws({NL}, 'diff --git a/' || name || ' b/' || name, 'new file mode 100644', '--- /dev/null', '+++ b/' || name)
      WHEN 1 THEN '--- a/' || name || chr(9) || '2024-01-01' || {NL} || '+++ b/' || name
      WHEN 2 THEN concat_ws({NL}, 'diff --git a/old.py b/' || name, 'rename from old.py', 'rename to ' || name, '--- a/old.py', '+++ b/' || name)
      ELSE concat_ws({NL}, 'diff --git a/' || name || ' b/' || name, 'index 1..2 100644', '--- a/' || name, '+++ b/' || name) END
    || {NL} || '@@ -1,' || len(list_filter(ls, lambda x: NOT starts_with(x, '+'))) || ' +1,' || len(list_filter(ls, lambda x: NOT starts_with(x, '-'))) || ' @@' || {NL}
    || array_to_string(ls, {NL}) || {NL} || CASE doc_id % 6
      WHEN 0 THEN 'diff --git a/pic.png b/pic.png' || {NL} || 'Binary files a/pic.png and b/pic.png differ'
      WHEN 1 THEN concat_ws({NL}, '\\ No newline at end of file', '@@ -90 +90,2 @@ def f():', '-old', '+new', '+newer', 'bye')
      WHEN 2 THEN concat_ws({NL}, 'diff --git a/gone.txt b/gone.txt', 'deleted file mode 100644', '--- a/gone.txt', '+++ /dev/null', '@@ -1,5 +0,0 @@', '-a', '-b', 'cut off', '+stray')
      ELSE '-- ' || {NL} || 'signature' END, {NL}) AS ls
  FROM sg),
ln AS (SELECT mbox, seq, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM pt),
st AS (
  SELECT mbox, seq, CAST(0 AS BIGINT) AS pos, CAST(-1 AS INTEGER) AS file, CAST(NULL AS VARCHAR) AS old_path, CAST(NULL AS VARCHAR) AS new_path, CAST(NULL AS VARCHAR) AS status,
    0 AS hunks, 0 AS added, 0 AS removed, CAST(NULL AS VARCHAR) AS minus, 0 AS o, 0 AS n FROM pt
  UNION ALL
  SELECT mbox, seq, pos, CASE WHEN k IN ('git', 'open') THEN file + 1 ELSE file END,
    CASE k WHEN 'git' THEN regexp_extract(line, 'a/(.*) b/', 1) WHEN 'open' THEN minus WHEN 'paths' THEN minus ELSE old_path END,
    CASE WHEN k = 'git' THEN regexp_extract(line, ' b/(.*)$', 1) WHEN k IN ('open', 'paths') THEN regexp_extract(line, '^[+]{{3}} (?:b/)?(.*)$', 1) ELSE new_path END,
    CASE WHEN k = 'git' THEN 'modified' WHEN k = 'mode' THEN CASE left(line, 3) WHEN 'new' THEN 'added' WHEN 'del' THEN 'deleted' WHEN 'ren' THEN 'renamed' ELSE 'binary' END
      WHEN k = 'open' OR k = 'paths' AND status <> 'renamed' THEN CASE WHEN minus = '/dev/null' THEN 'added' WHEN line = '+++ /dev/null' THEN 'deleted' ELSE 'modified' END
      ELSE status END,
    CASE k WHEN 'git' THEN 0 WHEN 'open' THEN 0 WHEN 'hunk' THEN hunks + 1 ELSE hunks END,
    CASE k WHEN 'git' THEN 0 WHEN 'open' THEN 0 WHEN '+' THEN added + 1 ELSE added END,
    CASE k WHEN 'git' THEN 0 WHEN 'open' THEN 0 WHEN '-' THEN removed + 1 ELSE removed END,
    CASE WHEN k = 'old' THEN regexp_extract(line, '^--- (?:a/)?([^\t]*)', 1) WHEN k IN ('+', '-', ' ', 'skip') THEN minus END,
    CASE WHEN k = 'hunk' THEN CASE regexp_extract(line, '-\\d+,(\\d+)', 1) WHEN '' THEN 1 ELSE CAST(regexp_extract(line, '-\\d+,(\\d+)', 1) AS INTEGER) END
      WHEN k IN ('-', ' ') THEN o - 1 WHEN k IN ('+', 'skip') THEN o ELSE 0 END,
    CASE WHEN k = 'hunk' THEN CASE regexp_extract(line, '\\+\\d+,(\\d+)', 1) WHEN '' THEN 1 ELSE CAST(regexp_extract(line, '\\+\\d+,(\\d+)', 1) AS INTEGER) END
      WHEN k IN ('+', ' ') THEN n - 1 WHEN k IN ('-', 'skip') THEN n ELSE 0 END
  FROM (
    SELECT st.* EXCLUDE (pos), ln.pos, line, CASE
      WHEN starts_with(line, '+') AND n > 0 THEN '+' WHEN starts_with(line, '-') AND o > 0 THEN '-'
      WHEN (line = '' OR starts_with(line, ' ')) AND o > 0 AND n > 0 THEN ' ' WHEN starts_with(line, '\') AND (o > 0 OR n > 0) THEN 'skip'
      WHEN starts_with(line, 'diff --git a/') THEN 'git'
      WHEN minus IS NOT NULL AND starts_with(line, '+++ ') THEN CASE WHEN file >= 0 AND hunks = 0 AND status <> 'binary' THEN 'paths' ELSE 'open' END
      WHEN regexp_matches(line, '^--- [^\t]') THEN 'old'
      WHEN file >= 0 AND regexp_matches(line, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@') THEN 'hunk'
      WHEN file >= 0 AND hunks = 0 AND status <> 'binary' AND regexp_matches(line, '^(new file mode |deleted file mode |rename to |Binary files .* differ$)') THEN 'mode'
      ELSE 'text' END AS k
    FROM st JOIN ln ON st.mbox = ln.mbox AND st.seq = ln.seq AND ln.pos = st.pos + 1)),
ch AS (SELECT * FROM st WHERE file >= 0 QUALIFY row_number() OVER (PARTITION BY mbox, seq, file ORDER BY pos DESC) = 1)"""

# When each derived mail was sent, from its number.
_DAY = "1 + (doc_id * 7) % 28, (doc_id * 5) % 24, doc_id % 60"
ACTIVE = f"""dt AS (
  SELECT source AS mbox, doc_id AS seq, 'dev-' || ((doc_id * 31) % 211) || '@example.com' AS who, CASE WHEN doc_id % 23 <> 0 THEN
    CAST(epoch(make_timestamp(2024, 1 + (doc_id // 40) % 3, {_DAY}, ([0, 30, 0, 5, 5])[doc_id % 5 + 1])) AS BIGINT)
      - CASE doc_id % 5 WHEN 0 THEN -5 * 3600 WHEN 1 THEN 19800 WHEN 2 THEN 0 ELSE -8 * 3600 END END AS t
  FROM documents),
ac AS (
  SELECT mbox, seq, who, t, repos, tags, CAST(date_trunc('week', to_timestamp(t) AT TIME ZONE 'UTC') AS DATE) AS week
  FROM e JOIN dt USING (mbox, seq) WHERE t IS NOT NULL),
rt AS (
  SELECT mbox, seq, who, week, repo, unnest(CASE WHEN len(tags) > 0 THEN list_distinct(tags) ELSE [''] END) AS tag
  FROM (SELECT *, unnest(CASE WHEN len(repos) > 0 THEN list_distinct(repos) ELSE [''] END) AS repo FROM ac))"""

# Words of the entities of each question's best lexical hits, and vectors with them.
ENTITIES = """en AS (
  SELECT mbox, seq, CAST(unnest(pr_numbers) AS VARCHAR) AS text FROM g UNION ALL SELECT mbox, seq, value FROM v WHERE field IN ('repos', 'tickets')),
fw AS (
  SELECT query_id, w, count(*) AS n FROM (
    SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM best JOIN en USING (mbox, seq)) GROUP BY ALL),
tot AS (SELECT count(DISTINCT (mbox, seq)) AS total FROM ft),
fx AS (
  SELECT query_id, w, n * (ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS x FROM fw LEFT JOIN df USING (w) CROSS JOIN tot
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, w) <= 10),
ad AS (SELECT query_id, w, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) * 0.5 AS x FROM fx),
ow AS (SELECT query_id, w, n * (ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS x FROM qw LEFT JOIN df USING (w) CROSS JOIN tot),
aw AS (SELECT query_id, w, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM ow UNION ALL SELECT * FROM ad),
ap AS (
  SELECT query_id, CAST('0x' || left(md5(w), 4) AS INTEGER) % 64 AS place,
    sum(x * CASE WHEN CAST('0x' || substr(md5(w), 5, 1) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM aw GROUP BY ALL),
av AS (
  SELECT query_id, list(CAST(round(coalesce(x, 0) / norm, 6) + 0.0 AS FLOAT) ORDER BY place) AS embedding FROM (
    SELECT query_id, place, x, sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS norm
    FROM (SELECT DISTINCT query_id FROM ap) CROSS JOIN (SELECT unnest(range(64)) AS place) LEFT JOIN ap USING (query_id, place))
  WHERE norm > 0 GROUP BY query_id)"""

# The budget: bodies cut to 1,500 characters a mail, rows kept while 6,000 characters last, then one text.
_ROW_ORDER = "position, mbox, seq, section, rank, item, text"
BUDGET = f"""bl AS (
  SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY query_id, position, mbox, seq, section ORDER BY rank, item, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM all_contexts),
bc AS (
  SELECT * EXCLUDE (room) REPLACE (CASE WHEN label = 'Email Body:' THEN left(text, CAST(1500 - room AS BIGINT)) ELSE text END AS text)
  FROM bl WHERE label <> 'Email Body:' OR room < 1500 AND (text <> '' OR rank = 1)),
bk AS (
  SELECT *, sum(length(text) + 1) OVER (PARTITION BY query_id ORDER BY {_ROW_ORDER} ROWS UNBOUNDED PRECEDING) AS upto FROM bc),
bs AS (
  SELECT query_id, mode, key, position, mbox, seq, section, label, CASE
      WHEN label LIKE '%: ' THEN string_agg(text, ', ' ORDER BY rank, item, text)
      WHEN label = 'Email Body:' THEN string_agg(text, {NL} || {NL} ORDER BY rank, item, text)
      ELSE string_agg(text, {NL} ORDER BY rank, item, text) END AS text
  FROM bk WHERE upto - 1 <= 6000 GROUP BY query_id, mode, key, position, mbox, seq, section, label),
bt AS (
  SELECT query_id, mode, key, position, mbox, seq, section, label LIKE '## %' AS md,
    CASE WHEN label LIKE '%: ' OR label = '' THEN label || text ELSE label || {NL} || text END AS text FROM bs),
bb AS (
  SELECT query_id, mode, key, position, mbox, seq, min(section) AS section,
    CASE WHEN md THEN 'Markdown Sections:' || {NL} ELSE '' END || string_agg(text, {NL} ORDER BY section) AS text
  FROM bt GROUP BY query_id, mode, key, position, mbox, seq, md, CASE WHEN md THEN 0 ELSE section END),
bm AS (SELECT query_id, mode, key, position, mbox, seq, string_agg(text, {NL} || {NL} ORDER BY section) AS text FROM bb GROUP BY ALL)"""

ORACLES = {
    "mbox_scan": f"""WITH {MAILS} SELECT mbox, {FOLDED} AS subject, sender, date, message_id,
        regexp_replace(CASE seq % 4
          WHEN 1 THEN doc_text WHEN 2 THEN doc_text
          WHEN 3 THEN {strip("substr(regexp_replace('x' || doc_text, '(?m)^From ', '>From ', 'g'), 2)")}
          ELSE regexp_replace(doc_text, '(?m)^From ', '>From ', 'g') END, '\\n+\\z', '') AS body FROM m""",
    "mail_headers": over_mails(f"{FOLDED} AS subject, sender, date, message_id"),
    "mail_parts": f"""WITH {MAILS}
        SELECT mbox, seq, 0 AS part, CASE WHEN seq % 4 = 3 THEN 'text/html' ELSE 'text/plain' END AS ctype,
          {PLAIN_PART} AS encoding, CASE WHEN seq % 4 = 3 THEN {PAGE_PART} ELSE doc_text END AS payload FROM m
        UNION ALL SELECT mbox, seq, 1, 'text/html', '', {PAGE_PART} FROM m WHERE seq % 4 = 1""",
    "mail_body": over_mails(f"CASE WHEN seq % 4 = 3 THEN {strip('doc_text')} ELSE doc_text END AS body"),
    "subject_prs": over_mails(f"{csv(find('subject', P.SUBJECT_PR))} AS prs"),
    "subject_repos": over_mails(f"{csv(find('subject', P.SUBJECT_REPO))} AS repos"),
    "subject_tickets": over_mails(f"{csv(find('subject', P.SUBJECT_TICKET))} AS tickets"),
    "clean_title": over_mails("pr_title AS title", "x"),
    "msgid_pr": over_mails(f"{MSG_PR} AS pr"),
    "mail_prs": over_mails(f"{text_list('pr_numbers')} AS prs", "x"),
    "contributors": over_mails(
        f"{csv('contributors')} AS in_subject, {csv(some(f"list_sort(list_distinct({find('body', P.MENTION)}))"))} AS in_body", "x"
    ),
    "linked_prs": over_mails(f"{text_list('linked_prs')} AS prs", "b"),
    "linked_tickets": over_mails(f"{csv('linked_tickets')} AS tickets", "b"),
    "files_modified": over_mails(f"{csv('files_modified')} AS files, {csv('file_paths')} AS paths", "b"),
    "code_blocks": over_mails(f"{csv('code_blocks')} AS blocks", "b"),
    "list_items": over_mails(f"{csv('lists')} AS items", "b"),
    "list_markers": over_mails(f"{csv(some(find('body', P.LIST_LINE)))} AS markers"),
    "tags_title": over_mails(f"{csv(word_tags('pr_title'))} AS tags", "x"),
    "tags_substring": over_mails(f"{csv(substring_tags('pr_title'))} AS tags", "x"),
    "tags_files": over_mails(f"{csv(file_tags('files_modified'))} AS by_component, {csv(file_tags('file_paths'))} AS by_path", "b"),
    "normalise_mails": f"""WITH {MAILS}, {SUBJECTS} SELECT mbox, seq, {text_list(some(numbers('s_prs')))} AS prs,
        nullif(trim(regexp_replace(subject, '\\[[^\\]]*\\]|\\w+', '', 'g'), ' '), '') AS pr_title,
        {csv('repos')} AS repos, {csv('tickets')} AS tickets FROM x""",
    "html_to_text": f"WITH n AS (SELECT page_id, html, {_NAMES} AS names FROM pages) SELECT page_id, {html_text('html')} AS text FROM n",
    "commits": f"WITH {MAILS}, {SUBJECTS}, {BODIES} SELECT mbox, seq, c.sha, c.short, c.message FROM (SELECT mbox, seq, unnest(commits) AS c FROM b)",
    "heading_sections": f"""WITH {MAILS}, {SECTIONS}
        SELECT mbox, seq, row_number() OVER (PARTITION BY mbox, seq ORDER BY sec) - 1 AS sec, heading, {csv('lines')} AS lines FROM sec""",
    "markdown_struct": over_mails(f"{csv('code_blocks')} AS code_blocks, {SECTIONS_TEXT} AS headings, {csv('lists')} AS lists", "e"),
    "tags_sections": over_mails(f"{csv(SECTION_TAGS)} AS tags", "e"),
    "tags_combined": over_mails(f"{csv('tags')} AS tags", "e"),
    "pr_leaders": f"WITH {MAILS}, {SUBJECTS} SELECT mbox, pr, min(seq) AS leader_seq FROM (SELECT mbox, seq, unnest(pr_numbers) AS pr FROM x) GROUP BY mbox, pr",
    "merge_by_pr": f"WITH {MERGED} SELECT {HEAD_COLUMNS} FROM g",
    "merge_in_pieces": f"WITH {MERGED} SELECT {HEAD_COLUMNS} FROM g",
    "merge_one_pr": f"""WITH {STACK.replace('e AS (', 'e0 AS (')},
        e AS (SELECT * REPLACE ('all' AS mbox, CASE WHEN seq % 3 = 0 THEN [CAST(1 AS BIGINT)] ELSE pr_numbers END AS pr_numbers) FROM e0),
        {merged()} SELECT mbox, seq, members, subject, rank, body, {csv('tags')} AS tags FROM tx JOIN g USING (mbox, seq)""",
    "merge_keep_unlinked": f"WITH {STACK}, {merged(MEMBERS_ALL)} SELECT {HEAD_COLUMNS} FROM g",
    "merge_lists": f"WITH {MERGED} SELECT mbox, seq, field, value, detail FROM v",
    "merge_markdown": f"WITH {MERGED} SELECT mbox, seq, key, rank, item, text FROM md WHERE every",
    "merge_markdown_union": f"""WITH {STACK}, {merged(MEMBERS_ALL)} SELECT mbox, seq, key, rank, item, text FROM md
        WHERE key <> 'lists' OR leads OR NOT contains(lower(text), 'sonar')""",
    "merge_body": f"WITH {MERGED} SELECT mbox, seq, rank, body FROM tx",
    "ingest_counts": f"WITH {MERGED} SELECT count(DISTINCT mbox) AS mailboxes, count(*) AS mails FROM g",
    "index_roundtrip": f"""WITH {MERGED}, {KEYS}, {QUESTIONS}, {vectors()}, bc AS (SELECT mbox, seq, sum(length(body)) AS body_chars FROM tx GROUP BY ALL)
        SELECT pr, mbox, seq, members, pr_title, CAST(body_chars AS BIGINT) AS body_chars, round(CAST(embedding[1] AS DOUBLE), 4) AS first_entry
        FROM mail_pr JOIN g USING (mbox, seq) JOIN bc USING (mbox, seq) JOIN mv USING (mbox, seq)""",
    "pr_graph": f"""WITH RECURSIVE {REACHED}
        SELECT split_part(node, '/', 1) AS kind, node, component, count(*) OVER (PARTITION BY component) AS members FROM comp""",
    "pr_edges": f"""WITH {LINKS}, own AS (SELECT mbox, seq, unnest(pr_numbers) AS pr FROM e)
        SELECT mbox, pr, kind, value, count(*) AS mails FROM lk JOIN own USING (mbox, seq)
        WHERE kind <> 'pr' OR value <> CAST(pr AS VARCHAR) GROUP BY ALL""",
    "mail_threads": f"""WITH RECURSIVE {THREADS}
        SELECT node.mbox AS mbox, node.seq AS seq, root.mbox AS root_mbox, root.seq AS root_seq, depth,
          count(*) OVER (PARTITION BY root) AS size FROM found""",
    "change_counts": f"WITH RECURSIVE {PATCHES} SELECT mbox, seq, file, old_path, new_path, status, hunks, added, removed FROM ch",
    "mail_dates": f"WITH {STACK}, {ACTIVE} SELECT mbox, seq, t AS at FROM dt",
    "repo_cube": f"""WITH {STACK}, {ACTIVE}
        SELECT repo, tag, CAST(week AS VARCHAR) AS week, grouping(repo, tag, week) AS grain, count(DISTINCT (mbox, seq)) AS mails, count(DISTINCT who) AS contributors
        FROM rt GROUP BY GROUPING SETS ((repo, tag, week), (repo, week), (repo, tag), (repo), (tag), (week), ())""",
    "repo_contributors": f"""WITH {STACK}, {ACTIVE}
        SELECT repo, count(*) AS entries, count(DISTINCT who) AS exact, true AS within FROM rt GROUP BY repo""",
    "repo_sessions": f"""WITH {STACK}, {ACTIVE},
        ev AS (SELECT DISTINCT mbox, seq, t, unnest(repos) AS repo FROM ac),
        cut AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY repo ORDER BY t, mbox, seq) <= 43200 THEN 0 ELSE 1 END AS opens FROM ev),
        num AS (SELECT *, sum(opens) OVER (PARTITION BY repo ORDER BY t, mbox, seq ROWS UNBOUNDED PRECEDING) AS session FROM cut)
        SELECT repo, CAST(session AS BIGINT) AS session, min(t) AS first, max(t) AS last, count(*) AS mails FROM num GROUP BY repo, session""",
    "budgeted_prompts": f"""WITH {ANSWERS}, {BUDGET}
        SELECT query_id, mode, {_prompt()} || string_agg(text, {q(P.CONTEXT_RULER)} ORDER BY position, mbox, seq) AS prompt FROM bm GROUP BY query_id, mode, key""",
    "expansion_terms": f"WITH {MERGED}, {QUESTIONS}, {lexical(3)}, {vectors()}, {ENTITIES} SELECT query_id, w AS word, round(x, 6) AS w FROM ad",
    "augmented_hits": f"""WITH {MERGED}, {QUESTIONS}, {lexical(3)}, {vectors()}, {ENTITIES}, {mail_near(5).replace('qv', 'av')}
        SELECT query_id, mbox, seq, rank FROM near""",
    "full_text": f"WITH {MERGED} {FULL_TEXT}",
    "context_blocks": f"WITH {MERGED} {CONTEXT_ROWS}",
    "route_questions": f"WITH {ROUTES} SELECT query_id, question, commit, pr, mode, key FROM routes",
    "pr_lookup": f"WITH {LOOKUPS} SELECT query_id, pr, mbox, seq FROM routes JOIN mail_pr USING (pr) WHERE mode = 'pr'",
    "commit_lookup": f"WITH {LOOKUPS} SELECT DISTINCT query_id, commit, mbox, seq FROM routes JOIN mail_commit ON commit = mail_commit.key WHERE mode = 'commit'",
    "commit_prefix_lookup": f"WITH {LOOKUPS} SELECT DISTINCT query_id, commit, mbox, seq FROM routes JOIN mail_commit ON starts_with(mail_commit.key, commit) WHERE mode = 'commit'",
    "lookup_misses": f"""WITH {LOOKUPS} SELECT query_id, mode, key FROM routes
        WHERE mode = 'commit' AND commit NOT IN (SELECT key FROM mail_commit) OR mode = 'pr' AND pr NOT IN (SELECT pr FROM mail_pr)""",
    "question_context": f"WITH {LOOKUPS}, {KEY_CONTEXTS} SELECT * FROM key_contexts",
    "question_context_parts": f"""WITH {LOOKUPS}, {KEY_CONTEXTS}
        SELECT mode, key, section, label, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM key_contexts GROUP BY ALL""",
    "answer_contexts": f"WITH {ANSWERS} SELECT * FROM all_contexts",
    "prompts": f"""WITH {ANSWERS} SELECT * EXCLUDE (key) FROM all_contexts
        UNION ALL SELECT DISTINCT query_id, mode, -1, '', 0, 0, '', 0, 0, {_prompt()} FROM all_contexts""",
    "knn_top5": knn(5),
    "knn_topk": knn(10),
    "knn_topk_blocks": knn(10),
    "knn_cells_all": knn(5),
    "tag_rerank": f"""WITH {STACK}, {QUESTIONS}, {nearest(10)}
        SELECT query_id, vec_id, rank, {boosted('text')} AS boost,
          row_number() OVER (PARTITION BY query_id ORDER BY {boosted('text')} DESC, rank) AS position
        FROM near JOIN e ON e.seq = vec_id JOIN qs USING (query_id)""",
    "lexical_score": f"WITH {LOOKUPS} SELECT query_id, mbox, seq, CAST({SCORE} AS DOUBLE) AS score FROM routes JOIN mail_pr USING (pr) JOIN g USING (mbox, seq) JOIN qs USING (query_id) WHERE mode = 'pr'",
    "lexical_top10": f"WITH {MERGED}, {QUESTIONS}, {lexical(10)} SELECT query_id, mbox, seq, score, rank FROM best",
    "hybrid_hits": f"""WITH {MERGED}, {QUESTIONS}, {lexical(3)}, {vectors()}, {mail_near(5)},
        tiers AS (SELECT query_id, mbox, seq, 0 AS tier, rank FROM best UNION ALL SELECT query_id, mbox, seq, 1, rank FROM near),
        once AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY query_id, mbox, seq ORDER BY tier, rank) = 1)
        SELECT query_id, mbox, seq, CASE tier WHEN 0 THEN 'lexical' ELSE 'semantic' END AS source,
          row_number() OVER (PARTITION BY query_id ORDER BY tier, once.rank) AS rank
        FROM once QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, once.rank) <= 5""",
    "embed_mails": f"""WITH {MERGED}, {QUESTIONS}, {vectors()}
        SELECT mbox, seq, generate_subscripts(embedding, 1) - 1 AS place, round(CAST(unnest(embedding) AS DOUBLE), 4) + 0.0 AS x FROM mv""",
    "embed_questions": f"""WITH {MERGED}, {QUESTIONS}, {vectors()}
        SELECT query_id, generate_subscripts(embedding, 1) - 1 AS place, round(CAST(unnest(embedding) AS DOUBLE), 4) + 0.0 AS x FROM qv""",
    "semantic_hits": f"""WITH {MERGED}, {QUESTIONS}, {vectors()}, {mail_near(5)}
        SELECT query_id, mbox, seq, rank, {boosted('text')} AS boost,
          row_number() OVER (PARTITION BY query_id ORDER BY {boosted('text')} DESC, rank) AS position
        FROM near JOIN g USING (mbox, seq) JOIN qs USING (query_id)""",
}
ORACLES["index_growth"] = ORACLES["embed_mails"]
