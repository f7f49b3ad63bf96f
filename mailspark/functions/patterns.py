"""The regular expressions, word lists and labels that decide results.

Everything here is data. Patterns are written for Java's regex engine; ``(?d)`` makes
``\\n`` the only line end for ``^``, ``$`` and ``.``.
"""

# --- white space as Python's str.strip() sees it --------------------------------------
SPACES = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Line breaks besides the line feed; the carriage return pairs with it.
OTHER_BREAKS = ["\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# --- subject and Message-ID -----------------------------------------------------------
PR_MARK = r"(?:PR\s*#|pull request\s*#|#)"
SUBJECT_PR = r"(?i)" + PR_MARK + r"(\d+)"
SUBJECT_REPO = r"\[([^\]]+)\]"
SUBJECT_TICKET = r"\b([A-Z]+-\d+)\b"
TITLE_TRIM = " -:_"
MESSAGE_ID_PR = r"/pull/(\d+)/"
MENTION = r"@([A-Za-z0-9-]+)"

# --- body -----------------------------------------------------------------------------
COMMIT_LINE = r"(?md)^[ \t]*([0-9a-f]{7,40})\b(?:\s+(.+))?"
FILE_LINE = r"(?md)^[ \t]*(?:M|A|D|R\d{1,3})\s+(?:a/|b/)?([A-Za-z0-9_./\-\+]+)"
BODY_PR_LINK = r"(?i)https?://github\.com/[^/]+/[^/]+/pull/(\d+)"
BODY_TICKET = r"\b([A-Z][A-Z0-9]{1,10}-\d{1,6})\b"
CODE_FENCE = r"(?s)```(?:[a-zA-Z0-9_\-]*)\n(.*?)```"
LIST_LINE = r"(?md)^[ \t]*([-*+]|\d+\.)\s+.+$"
HASH_HEADING = r"^#{1,6}\s+(.*)$"
PLAIN_HEADING = (
    r"(?i)^(Commit Summary|File Changes|What changed\?|What changed|Summary|Implementation Details"
    r"|Implementation|Testing Notes|Changelog|Description)\s*(?:\(.+\))?$"
)
LONGEST_PLAIN = len("Implementation Details")

# --- questions ------------------------------------------------------------------------
QUESTION_COMMIT = r"\b[a-f0-9]{7,40}\b"
QUESTION_PRS = (
    r"pr\s*#\s*(\d+)",
    r"pull\s*request\s*#\s*(\d+)",
    r"pull\s*#\s*(\d+)",
    r"\bpr\s+(\d+)\b",
)

# --- tag rules: whole words in a title or in section text ------------------------------
WORD_TAGS = {
    "bug": ["bug", "fix", "error", "issue", "crash", "hotfix", "resolve", "address"],
    "sql": ["sql", "table", "database", "db", "query", "column", "index"],
    "ui": [
        "ui", "ux", "frontend", "button", "layout", "design", "dashboard", "widget",
        "garble", "align", "visible", "display",
    ],
    "api": ["api", "endpoint", "endpoints", "rest", "json"],
    "security": ["security", "xss", "auth", "authentication", "authorization", "csrf"],
    "performance": [
        "performance", "speed", "faster", "latency",
        "optimis", "optimise", "optimising", "optimisation",
        "optimiz", "optimize", "optimizing", "optimization",
    ],
}
# Two words that count as one: a tag, the word that must occur, the whole pattern.
PHRASE_TAGS = {"security": ("injection", r"sql[\s_-]?injection")}
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# --- tag rules: substrings of lower-cased file entries ---------------------------------
# "Dao" is kept as it stands; it cannot match lower-cased entries.
FILE_TAGS = {
    "ui": [
        "/ui/", "/frontend/", "/components/", "/views/", "/templates/", ".css", ".scss",
        ".sass", ".less", ".jsx", ".tsx", ".vue", ".html", ".phtml",
    ],
    "sql": ["/migrations/", "/migration/", "/db/", "/database/", ".sql", "Dao"],
    "api": ["/api/", "/routes/", "/controllers/", "/endpoints/", "router", "controller"],
    "security": [
        "/auth/", "/authentication/", "/authorization/", "jwt", "oauth", "/security/",
        "permissions",
    ],
    "performance": [
        "cache", "caching", "/utils/perf", "/performance/", "indexing", "batch", "async",
        "concurrency",
    ],
    "backend": [
        "/services/", "/models/", "/handlers/", "/core/", ".go", ".rb", ".py", ".java",
        ".ts", ".php",
    ],
    "authentication": [
        "/auth/", "/authentication/", "/login/", "/signup/", "oauth", "jwt", "sso", "login",
    ],
}

# --- tag rules: substrings of a lower-cased title, each rule giving one or two tags -----
SUBSTRING_TAGS = [
    (["bug", "fix"], ["bug", "fix"]),
    (["sql", "table", "database", "db"], ["sql", "database"]),
    (["ui"], ["ui"]),
    (["api"], ["api"]),
    (["performance"], ["performance"]),
    (["security", "vulnerability"], ["security"]),
    (["refactor", "cleanup"], ["refactor"]),
    (["auth", "login", "oauth"], ["authentication", "auth"]),
]

# --- lexical score: weight of one matching value, by field -----------------------------
SCORE_WEIGHTS = {
    "pr": 6, "repo": 3, "ticket": 2, "commit": 4, "file": 4, "title": 5, "tag": 2,
    "contributor": 2,
}
TAG_BOOST = 3
SEMANTIC_K = 5

# --- rendered text --------------------------------------------------------------------
CONTEXT_RULER = "\n\n============================\n\n"
PROMPTS = {
    "commit": "You are an expert summarizer.\nSummarize details about commit {key} using ONLY the context below.\n\n{context}",
    "pr": "You are an expert PR analyst.\nSummarize PR #{key} using ONLY the context below.\n\n{context}",
    "semantic": "You are an expert summarizer.\nAnswer using ONLY the context below.\n\n{context}",
}
