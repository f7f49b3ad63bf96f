"""Main text of web pages by equivalence-class template deduction.

A page is a row of tokens, elements and texts. A token is told apart by its path: an element's name and
class names, or a text's words, and the tokens around it (of a text, those that are not inline). Over the pages of one host, a token's occurrence vector holds how often each page has
it. Tokens with equal vectors are an equivalence class; a class is valid if enough pages have it and it
has several tokens. Vectors never exist: each is a sum of hashes of (page, count), which adds up in any
order, so a host with a third of all pages is aggregated like others.

Valid classes are nested: a token is part of the template if its class is valid and the token around it
is part of it. What lies between template tokens are the slots. Slots in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are page furniture; if the
template has an article, only slots inside it are text. Inside a slot, furniture that some pages have
only is left out the same way. Where the template has no article, texts of the template are furniture as
well, whatever their elements are called: a menu or notice is what the host's pages share. Such a text stands
on ``TEXT_SHARE`` of the host's pages, and on pages of ``MIN_PAGES`` of 64 kinds by a hash of the whole page, so
that copies of one page do not make its article a template. A host of too few pages takes the elements of the
template of all pages.

Text: character references are decoded, white space in a block is one space, blocks are trimmed and
joined by a line end, none is dropped. Pages may be cut off or badly nested. NULL html is empty and
gives the empty text; NULL urls are one host; repeated rows are pages of their own; other columns are
ignored. An empty table gives an empty result.
"""

import html as references
import re
import sys

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A host's own template needs as many pages; a class, this share of its host's pages and as many tokens.
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 5, 0.2, 2
#: A text's share of its host's pages; near copies of one page are seldom as many.
TEXT_SHARE = 0.4
ALL_HOSTS = "*"
#: Tokens that a task adds up before it passes them on.
TOKENS_AT_ONCE = 100_000

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:"[^"]*"|'[^']*'|[^"'<>])*+)>""", re.S
)
CLASSES = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"""(?i)\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
WORDS = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SCOPES = frozenset("html body article main section div aside nav footer header form td th table".split())
FURNITURE = frozenset(
    "nav header footer aside form button select option script style noscript template svg math iframe object textarea "
    "head title dialog menu input".split()
)
#: Words of class, id and role values that name furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice banner "
    "popup modal overlay subscribe newsletter signup login sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer copyright share sharing social related recommended recommendations comment comments respond replies "
    "disqus pagination pager search toolbar complementary contentinfo".split()
)
CONTENT = frozenset(("article", "main"))
#: An article's own header holds its title.
CONTENT_HEADERS = frozenset(("header", "masthead"))
BY_NAME, BY_ELEMENT = 1, 2


class Node:
    """An open element; ``block`` is the path of the nearest one that is not inline."""

    __slots__ = ("name", "path", "block", "furniture", "content", "template")

    def __init__(self, name, path, block, furniture, content, template):
        self.name, self.path, self.block = name, path, block
        self.furniture, self.content, self.template = furniture, content, template


def walk(page: str, template: frozenset | None = None):
    """Events of a page in order: ("open", node), ("text", string, node around it), ("break",)."""
    low = None
    root = Node("", 0, 0, 0, False, True)
    stack, at = [root], 0
    while True:
        m = TAG.search(page, at)
        if m is None or m.start() > at:
            yield "text", page[at : m.start() if m else len(page)], stack[-1]
        if m is None:
            return
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                yield "break", None, None
            if any(n.name == name for n in stack):
                while stack[-1].name != name:
                    stack.pop()
                stack.pop()
            continue
        if name not in INLINE:
            yield "break", None, None
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            shut = "p" if name in CLOSES_P else name
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == shut:
                    del stack[i:]
                    break
                if stack[i].name in SCOPES or (shut != "p" and stack[i].name in ("ul", "ol", "dl")):
                    break
        values = " ".join("".join(v) for v in CLASSES.findall(m[3])).lower() if m[3] else ""
        above = stack[-1]
        path = xxhash.xxh3_64_intdigest(f"{above.path}>{name}.{values}") >> 1
        # By its element, or by a name only; an article in a container of such a name is still one.
        own = 0
        if name in FURNITURE and not (name == "header" and above.content):
            own = BY_ELEMENT
        elif name not in ("html", "body") and m[3]:
            named = FURNITURE_WORDS - CONTENT_HEADERS if above.content else FURNITURE_WORDS
            own = BY_NAME if not named.isdisjoint(WORDS.findall(values)) or HIDDEN.search(m[3]) else 0
        around = 0 if name in CONTENT and above.furniture == BY_NAME else above.furniture
        node = Node(
            name, path, above.block if name in INLINE else path, max(own, around),
            above.content or name in CONTENT, above.template and (template is None or path in template),
        )
        yield "open", above, node
        if name in RAW:
            # Raw content ends at its end tag, or with the page.
            low = low if low is not None else page.lower()
            end = low.find(f"</{name}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def text_token(text: str, around: Node) -> int | None:
    """Token of a text between two tags; none if it is blank."""
    words = " ".join(text.split())
    return xxhash.xxh3_64_intdigest(f"{around.block}#{words}") >> 1 if words else None


def token_counts(page: str) -> dict[int, list]:
    """Path to [count, path around it, is content, is text] of a page's tokens; texts outside articles and furniture."""
    out: dict[int, list] = {}
    for kind, a, node in walk(page):
        if kind == "open":
            seen = out.setdefault(node.path, [0, a.path, node.name in CONTENT and not node.furniture, False])
            seen[0] += 1
        elif kind == "text" and not node.furniture and not node.content:
            token = text_token(a, node)
            if token is not None:
                out.setdefault(token, [0, node.block, False, True])[0] += 1
    return out


def occurrence_sums(pages: DataFrame) -> DataFrame:
    """For each host and token: pages that have it, its occurrence vector as a sum of hashes, and the kinds of
    pages that have it as bits."""

    def run(batches):
        from pyspark import TaskContext

        row, sums = TaskContext.get().partitionId() << 40, {}

        def rows():
            cols = list(zip(*[(h, t, *v) for (h, t), v in sums.items()])) or [[]] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            names = ("host", "token", "around", "pages", "vector", "kinds", "content", "is_text")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row += 1
                host = host_of(url)
                bit = 1 << (xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "replace")) & 63)
                bit -= (bit >> 63) << 64  # the last one is the sign
                for path, (count, around, content, is_text) in token_counts(page or "").items():
                    seen = xxhash.xxh3_64_intdigest(f"{row} {count}") >> 24
                    for h in (host,) if is_text else (host, ALL_HOSTS):
                        s = sums.setdefault((h, path), [around, 0, 0, 0, content, is_text])
                        s[1] += 1
                        s[2] = (s[2] + seen) & ((1 << 62) - 1)
                        s[3] |= bit
                if len(sums) > TOKENS_AT_ONCE:
                    yield rows()
                    sums.clear()
        yield rows()

    return pages.select("url", "html").mapInArrow(
        run,
        "host string, token bigint, around bigint, pages bigint, vector bigint, kinds bigint, content boolean, is_text boolean",
    )


def templates(pages: DataFrame) -> DataFrame:
    """``host, template, has_content``: the paths of each host's template tokens, nested from the root. Pages are
    read once: the sums are written to the shared folder."""
    sums = keep(occurrence_sums(pages).groupBy("host", "token").agg(
        F.first("around").alias("around"), F.sum("pages").alias("pages"),
        F.expr("cast(sum(cast(vector AS decimal(38,0))) % cast(4611686018427387904 AS decimal(38,0)) AS bigint)").alias("vector"),
        F.bit_or("kinds").alias("kinds"), F.bool_or("content").alias("content"), F.bool_or("is_text").alias("is_text"),
    ))
    per_host = sums.groupBy("host").agg(F.max("pages").alias("n_pages"))
    text_fits = (F.col("pages") >= TEXT_SHARE * F.col("n_pages")) & (F.bit_count("kinds") >= MIN_PAGES)
    # Few are left to gather: a page has so many tokens, and each of these stands on a share of the pages.
    frequent = sums.join(per_host, "host").where(
        (F.col("n_pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("n_pages")) & (~F.col("is_text") | text_fits)
    )
    classes = frequent.groupBy("host", "pages", "vector").agg(
        F.collect_list(F.struct("token", "around", "content")).alias("tokens")
    )
    gathered = classes.where(F.size("tokens") >= MIN_TOKENS).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))

    def nest(batches):
        for batch in batches:
            hosts, found, has = batch.column(0).to_pylist(), [], []
            for tokens in batch.column(1).to_pylist():
                below: dict[int, list] = {}
                for t in tokens:
                    below.setdefault(t["around"], []).append(t)
                kept, content, front = [], False, [0]
                while front:
                    for t in below.pop(front.pop(), ()):
                        kept.append(t["token"])
                        content |= t["content"]
                        front.append(t["token"])
                found.append(kept)
                has.append(content)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(has, pa.bool_())],
                names=["host", "template", "has_content"],
            )

    return gathered.mapInArrow(nest, "host string, template array<bigint>, has_content boolean")


def main_text(page: str, template: frozenset, has_content: bool) -> str:
    """Text of a page's slots outside furniture, by blocks. Without an article, texts of the template are none."""
    blocks, block = [], []
    for kind, a, node in walk(page, template):
        if kind == "break":
            if block:
                blocks.append("".join(block))
                block = []
        elif kind == "text" and not node.furniture and (node.content or not has_content and text_token(a, node) not in template):
            block.append(references.unescape(a))
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page. Writes the templates to the shared folder."""
    found = keep(templates(pages))
    every = found.where(F.col("host") == ALL_HOSTS).first()
    fallback = (frozenset(every["template"]), every["has_content"]) if every else (frozenset(), False)

    def run(batches):
        known = {}
        for batch in batches:
            ids, urls, htmls, paths, has, hosts = (batch.column(i).to_pylist() for i in range(6))
            texts = []
            for page, p, h, host in zip(htmls, paths, has, hosts):
                if p is None:
                    template, content = fallback
                else:
                    if known.get("host") != host:
                        known = {"host": host, "set": frozenset(p)}
                    template, content = known["set"], h
                if content and not any(n.content and n.template for k, _, n in walk(page or "", template) if k == "open"):
                    content = False  # a page that is not of its host's template
                texts.append(main_text(page or "", template, content))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    return rows.join(found.where(F.col("host") != ALL_HOSTS), "host", "left").select(
        "page_id", "url", "html", "template", "has_content", "host"
    ).mapInArrow(run, "page_id bigint, url string, text string")


def op2_main_text(spark, pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))
