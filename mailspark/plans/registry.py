"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the given tables.

List columns are shown as joined text so that results compare as plain values.
"""

from functools import partial, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import body as B, diff as D
from ..functions import subject as S, tags as T
from ..functions.dates import mail_time
from ..functions.html import html_to_text
from ..operators import analytics as A, cells as C, context, expand as E, extract as X, graph as G, knn as K, lexical as L, lookup as Q, merge as M, threads
from ..operators.embed import HashedEncoder, Terms, terms_of
from ..operators.rerank import rerank_by_tags
from ..operators.rows import context_rows, full_text_rows, word_rows
from ..session import configure
from ..sinks.scratch import scratch_dir, store, stored
from ..sinks.store import add_mails, ingest_counts, merged_of, read_index, write_index
from ..sources.derived import (
    derived_activity, derived_mails, derived_patches, derived_questions, derived_raw_mails, derived_replies, read_table,
)
from ..sources.mbox import read_mbox

QUERIES = {}
SEP = "\x1f"


def query(fn, name: str | None = None):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[name or fn.__name__] = run
    return run


def query_as(name: str):
    """For a query whose name an imported operator has."""
    return partial(query, name=name)


def text_of(arr: Column | str) -> Column:
    return F.array_join(F.col(arr).cast("array<string>") if isinstance(arr, str) else arr, SEP)


def sections_text(sections: Column | str) -> Column:
    return F.array_join(
        F.transform(sections, lambda s: F.concat(F.coalesce(s["heading"], F.lit("-")), F.lit(":"), F.array_join(s["lines"], "|"))),
        SEP,
    )


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(derived_mails(spark, sf_dir))


def stored_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails table written once, as the index build does before it merges."""
    return stored(mails(spark, sf_dir), "mails")


def merged_mails(spark: SparkSession, sf_dir: str, keep_unlinked: bool = False, sections: bool = True, **options) -> M.Merged:
    """``sections=False`` for readers of words, who find those of the sections in the body: none are built or written,
    and there is no Markdown table to read."""
    found = mails(spark, sf_dir)
    if not sections:
        none = F.lit(None).cast(found.schema["markdown"].dataType["headings"].dataType)
        found = found.withColumn("markdown", F.col("markdown").withField("headings", none))
    found = stored(found, "mails")
    merged = M.merge_by_pr(found, stored(M.members(found, keep_unlinked), "members"), **options)
    if not sections:
        merged.markdown = None
    return merged


def stored_merged(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = M.Merged.NAMES, sections: bool = True) -> M.Merged:
    """The merged mails with the tables ``names`` written once; the others are worked out where they are read."""
    out = scratch_dir(spark)
    return merged_mails(spark, sf_dir, sections=sections).map(lambda name, table: store(table, f"{out}/{name}") if name in names else table)


def searched_mails(spark: SparkSession, sf_dir: str) -> M.Merged:
    """For queries that return no mail text: headers and values are written, Markdown and texts never read."""
    return stored_merged(spark, sf_dir, ("heads", "values"), sections=False)


def stored_terms(merged: M.Merged) -> Terms:
    """Term statistics written once: vectors of mails and of questions read them, and no text."""
    out = scratch_dir(merged.heads.sparkSession)
    return terms_of(word_rows(merged), merged.heads).map(lambda name, table: store(table, f"{out}/terms_{name}"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes written once: every lookup and every context reads them."""
    return stored(Q.routes(derived_questions(spark, sf_dir)), "routes")


# --- sources ---------------------------------------------------------------------------


@query
def mbox_scan(spark, sf_dir):
    """Write the derived mails as mailbox files, read them back as messages."""
    root = scratch_dir(spark)
    raw = derived_raw_mails(spark, sf_dir)
    guarded = F.regexp_replace("raw", "(?m)^From ", ">From ")
    raw.select(
        "mbox", F.concat(F.lit("From x@example.com Mon Jan  1 00:00:00 2024\n"), guarded, F.lit("\n")).alias("value")
    ).write.partitionBy("mbox").text(f"{root}/boxes")
    read = read_mbox(spark, f"{root}/boxes", "mbox=*/part-*")
    parsed = X.parse_mails(read)
    return parsed.select(
        F.regexp_replace("mbox", "^mbox=", "").alias("mbox"), "subject", "sender", "date", "message_id",
        F.regexp_replace("body", r"\n+\z", "").alias("body"),
    )


@query
def mail_headers(spark, sf_dir):
    return X.mail_headers(derived_raw_mails(spark, sf_dir))


@query
def mail_parts(spark, sf_dir):
    return X.mail_parts(derived_raw_mails(spark, sf_dir))


@query
def mail_body(spark, sf_dir):
    return X.parse_mails(derived_raw_mails(spark, sf_dir)).select("mbox", "seq", "body")


# --- subject and header columns --------------------------------------------------------


def _subject() -> Column:
    return F.col("subject")


def _body() -> Column:
    return F.col("body")


def _title() -> Column:
    return S.clean_title(_subject())


# Columns of one query over the derived mails; made when the query runs.
COLUMN_QUERIES = {
    "subject_prs": lambda: {"prs": text_of(S.subject_prs(_subject()))},
    "subject_repos": lambda: {"repos": text_of(S.subject_repos(_subject()))},
    "subject_tickets": lambda: {"tickets": text_of(S.subject_tickets(_subject()))},
    "clean_title": lambda: {"title": _title()},
    "msgid_pr": lambda: {"pr": S.message_id_pr(F.col("message_id"))},
    "mail_prs": lambda: {"prs": text_of(S.mail_prs(_subject(), F.col("message_id")).cast("array<string>"))},
    "contributors": lambda: {
        "in_subject": text_of(S.contributors(_subject())), "in_body": text_of(S.contributors(_body())),
    },
    "linked_prs": lambda: {"prs": text_of(B.linked_prs(_body()).cast("array<string>"))},
    "linked_tickets": lambda: {"tickets": text_of(B.linked_tickets(_body()))},
    "files_modified": lambda: {
        "files": text_of(B.file_components(B.file_paths(_body()))), "paths": text_of(B.file_paths(_body())),
    },
    "code_blocks": lambda: {"blocks": text_of(B.code_blocks(_body()))},
    "list_items": lambda: {"items": text_of(B.list_items(_body()))},
    "list_markers": lambda: {"markers": text_of(B.list_markers(_body()))},
    "tags_title": lambda: {"tags": text_of(T.tags_of_text(_title()))},
    "tags_substring": lambda: {"tags": text_of(T.tags_by_substring(_title()))},
    "tags_files": lambda: {
        "by_component": text_of(T.tags_of_files(B.file_components(B.file_paths(_body())))),
        "by_path": text_of(T.tags_of_files(B.file_paths(_body()))),
    },
}


def _column_query(name: str, columns) -> None:
    def run(spark, sf_dir):
        return derived_mails(spark, sf_dir).select("mbox", "seq", *[c.alias(n) for n, c in columns().items()])

    query(run, name)


for _name, _columns in COLUMN_QUERIES.items():
    _column_query(_name, _columns)


@query
def normalise_mails(spark, sf_dir):
    raw = derived_mails(spark, sf_dir).select(
        "mbox", "seq",
        S.subject_prs(_subject()).alias("pr_numbers"),
        F.btrim(F.regexp_replace("subject", r"\[[^\]]*\]|\w+", "")).alias("pr_title"),
        S.subject_repos(_subject()).alias("repos"),
        S.subject_tickets(_subject()).alias("tickets"),
    )
    return X.normalise_mails(raw).select(
        "mbox", "seq", text_of("pr_numbers").alias("prs"), "pr_title", text_of("repos").alias("repos"),
        text_of("tickets").alias("tickets"),
    )


# --- body columns ----------------------------------------------------------------------


@query_as("html_to_text")
def html_to_text_pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query
def commits(spark, sf_dir):
    found = derived_mails(spark, sf_dir).select("mbox", "seq", F.explode_outer(B.commits(_body())).alias("c")).where("c IS NOT NULL")
    return found.select("mbox", "seq", "c.sha", "c.short", "c.message")


@query
def heading_sections(spark, sf_dir):
    lines = derived_mails(spark, sf_dir).select("mbox", "seq", B.body_lines(_body()).alias("lines"))
    sections = lines.select("mbox", "seq", F.posexplode_outer(B.sections_of_lines(F.col("lines"))).alias("sec", "s"))
    return sections.where("s IS NOT NULL").select("mbox", "seq", "sec", "s.heading", F.array_join("s.lines", SEP).alias("lines"))


@query
def markdown_struct(spark, sf_dir):
    return mails(spark, sf_dir).select(
        "mbox", "seq", text_of("markdown.code_blocks").alias("code_blocks"),
        sections_text("markdown.headings").alias("headings"), text_of("markdown.lists").alias("lists"),
    )


@query
def tags_sections(spark, sf_dir):
    tags = T.tags_of_sections(F.col("markdown.headings"))
    return mails(spark, sf_dir).select("mbox", "seq", text_of(tags).alias("tags"))


@query
def tags_combined(spark, sf_dir):
    return mails(spark, sf_dir).select("mbox", "seq", text_of("tags").alias("tags"))


# --- merge -----------------------------------------------------------------------------


@query
def pr_leaders(spark, sf_dir):
    return M.pr_leaders(mails(spark, sf_dir)).select("mbox", "pr", "leader_seq").distinct()


def heads_columns(heads: DataFrame) -> DataFrame:
    return heads.select(
        "mbox", "seq", "members", "subject", "sender", "date", "message_id", "pr_title",
        text_of("pr_numbers").alias("pr_numbers"), text_of("tags").alias("tags"),
    )


@query
def merge_by_pr(spark, sf_dir):
    return heads_columns(merged_mails(spark, sf_dir).heads)


@query
def merge_in_pieces(spark, sf_dir):
    """The merge with positions in blocks of 64, so that a pull request lies in several."""
    mails = stored_mails(spark, sf_dir)
    return heads_columns(M.merge_by_pr(mails, stored(M.members(mails, span=64), "members")).heads)


@query
def merge_one_pr(spark, sf_dir):
    """Every third mail of all is of one PR of one mailbox: its texts in order, and its header."""
    mails = stored_mails(spark, sf_dir)
    hot = mails.withColumns({"mbox": F.lit("all"), "pr_numbers": F.when(F.col("seq") % 3 == 0, F.array(F.lit(1).cast("bigint"))).otherwise(F.col("pr_numbers"))})
    merged = M.merge_by_pr(hot, stored(M.members(hot, span=64), "members"))
    return merged.texts.join(merged.heads, M.MAIL).select("mbox", "seq", "members", "subject", "rank", "body", text_of("tags").alias("tags"))


@query
def merge_keep_unlinked(spark, sf_dir):
    return heads_columns(merged_mails(spark, sf_dir, keep_unlinked=True).heads)


@query
def merge_lists(spark, sf_dir):
    return merged_mails(spark, sf_dir).values


@query
def merge_markdown(spark, sf_dir):
    return merged_mails(spark, sf_dir).markdown


@query
def merge_markdown_union(spark, sf_dir):
    return merged_mails(spark, sf_dir, keep_unlinked=True, union_markdown=True, skip_sonar=True).markdown


@query
def merge_body(spark, sf_dir):
    return merged_mails(spark, sf_dir).texts


@query_as("ingest_counts")
def ingest_counts_merged(spark, sf_dir):
    return ingest_counts(merged_mails(spark, sf_dir).heads)


def _entries(vectors: DataFrame, *keys: str) -> DataFrame:
    return vectors.select(*keys, F.posexplode("embedding").alias("place", "x")).select(*keys, "place", (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("x"))


@query
def index_roundtrip(spark, sf_dir):
    """Write the whole index, read it back: PR keys with their mails' titles and text rows."""
    out = scratch_dir(spark)
    write_index(mails(spark, sf_dir), out)
    tables = read_index(spark, out)
    merged = merged_of(tables)
    bodies = merged.texts.groupBy("mbox", "seq").agg(F.sum(F.length("body")).alias("body_chars"))
    return tables["mail_pr"].join(merged.heads, M.MAIL).join(bodies, M.MAIL).join(tables["vectors"], M.MAIL).select(
        "pr", "mbox", "seq", "members", "pr_title", "body_chars", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_entry")
    )


@query
def index_growth(spark, sf_dir):
    """An index over two thirds of the mailboxes, the others added: all vectors."""
    out = scratch_dir(spark)
    stored = stored_mails(spark, sf_dir)
    later = F.crc32(F.col("mbox").cast("binary")) % 3 == 0
    write_index(stored.where(~later), out)
    add_mails(stored.where(later), out)
    return _entries(read_index(spark, out)["vectors"], "mbox", "seq")


# --- links and threads -----------------------------------------------------------------


@query
def pr_graph(spark, sf_dir):
    return G.pr_graph(stored_mails(spark, sf_dir))


@query
def pr_edges(spark, sf_dir):
    return G.pr_edges(stored_mails(spark, sf_dir))


@query
def mail_threads(spark, sf_dir):
    return threads.mail_threads(threads.thread_headers(derived_replies(spark, sf_dir)))


# --- changes and activity --------------------------------------------------------------


@query
def change_counts(spark, sf_dir):
    files = F.posexplode(D.change_counts(_body())).alias("file", "f")
    return derived_patches(spark, sf_dir).select("mbox", "seq", files).select("mbox", "seq", "file", "f.*")


def active_mails(spark, sf_dir):
    return stored(X.extract(derived_activity(spark, sf_dir)).select("mbox", "seq", "sender", "date", "repos", "tags"), "active")


@query
def mail_dates(spark, sf_dir):
    return derived_activity(spark, sf_dir).select("mbox", "seq", F.unix_timestamp(mail_time(F.col("date"))).alias("at"))


@query
def repo_cube(spark, sf_dir):
    return A.repo_cube(active_mails(spark, sf_dir)).withColumn("week", F.col("week").cast("string"))


@query
def repo_contributors(spark, sf_dir):
    """Contributors of each repository from stored sketches, beside the exact number: within 5 %."""
    mails = active_mails(spark, sf_dir)
    cells = stored(A.repo_activity(mails), "cells")
    exact = A.activity(mails).select(F.explode_outer("repos").alias("repo"), "sender").groupBy(F.coalesce("repo", F.lit("")).alias("repo")).agg(
        F.count_distinct("sender").alias("exact")
    )
    near = F.abs(F.col("contributors") - F.col("exact")) <= F.greatest(F.col("exact") * 0.05, F.lit(1))
    return A.rolled_up(cells, "repo").join(exact, "repo").select("repo", "entries", "exact", near.alias("within"))


@query
def repo_sessions(spark, sf_dir):
    seconds = {c: F.unix_timestamp(c) for c in ("first", "last")}
    return A.repo_sessions(active_mails(spark, sf_dir)).withColumns(seconds)


# --- rendering -------------------------------------------------------------------------


@query
def full_text(spark, sf_dir):
    return full_text_rows(merged_mails(spark, sf_dir))


@query
def context_blocks(spark, sf_dir):
    return context_rows(merged_mails(spark, sf_dir))


# --- questions -------------------------------------------------------------------------


@query
def route_questions(spark, sf_dir):
    return Q.routes(derived_questions(spark, sf_dir))


@query
def pr_lookup(spark, sf_dir):
    return Q.pr_lookup(routed(spark, sf_dir), Q.mail_pr(merged_mails(spark, sf_dir).heads))


@query
def commit_lookup(spark, sf_dir):
    return Q.commit_lookup(routed(spark, sf_dir), Q.mail_commit(merged_mails(spark, sf_dir).values))


@query
def commit_prefix_lookup(spark, sf_dir):
    return Q.commit_lookup(routed(spark, sf_dir), Q.mail_commit(merged_mails(spark, sf_dir).values), prefix=True)


@query
def lookup_misses(spark, sf_dir):
    merged = searched_mails(spark, sf_dir)
    return Q.lookup_misses(routed(spark, sf_dir), Q.mail_pr(merged.heads), Q.mail_commit(merged.values))


@query
def question_context(spark, sf_dir):
    merged = stored_merged(spark, sf_dir)
    hits = context.key_hits(routed(spark, sf_dir), Q.mail_pr(merged.heads), Q.mail_commit(merged.values))
    return context.key_contexts(hits, context_rows(merged))


@query
def question_context_parts(spark, sf_dir):
    """How many rows and characters each section of a key's context has, over whole bodies."""
    rows = question_context(spark, sf_dir)
    return rows.groupBy("mode", "key", "section", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars")
    )


def nearest_mails(encoder: HashedEncoder, questions: DataFrame, k: int = 5) -> DataFrame:
    """Every merged mail has a vector, so every mail can be a neighbour."""
    return K.knn(stored(encoder.mails(), "vectors"), stored(encoder.questions(questions), "asked"), k)


def answer_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The mails of each question's context, written once, and the rows of all mails."""
    merged = stored_merged(spark, sf_dir)
    routes = routed(spark, sf_dir)
    questions = routes.where("mode = 'semantic'").select("query_id", F.col("question").alias("text"))
    near = nearest_mails(HashedEncoder(stored_terms(merged)), questions)
    semantic = rerank_by_tags(near, questions, merged.heads, context.MAIL_ID)
    hits = context.context_hits(routes, Q.mail_pr(merged.heads), Q.mail_commit(merged.values), semantic)
    return stored(hits, "hits"), context_rows(merged)


@query
def answer_contexts(spark, sf_dir):
    return context.contexts_of(*answer_hits(spark, sf_dir))


@query
def prompts(spark, sf_dir):
    return context.prompts(context.contexts_of(*answer_hits(spark, sf_dir)))


@query
def budgeted_prompts(spark, sf_dir):
    """One prompt text per question: bodies of at most 1,500 characters, contexts of at most 6,000."""
    return context.budgeted_answers(*answer_hits(spark, sf_dir), 6000, 1500)


# --- nearest neighbours and ranking ----------------------------------------------------


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _question_vectors(spark, sf_dir):
    """One vector per benchmark item: the given embedding of the same number."""
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    vectors = _vectors(spark, sf_dir)
    return items.join(vectors, items["query_id"] == vectors["vec_id"]).select("query_id", "embedding")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "vec_id", "rank", F.round("dist", 4).alias("dist"))


@query
def knn_top5(spark, sf_dir):
    return _rounded(K.knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), 5, ["vec_id"]))


@query
def knn_topk(spark, sf_dir):
    return _rounded(K.knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), 10, ["vec_id"]))


@query
def knn_topk_blocks(spark, sf_dir):
    """The same by a grid of many small blocks."""
    return _rounded(K.knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), 10, ["vec_id"], question_block=16, vector_block=100))


@query
def knn_cells(spark, sf_dir):
    """Near neighbours by the stored index of cells: approximate, exact distances."""
    index = C.write_cells(_vectors(spark, sf_dir), scratch_dir(spark), ["vec_id"])
    return _rounded(C.knn_cells(index, _question_vectors(spark, sf_dir), 5, ["vec_id"]))


@query
def knn_cells_all(spark, sf_dir):
    """The same with every cell probed, which leaves nothing to chance but the order of the codes."""
    index = C.write_cells(_vectors(spark, sf_dir), scratch_dir(spark), ["vec_id"], cells=16, block=100)
    return _rounded(C.knn_cells(index, _question_vectors(spark, sf_dir), 5, ["vec_id"], probe=1.0))


@query
def knn_lsh(spark, sf_dir):
    return _rounded(K.knn_lsh(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), 5, ["vec_id"]))


@query
def tag_rerank(spark, sf_dir):
    hits = K.knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), 10, ["vec_id"])
    tags = mails(spark, sf_dir).select(F.col("seq").alias("vec_id"), "tags")
    return rerank_by_tags(hits, derived_questions(spark, sf_dir), tags, ["vec_id"])


@query
def lexical_score(spark, sf_dir):
    """Score of each question with each mail of the PR it names."""
    merged = searched_mails(spark, sf_dir)
    pairs = Q.pr_lookup(routed(spark, sf_dir), Q.mail_pr(merged.heads)).select("query_id", "mbox", "seq")
    return L.lexical_scores(L.mail_values(merged), derived_questions(spark, sf_dir), pairs)


@query
def lexical_top10(spark, sf_dir):
    return L.lexical_top(L.mail_values(searched_mails(spark, sf_dir)), derived_questions(spark, sf_dir), 10)


@query
def hybrid_hits(spark, sf_dir):
    merged = searched_mails(spark, sf_dir)
    questions = derived_questions(spark, sf_dir)
    near = nearest_mails(HashedEncoder(stored_terms(merged)), questions)
    return L.hybrid_hits(L.lexical_top(L.mail_values(merged), questions, 3), near, 5)


# --- encoder ---------------------------------------------------------------------------


@query_as("embed_mails")
def embed_merged_mails(spark, sf_dir):
    return _entries(HashedEncoder(stored_terms(searched_mails(spark, sf_dir))).mails(), "mbox", "seq")


@query
def embed_questions(spark, sf_dir):
    encoder = HashedEncoder(stored_terms(searched_mails(spark, sf_dir)))
    return _entries(encoder.questions(derived_questions(spark, sf_dir)), "query_id")


@query
def semantic_hits(spark, sf_dir):
    """Questions and mails through the native encoder: nearest mails, re-ranked by tags."""
    merged = searched_mails(spark, sf_dir)
    questions = derived_questions(spark, sf_dir)
    near = nearest_mails(HashedEncoder(stored_terms(merged)), questions)
    return rerank_by_tags(near, questions, merged.heads, context.MAIL_ID)


def expansions(spark, sf_dir):
    merged = searched_mails(spark, sf_dir)
    questions, terms = derived_questions(spark, sf_dir), stored_terms(merged)
    hits = L.lexical_top(L.mail_values(merged), questions, E.HITS)
    return stored(E.expansion(hits, E.entity_rows(merged), terms), "added"), questions, terms


@query
def expansion_terms(spark, sf_dir):
    """What each question is widened by: words of the entities of its best lexical hits."""
    added, _, _ = expansions(spark, sf_dir)
    return added.select("query_id", "word", F.round("w", 6).alias("w"))


@query
def augmented_hits(spark, sf_dir):
    """Nearest mails of the widened questions."""
    added, questions, terms = expansions(spark, sf_dir)
    asked = stored(E.augmented_questions(questions, added, terms), "asked")
    near = K.knn(stored(HashedEncoder(terms).mails(), "vectors"), asked)
    return near.select("query_id", "mbox", "seq", "rank")
