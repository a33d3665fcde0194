"""Bulk BM25 retrieval, text search and search-result rows.

Every operator takes a **table** of queries ``(query_id, query)`` and returns
``query_id``-keyed rows, so one scan of the index serves a whole batch.

Plan shape of ``bm25_topk`` on a materialised index (see ``explain``):

1. query terms (size-checked) ⋈ ``term_stats`` → ``(query_id, term, idf)``;
   corpus size and average length are scalar subqueries
2. ``postings ⋈ broadcast(weighted query terms)`` — the postings stream, a
   hot term just means a longer scan, never one huge task
3. ``sum`` per (query, article) with **no exchange**: ``doc_terms`` is
   hash-partitioned by ``article_id`` (checkpoint or bucketed table), so all
   postings of an article are already in one task
4. ``row_number() <= k`` → Catalyst's ``WindowGroupLimit`` keeps k rows per
   query per partition before the only exchange (on ``query_id``).

Query terms beyond the broadcast bound are joined by a shuffle on ``term``.
Large batches of queries are scored by blocks of articles (``block_scores``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens, with_snippet
from ..schemas import ARTICLES
from .block_scores import block_scores, readable
from .index import TextIndex
from .listing import DEFAULT_AUTHOR, DEFAULT_TITLE
from .sizing import MAX_BROADCAST_ROWS, count_upto, maybe_broadcast

# Fixed values of the ranking function (Robertson & Zaragoza 2009).
K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
# So many (query, term) rows are a large batch.
MANY_QUERY_TERMS = 20_000


def rank_within(df: DataFrame, k: int | None, partition: str = "query_id",
                order: list[Column] | None = None, rank_col: str = "rank") -> DataFrame:
    """``row_number`` per ``partition`` (score desc, article_id asc) and ``rank <= k``."""
    order = order or [F.col("score").desc_nulls_last(), F.col("article_id").asc()]
    w = Window.partitionBy(partition).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    return ranked if k is None else ranked.filter(F.col(rank_col) <= k)


def query_term_table(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """Distinct index tokens of each query: ``(query_id, term)``."""
    return (queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
            .filter(F.col("term").isNotNull()))


def weighted_query_terms(query_terms: DataFrame, index: TextIndex,
                         max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Attach ``df`` and ``idf`` to query terms; drop terms unknown to the index.

    Returns the table and whether it was proven small enough to broadcast.
    """
    small = count_upto(query_terms, max_broadcast_rows) <= max_broadcast_rows
    n = index.n_docs()
    qt = index.term_stats.join(maybe_broadcast(query_terms, small), "term")
    others = [c for c in query_terms.columns if c not in ("query_id", "term")]
    qt = qt.select("query_id", "term", "df",
                   F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), *others)
    return qt, small


def bm25_scores(queries: DataFrame, index: TextIndex, k1: float = K1, b: float = B,
                text_col: str = "query",
                max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                weighted: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """All candidate scores ``(query_id, article_id, score)``.

    A candidate has at least one query term. Scores are rounded to
    ``SCORE_DIGITS`` places so the ranking does not depend on summation order.
    ``weighted`` passes precomputed ``weighted_query_terms`` output; where that
    has ``must`` (1 for a term that an article must hold, else 0) and ``need``
    (how many such terms the query has), other articles are no candidates; nor
    is one with a term whose ``ban`` is 1 (0 for terms that score).
    """
    if weighted is None:
        weighted = weighted_query_terms(query_term_table(queries, text_col), index, max_broadcast_rows)
    qt, small = weighted
    avgdl = index.avgdl()
    p = index.postings

    # beyond the bound the postings are shuffled by term, once for any number
    # of query terms; adaptive execution splits the hot terms' partitions
    asked = [c for c in ("must", "need", "ban") if c in qt.columns]
    sums = p.join(maybe_broadcast(qt.select("term", "query_id", "idf", *asked), small), "term").select(
        "query_id", "article_id", *asked,
        (F.col("idf") * F.col("tf") * (k1 + 1)
         / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))).alias("w")) \
        .groupBy("query_id", "article_id").agg(
            F.sum("w").alias("w"), *([F.sum("must").alias("have"), F.max("need").alias("need")] if "must" in asked else []),
            *([F.max("ban").alias("banned"), F.min("ban").alias("unfound")] if "ban" in asked else []))
    if "must" in asked:
        sums = sums.filter(F.col("have") >= F.col("need"))
    if "ban" in asked:
        # a null id equals none, so that it isn't excluded
        known = F.col("query_id").isNotNull() & F.col("article_id").isNotNull()
        sums = sums.filter((F.col("unfound") == 0) & ((F.col("banned") == 0) | ~known))
    return sums.select("query_id", "article_id", F.round("w", SCORE_DIGITS).alias("score"))


def bm25_topk(queries: DataFrame, index: TextIndex, k: int = 10, k1: float = K1, b: float = B,
              text_col: str = "query", max_broadcast_rows: int = MAX_BROADCAST_ROWS,
              weighted: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """Top-``k`` articles per query, ``(query_id, article_id, score, rank)``.

    Candidates grow with queries times articles. Beyond ``MANY_QUERY_TERMS``
    they are no rows, but sums in arrays (``block_scores``), where tasks can
    open files of the shared folder.
    """
    terms = query_term_table(queries, text_col)
    if terms.count() > MANY_QUERY_TERMS and readable(index.doc_terms.sparkSession):
        known, _ = weighted or weighted_query_terms(terms, index, max_broadcast_rows)
        best = block_scores(known, index, k, k1, b)
        return rank_within(best.withColumn("score", F.round("score", SCORE_DIGITS)), k)
    return rank_within(bm25_scores(queries, index, k1, b, text_col, max_broadcast_rows, weighted), k)


def text_match(queries: DataFrame, index: TextIndex, **kw) -> DataFrame:
    """``(query_id, article_id)`` of articles matching any query term."""
    return bm25_scores(queries, index, **kw).select("query_id", "article_id")


def _with_defaults(articles: DataFrame) -> DataFrame:
    """Metadata read through defaults; a present empty string stays."""
    extra = ["bucket"] if "bucket" in articles.columns else []
    return articles.select(
        "article_id", *extra, "content",
        F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce("author", F.lit(DEFAULT_AUTHOR)).alias("author"),
        F.col("publish_date_raw").alias("publish_date"),
    )


def attach_articles(hits: DataFrame, articles: DataFrame, n_hits_bound: int | None,
                    max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hits ⋈ articles. Hits are at most ``queries × k`` rows; broadcast
    them against the article scan when that bound is proven small."""
    small = n_hits_bound is not None and n_hits_bound <= max_broadcast_rows
    return join_hits(_with_defaults(articles), hits, small)


def join_hits(articles: DataFrame, hits: DataFrame, small: bool) -> DataFrame:
    """Join hit rows to articles. On a bucketed store (``bucket`` partition
    column, see ``store.write_bucketed_store``) the join also matches the
    bucket, so dynamic partition pruning skips every bucket without a hit."""
    if "bucket" in articles.columns:
        n = int(articles.schema["bucket"].metadata.get("quire.buckets", 0))
        if n > 0:
            hits = hits.withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(n)).cast("int"))
            return articles.join(maybe_broadcast(hits, small), ["bucket", "article_id"]).drop("bucket")
        articles = articles.drop("bucket")
    return articles.join(maybe_broadcast(hits, small), "article_id")


def search(articles: DataFrame, queries: DataFrame, index: TextIndex, k: int = 5,
           max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """T5: search-result rows with snippets (T4) and per-query totals (A2).

    Columns: ``query_id, query, rank, article_id, title, preview, score,
    publish_date, author, total``.
    """
    n_queries = count_upto(queries.select("query_id", "query"), max_broadcast_rows)
    q_small = n_queries <= max_broadcast_rows
    hits = bm25_topk(queries, index, k, max_broadcast_rows=max_broadcast_rows)
    hits = hits.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("query_id")).cast("long"))
    rows = attach_articles(hits, articles, n_queries * k if q_small else None, max_broadcast_rows)
    # the query's text joins after the articles, so that hits carry no text and it's broadcast once, not k times
    rows = rows.join(maybe_broadcast(queries.select("query_id", "query"), q_small), "query_id")
    rows = with_snippet(rows, "content", "query", "preview")
    return rows.select(
        "query_id", "query", "rank", "article_id", "title", "preview",
        "score", "publish_date", "author", "total")


# ---------------------------------------------------------------- text search

# Query operators of the text search syntax: a negated phrase, a
# phrase, an excluded word, whichever begins first.
OPERATOR_PATTERN = '(?:^|\\s)-"[^"]*"|"[^"]*"|(?:^|\\s)-[^\\s"]+'
# From the first to the last token character of a word.
INNER_PATTERN = "[\\p{L}\\p{N}_].*[\\p{L}\\p{N}_]"
# A token of a phrase with other characters on both sides.
WHOLE_WORD_PATTERN = "(?<=[^\\p{L}\\p{N}_])[\\p{L}\\p{N}_]+(?=[^\\p{L}\\p{N}_])"


def parse_text_query(queries: DataFrame) -> DataFrame:
    """split a raw query into scoring text, phrases, excluded terms and
    excluded phrases.

    ``"…"`` phrases must be contained (case-insensitive); ``-term`` tokens and
    ``-"…"`` phrases must be absent; an excluded word of several tokens
    (``-well-read``) is one phrase; a ``-`` inside quotes is text. Phrase words
    still score; excluded words do not.
    """
    q = F.coalesce(F.col("query"), F.lit(""))

    def bare(s: Column) -> Column:
        return F.lower(F.regexp_replace(s, '^-|"', ""))

    def nonempty(a: Column) -> Column:
        return F.filter(a, lambda s: F.length(s) > 0)

    pieces = queries.select(
        "query_id", "query", F.regexp_replace(q, OPERATOR_PATTERN, " ").alias("_rest"),
        F.transform(F.regexp_extract_all(q, F.lit(OPERATOR_PATTERN), 0), lambda s: F.regexp_replace(s, "^\\s", "")).alias("_pieces"))
    parts = pieces.select(
        "query_id", "query", "_rest",
        nonempty(F.transform(F.filter("_pieces", lambda s: s.startswith('"')), bare)).alias("phrases"),
        nonempty(F.transform(F.filter("_pieces", lambda s: s.startswith('-"')), bare)).alias("_negated"),
        F.transform(F.filter("_pieces", lambda s: s.startswith("-") & ~s.startswith('-"')), bare).alias("_words"))
    return parts.select(
        "query_id", "query",
        F.concat_ws(" ", "_rest", F.array_join("phrases", " ")).alias("positive"),
        "phrases",
        F.flatten(F.transform(F.filter("_words", lambda s: F.size(tokens(s)) == 1), lambda s: tokens(s))).alias("excluded"),
        F.concat("_negated", F.transform(F.filter("_words", lambda s: F.size(tokens(s)) > 1),
                                         lambda s: F.regexp_extract(s, INNER_PATTERN, 0))).alias("excluded_phrases"),
    )


def phrase_scores(parsed: DataFrame, index: TextIndex, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                  excluded: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """scores of the articles that can hold all phrases of their query, and
    none of the ``excluded`` terms (``query_id, term``, and whether they are few).

    A phrase is contained as text, so its first and last word may be parts of
    longer ones. The words between them stand whole in the article, so the
    postings decide on those, in the aggregate that sums the scores: no article
    text and no further shuffle. Needs an index of both title and content.
    """
    words = F.flatten(F.transform("phrases", lambda s: F.regexp_extract_all(s, F.lit(WHOLE_WORD_PATTERN), 0)))
    terms = parsed.withColumn("_whole", F.array_distinct(words)).select(
        "query_id", F.size("_whole").alias("need"), "_whole",
        F.explode(F.array_distinct(tokens(F.col("positive")))).alias("term")).filter(F.col("term").isNotNull())
    terms = terms.select("query_id", "term", F.array_contains("_whole", F.col("term")).cast("int").alias("must"), "need")
    return bm25_scores(parsed, index, max_broadcast_rows=max_broadcast_rows,
                       weighted=_with_bans(weighted_query_terms(terms, index, max_broadcast_rows), excluded))


def _with_bans(weighted: tuple[DataFrame, bool], excluded: tuple[DataFrame, bool] | None) -> tuple[DataFrame, bool]:
    """Excluded terms beside those that score, so that the aggregate of the scores decides on them too."""
    if excluded is None:
        return weighted
    (terms, small), (bans, few) = weighted, excluded
    bans = bans.select("query_id", "term", F.lit(0.0).alias("idf"), F.lit(1).alias("ban"), *[F.lit(0).alias(c) for c in ("must", "need") if c in terms.columns])
    return terms.drop("df").withColumn("ban", F.lit(0)).unionByName(bans), small and few


def text_search_scores(queries: DataFrame, articles: DataFrame, index: TextIndex,
                       max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """T3 candidates after F4: ``(query_id, article_id, score)``.

    Queries with phrases are scored apart from the others, so that only their
    candidates are written down and have their text read.
    """
    parsed = parse_text_query(queries)
    # exclusions: terms of the aggregate that take an article out
    excl = parsed.select("query_id", F.explode(F.array_distinct("excluded")).alias("term"))
    n_excl = count_upto(excl, max_broadcast_rows)
    excluded = (excl, n_excl <= max_broadcast_rows) if n_excl else None

    def scored(asked: DataFrame, with_phrases: bool = False) -> DataFrame:
        if with_phrases and {"title", "content"} <= set(index.fields):
            return phrase_scores(asked, index, max_broadcast_rows, excluded)
        terms = query_term_table(asked, "positive")
        weighted = _with_bans(weighted_query_terms(terms, index, max_broadcast_rows), excluded)
        return bm25_scores(asked, index, max_broadcast_rows=max_broadcast_rows, weighted=weighted)

    checks = (F.size("phrases") > 0) | (F.size("excluded_phrases") > 0)
    with_phr = parsed.filter(checks).select("query_id", "phrases", "excluded_phrases")
    n_phr = count_upto(with_phr, max_broadcast_rows)
    if n_phr == 0:
        return scored(parsed)
    from ..session import cut_lineage
    cand = cut_lineage(scored(parsed.filter(checks), with_phrases=True))
    # once written they are counted cheaply; when bounded they are broadcast
    # and the article text streams past them (with bucket pruning on a bucketed
    # store), else a shuffle join
    phr_cand = cand.join(maybe_broadcast(with_phr, n_phr <= max_broadcast_rows), "query_id")
    phr_small = count_upto(phr_cand, max_broadcast_rows) <= max_broadcast_rows
    extra = ["bucket"] if "bucket" in articles.columns else []
    # lower-cased once for each article, not for each candidate
    texts = articles.select("article_id", *extra, F.lower(F.coalesce("content", F.lit(""))).alias("_body"),
                            F.lower(F.coalesce("title", F.lit(""))).alias("_head"))
    checked = (join_hits(texts, phr_cand, phr_small)
               .filter(F.forall("phrases", lambda s: F.col("_body").contains(s) | F.col("_head").contains(s))
                       & ~F.exists("excluded_phrases", lambda s: F.col("_body").contains(s) | F.col("_head").contains(s)))
               .select("query_id", "article_id", "score"))
    return scored(parsed.filter(~checks)).unionByName(checked)


def text_search(queries: DataFrame, articles: DataFrame, index: TextIndex, k: int = 10,
                max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """T3 + L5 + A2: highest text score first, ``count`` = returned hits."""
    hits = rank_within(text_search_scores(queries, articles, index, max_broadcast_rows), k)
    return hits.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("query_id")).cast("long"))


def text_search_rows(queries: DataFrame, articles: DataFrame, index: TextIndex, k: int = 10,
                     max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """T3 as the production service returns it: the query, the whole article, its
    score, and the number of returned hits."""
    n_queries = count_upto(queries, max_broadcast_rows)
    hits = text_search(queries, articles, index, k, max_broadcast_rows)
    # columns of their own: a checkpointed index may share those of the articles that it was built from
    hits = hits.select([F.col(c).alias(c) for c in hits.columns])
    rows = join_hits(articles, hits, n_queries * k <= max_broadcast_rows)
    # the query's text has no bound on its bytes, so no broadcast is asked for
    rows = rows.join(queries.select("query_id", "query"), "query_id")
    return rows.select("query_id", "query", "count", "rank", F.col("article_id").alias("id"), "filename", "title", "author",
                       "publish_date", "content", "created_at", "last_updated", "score")


def filtered_search(queries: DataFrame, articles: DataFrame, index: TextIndex,
                    filters: dict | None = None, k: int = 10,
                    max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """top-``k`` among articles that pass ``filters``.

    ``filters`` maps a column (or ``header`` key) to a value or a list of
    values; all entries must hold. Corpus statistics stay whole-corpus.
    """
    cond = filter_condition(filters)
    scores = bm25_scores(queries, index, max_broadcast_rows=max_broadcast_rows)
    if cond is not None:
        allowed = articles.filter(cond).select("article_id")
        scores = scores.join(allowed, "article_id", "left_semi")
    return rank_within(scores, k)


def filter_condition(filters: dict | None) -> Column | None:
    """a value that is not one of the column's type matches nothing, as no
    stored value equals it; None matches a missing value."""
    cond = None
    for field, value in (filters or {}).items():
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        known = field in _ARTICLE_COLUMNS
        target = F.col(field) if known else F.col("header").getItem(field)
        kind = ARTICLES[field].dataType if known else T.StringType()
        asked = [F.lit(str(v).lower() if isinstance(v, bool) else str(v)).try_cast(kind) for v in values if v is not None]
        c = F.coalesce(target.isin(*asked), F.lit(False)) if asked else F.lit(False)
        if None in values:
            c = c | target.isNull()
        cond = c if cond is None else cond & c
    return cond


_ARTICLE_COLUMNS = {"article_id", "filename", "title", "author", "publish_date",
                    "publish_date_raw", "content", "source", "created_at", "last_updated"}
