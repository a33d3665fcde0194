"""Registered queries: index build and retrieval (T1-T5, A2, A4, A5, J3, J5,
W1, L4, F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments
from ..operators.index import build_index
from ..operators.search import bm25_topk, filter_condition, search, text_match
from ..session import shared_path
from ..sources.tables import load_corpus, load_queries
from .catalog import (BENCH_CTE, DOCS_CTE, register, sql_bm25_ctes, sql_index_ctes,
                      sql_snippet)

IDX = sql_index_ctes()


@register("index_postings", f"""
with {DOCS_CTE}, {IDX}
select term, article_id, tf from postings""")
def index_postings(spark, sf_dir):
    return build_index(load_corpus(spark, sf_dir)).postings.select("term", "article_id", "tf")


@register("index_doc_stats", f"""
with {DOCS_CTE}, {IDX}
select article_id, dl as len from doc_stats""")
def index_doc_stats(spark, sf_dir):
    return build_index(load_corpus(spark, sf_dir)).doc_stats


@register("index_term_stats", f"""
with {DOCS_CTE}, {IDX}
select term, df from term_stats""")
def index_term_stats(spark, sf_dir):
    return build_index(load_corpus(spark, sf_dir)).term_stats


@register("index_corpus", f"""
with {DOCS_CTE}, {IDX}
select n_docs, round(avgdl, 6) as avgdl from corpus""")
def index_corpus(spark, sf_dir):
    c = build_index(load_corpus(spark, sf_dir)).corpus
    return c.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def _topk_sql(k: int) -> str:
    return f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}
select query_id, article_id, score, rank from (
  select query_id, article_id, score,
         cast(row_number() over (partition by query_id order by score desc, article_id) as bigint) as rank
  from scores) where rank <= {k}"""


@register("bm25_top5", _topk_sql(5))
def bm25_top5(spark, sf_dir):
    idx = build_index(load_corpus(spark, sf_dir), materialize=True)
    return bm25_topk(load_queries(spark, sf_dir), idx, k=5)


@register("bm25_top10", _topk_sql(10))
def bm25_top10(spark, sf_dir):
    idx = build_index(load_corpus(spark, sf_dir), materialize=True)
    return bm25_topk(load_queries(spark, sf_dir), idx, k=10)


@register("text_match_counts", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}
select q.query_id, cast(count(s.article_id) as bigint) as n_matches
from q left join scores s on s.query_id = q.query_id group by q.query_id""")
def text_match_counts(spark, sf_dir):
    queries = load_queries(spark, sf_dir)
    idx = build_index(load_corpus(spark, sf_dir), materialize=True)
    m = text_match(queries, idx)
    return (queries.select("query_id").join(m, "query_id", "left")
            .groupBy("query_id").agg(F.count("article_id").cast("long").alias("n_matches")))


@register("search_results", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()},
hits as (select query_id, article_id, score, rank,
                cast(count(*) over (partition by query_id) as bigint) as total
         from (select query_id, article_id, score,
                      cast(row_number() over (partition by query_id order by score desc, article_id) as bigint) as rank
               from scores) where rank <= 5)
select h.query_id, q.query, h.rank, h.article_id, 'Untitled' as title,
       {sql_snippet('d.content', 'q.query')} as preview,
       h.score, cast(null as varchar) as publish_date, 'Unknown' as author, h.total
from hits h join q on q.query_id = h.query_id join docs d on d.article_id = h.article_id""")
def search_results(spark, sf_dir):
    articles = load_corpus(spark, sf_dir)
    idx = build_index(articles, materialize=True)
    return search(articles, load_queries(spark, sf_dir), idx, k=5)


@register("bm25_saved_index_top5", _topk_sql(5))
def bm25_saved_index_top5(spark, sf_dir):
    """From an index on storage: blocks by term, exact pruning."""
    index = segments.add(load_corpus(spark, sf_dir), shared_path(spark, "segments"))
    return segments.segment_topk(load_queries(spark, sf_dir), segments.open_index(spark, index.base), k=5)


@register("bm25_updated_index_top5", f"""
with docs as (select cast(doc_id as varchar) as article_id, text as content, source from documents where doc_id % 7 <> 1),
{BENCH_CTE}, {IDX}, {sql_bm25_ctes()}
select query_id, article_id, score, rank from (
  select query_id, article_id, score,
         cast(row_number() over (partition by query_id order by score desc, article_id) as bigint) as rank
  from scores) where rank <= 5""")
def bm25_updated_index_top5(spark, sf_dir):
    """An index that grew by imports: two thirds of the articles, a quarter of those with an earlier text; then the rest
    and the changed ones; then some are removed."""
    articles, base = load_corpus(spark, sf_dir), shared_path(spark, "segments")
    n = F.col("article_id").cast("long")
    earlier = F.when(n % 4 == 0, F.concat(F.lit("earlier "), F.reverse("content"))).otherwise(F.col("content"))
    segments.add(articles.where(n % 3 != 0).withColumn("content", earlier), base)
    segments.add(articles.where((n % 3 == 0) | (n % 4 == 0)), base)
    index = segments.remove(spark, base, articles.where(n % 7 == 1).select("article_id"))
    return segments.segment_topk(load_queries(spark, sf_dir), index, k=5)


@register("filtered_saved_index_top10", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}
select query_id, article_id, score, rank from (
  select s.query_id, s.article_id, s.score,
         cast(row_number() over (partition by s.query_id order by s.score desc, s.article_id) as bigint) as rank
  from scores s join docs d on d.article_id = s.article_id where d.source in ('src1', 'src2', 'src3')) where rank <= 10""")
def filtered_saved_index_top10(spark, sf_dir):
    """F3 on a stored index: only blocks with an allowed article are read."""
    articles = load_corpus(spark, sf_dir)
    index = segments.add(articles, shared_path(spark, "segments"))
    only = articles.where(filter_condition({"source": ["src1", "src2", "src3"]}))
    return segments.segment_topk(load_queries(spark, sf_dir), index, k=10, only=only)
