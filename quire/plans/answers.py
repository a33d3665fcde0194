"""Registered queries: text search, answers and prompts (T3, F3, F4, L5, L6,
L7, Q1-Q6, Q8, A6, A7, J2, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import py_split_ws
from ..operators import answer as qa
from ..operators.index import build_index
from ..operators.parse import good_rows, parse_articles
from ..operators.search import filtered_search, text_search, text_search_rows
from ..sources.tables import (archive_as_raw_files, derived_archive, load_corpus, load_queries,
                              read_table)
from .catalog import (ARCHIVE_SQL, BENCH_CTE, DOCS_CTE, oracle_of, register, sql_bm25_ctes,
                      sql_index_ctes, sql_parse_ctes, sql_split_ws, sql_strip, sql_tokens)

IDX = sql_index_ctes()
SENT_RX = "[^.!?\\n]+[.!?]?"


def _corpus_index(spark, sf_dir):
    arts = load_corpus(spark, sf_dir)
    return arts, build_index(arts, materialize=True)


def _topk_cte(name: str, k: int, scores: str = "scores") -> str:
    return f"""{name} as (select query_id, article_id, score, rank from (
  select query_id, article_id, score,
         cast(row_number() over (partition by query_id order by score desc, article_id) as bigint) as rank
  from {scores}) where rank <= {k})"""


READER_SQL = f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}, {_topk_cte('hits', 5)},
qv as (select query_id, sum(idf) as idf_total from qw group by query_id),
cut as (select article_id, content, regexp_extract_all(coalesce(content, ''), '{SENT_RX}|[.!?\\n]+') as ps
        from docs where article_id in (select article_id from hits)),
pieces as (select article_id, content, unnest(ps) as piece, generate_subscripts(ps, 1) as i from cut),
placed as (select article_id, content, piece, {sql_strip('piece')} as answer,
                  sum(length(piece)) over (partition by article_id order by i) - length(piece) as start_at from pieces),
sents0 as (select article_id, content, answer, min(start_at + instr(piece, answer) - 1) as pos
           from placed where not regexp_matches(piece, '^[.!?\\n]') and length(answer) > 0
           group by article_id, content, answer),
sents as (select article_id, answer, pos,
                 substr(content, cast(greatest(0, least(pos + floor(length(answer) / 2) - 250,
                                                   length(content) - 500)) + 1 as bigint), 500) as context,
                 list_distinct({sql_tokens('answer')}) as stoks
          from sents0),
cand as (select h.query_id, h.article_id, h.rank as doc_rank, s.answer, s.pos, s.context,
                round((select coalesce(sum(qw.idf), 0) from qw
                       where qw.query_id = h.query_id and list_contains(s.stoks, qw.term)) / qv.idf_total, 6) as score
         from hits h join qv on qv.query_id = h.query_id join sents s on s.article_id = h.article_id),
ranked as (select *, cast(row_number() over (partition by query_id
                  order by score desc, doc_rank, pos, answer) as bigint) as answer_rank
           from cand where score > 0),
answers as (select query_id, answer_rank, answer, score, context, article_id, doc_rank
            from ranked where answer_rank <= 3)"""


@register("qa_reader_answers", READER_SQL + "\nselect * from answers")
def qa_reader_answers(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    return qa.reader_answers(load_queries(spark, sf_dir), arts, idx, docs_k=5, answers_k=3)


FALLBACK_CTES = f"""{_topk_cte('fb_hits', 3)},
fb as (select h.query_id, h.rank, h.article_id, 'Untitled' as title, 'Unknown' as author,
              cast(null as varchar) as publish_date, left(coalesce(d.content, ''), 1000) as excerpt
       from fb_hits h join docs d on d.article_id = h.article_id),
fb_q as (select q.query_id,
                coalesce(string_agg('From ''' || fb.title || ''':' || chr(10) || fb.excerpt, chr(10) || chr(10)
                                    order by fb.rank), '') as context,
                max(case when fb.rank = 1 then fb.article_id end) as source_id,
                max(case when fb.rank = 1 then fb.title end) as source_title,
                max(case when fb.rank = 1 then fb.author end) as source_author,
                max(case when fb.rank = 1 then fb.publish_date end) as source_publish_date,
                cast(greatest(count(fb.article_id) - 1, 0) as bigint) as n_additional
         from q left join fb on fb.query_id = q.query_id group by q.query_id)"""


_ORACLE_QA_ANSWERS = READER_SQL + f""",
{FALLBACK_CTES},
comb as (select a.query_id,
                max(case when answer_rank = 1 then answer end)
                || coalesce(case when count(*) > 1 then chr(10) || chr(10) || 'Additional context:' || chr(10)
                   || string_agg('• ' || answer, chr(10) order by answer_rank) filter (where answer_rank > 1) end, '')
                   as answer,
                max(case when answer_rank = 1 then score end) as confidence,
                max(case when answer_rank = 1 then context end) as context,
                max(case when answer_rank = 1 then article_id end) as best_id
         from answers a group by a.query_id)
select c.query_id, c.answer, round(c.confidence, 6) as confidence, c.context,
       d.article_id as source_id, case when d.article_id is not null then 'Untitled' end as source_title,
       case when d.article_id is not null then 'Unknown' end as source_author,
       cast(null as varchar) as source_publish_date, cast(0 as bigint) as n_additional,
       cast(null as varchar) as error
from comb c left join docs d on d.article_id = c.best_id
union all
select f.query_id, '{qa.FALLBACK_ANSWER.replace("'", "''")}', cast(0.0 as double), f.context, f.source_id, f.source_title,
       f.source_author, f.source_publish_date, f.n_additional, cast(null as varchar)
from fb_q f where f.query_id not in (select query_id from answers)"""


@register("qa_answers", _ORACLE_QA_ANSWERS)
def qa_answers(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    return qa.flatten_answers(qa.answer_questions(load_queries(spark, sf_dir), arts, idx))


@register("qa_fallback", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}, {FALLBACK_CTES}
select query_id, '{qa.FALLBACK_ANSWER.replace("'", "''")}' as answer, cast(0.0 as double) as confidence, context,
       source_id, source_title, source_author, source_publish_date, n_additional, cast(null as varchar) as error
from fb_q""")
def qa_fallback(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    return qa.flatten_answers(qa.fallback_answers(load_queries(spark, sf_dir), arts, idx, k=3))


@register("qa_fallback_sources", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}, {FALLBACK_CTES}
select query_id, cast(rank - 1 as bigint) as position, title, excerpt, author, publish_date as date
from fb where rank > 1""")
def qa_fallback_sources(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    fb = qa.fallback_answers(load_queries(spark, sf_dir), arts, idx, k=3)
    return fb.select("query_id", F.posexplode("additional_sources").alias("p", "s")).select(
        "query_id", (F.col("p") + 1).cast("long").alias("position"), "s.title", "s.excerpt", "s.author",
        "s.date")


def sql_str(text: str) -> str:
    """A DuckDB string expression for ``text`` (newlines as ``chr(10)``)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


_PRE, _REST = qa.PROMPT_TEMPLATE.split("{documents}", 1)
_MID, _POST = _REST.split("{query}", 1)


@register("prompts_top10", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}, {_topk_cte('hits', 10)}
select q.query_id,
       {sql_str(_PRE)}
       || coalesce((select string_agg(coalesce(d.content, ''), chr(10) order by h.rank)
                    from hits h join docs d on d.article_id = h.article_id where h.query_id = q.query_id), '')
       || {sql_str(_MID)} || coalesce(q.query, '') || {sql_str(_POST)} as prompt
from q""")
def prompts_top10(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    return qa.prompts(load_queries(spark, sf_dir), arts, idx, k=10)


# ------------------------------------------------------------ program C search

ARCH_SQL = f"arch as ({ARCHIVE_SQL}), {sql_parse_ctes('arch', 'pa')}"
STORE_SQL = f"""{ARCH_SQL},
arts as (select article_id, title, author, body as content,
                try_strptime(fdate, '%Y-%m-%d') as publish_date from pa
         where not (fdate is not null and try_strptime(fdate, '%Y-%m-%d') is null)),
docs2 as (select * from arts)"""
IDX2 = sql_index_ctes("docs2", ("title", "content"))


def _store(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    arts = good_rows(parse_articles(archive_as_raw_files(derived_archive(docs)), "importer"))
    return arts, build_index(arts, fields=("title", "content"), materialize=True)


@register("text_search_top10", f"""
with {STORE_SQL}, {BENCH_CTE}, {IDX2}, {sql_bm25_ctes()}, {_topk_cte('top', 10)}
select query_id, article_id, score, rank, cast(count(*) over (partition by query_id) as bigint) as count
from top""")
def text_search_top10(spark, sf_dir):
    arts, idx = _store(spark, sf_dir)
    return text_search(load_queries(spark, sf_dir), arts, idx, k=10)


@register("text_search_results", f"""
with {ARCH_SQL}, arts as (select filename, article_id, title, author, body as content, try_strptime(fdate, '%Y-%m-%d') as publish_date from pa
         where not (fdate is not null and try_strptime(fdate, '%Y-%m-%d') is null)),
docs2 as (select * from arts), {BENCH_CTE}, {IDX2}, {sql_bm25_ctes()}, {_topk_cte('top', 10)}
select t.query_id, q.query, cast(count(*) over (partition by t.query_id) as bigint) as count, t.rank, t.article_id as id, a.filename, a.title,
       a.author, cast(a.publish_date as varchar) as publish_date, a.content, t.score
from top t join q on q.query_id = t.query_id join arts a on a.article_id = t.article_id""")
def text_search_results(spark, sf_dir):
    """T3 as the service returns it, whole articles and their queries."""
    arts, idx = _store(spark, sf_dir)
    rows = text_search_rows(load_queries(spark, sf_dir), arts, idx, k=10)
    return rows.drop("created_at", "last_updated").withColumn("publish_date", F.col("publish_date").cast("string"))


OP_RX = '(?:^|\\s)-"[^"]*"|"[^"]*"|(?:^|\\s)-[^\\s"]+'


def _bare(s: str) -> str:
    return f"lower(regexp_replace({s}, '^-|\"', '', 'g'))"


# F4 in SQL: CTEs ``tq`` (the parts of every query in ``q``) and ``pq`` (its scoring text)
OPERATOR_SQL = f"""
tq0 as (select query_id, query, regexp_replace(query, '{OP_RX}', ' ', 'g') as rest,
               list_transform(regexp_extract_all(query, '{OP_RX}'), lambda s: regexp_replace(s, '^\\s', '')) as pieces
        from q),
tq1 as (select query_id, query, rest,
               list_filter(list_transform(list_filter(pieces, lambda s: starts_with(s, '"')), lambda s: {_bare('s')}),
                           lambda s: length(s) > 0) as phrases,
               list_filter(list_transform(list_filter(pieces, lambda s: starts_with(s, '-"')), lambda s: {_bare('s')}),
                           lambda s: length(s) > 0) as negated,
               list_transform(list_filter(pieces, lambda s: starts_with(s, '-') and not starts_with(s, '-"')),
                              lambda s: {_bare('s')}) as words
        from tq0),
tq as (select query_id, query, rest || ' ' || coalesce(array_to_string(phrases, ' '), '') as positive, phrases,
              flatten(list_transform(list_filter(words, lambda s: len({sql_tokens('s')}) = 1), lambda s: {sql_tokens('s')})) as excluded,
              list_concat(negated, list_transform(list_filter(words, lambda s: len({sql_tokens('s')}) > 1),
                          lambda s: regexp_extract(s, '[\\p{{L}}\\p{{N}}_].*[\\p{{L}}\\p{{N}}_]'))) as excluded_phrases
       from tq1),
pq as (select query_id, positive as query from tq)"""


def _operator_queries(spark, sf_dir):
    """Benchmark texts rewritten with a phrase (first two words) and an
    excluded last word: ``"w1 w2" w3 … w(n-1) -wn``."""
    b = read_table(spark, sf_dir, "benchmark")
    w = b.select(F.col("item_id").cast("long").alias("query_id"), py_split_ws(F.col("text")).alias("w"))
    n = F.size("w")
    q = F.concat(F.lit('"'), F.get("w", 0), F.lit(" "), F.get("w", 1), F.lit('" '),
                 F.array_join(F.slice("w", F.lit(3), F.greatest(n - 3, F.lit(0))), " "),
                 F.lit(" -"), F.get("w", n - 1))
    return w.select("query_id", q.alias("query"))


OPQ_SQL = f"""q0 as (select item_id as query_id, {sql_split_ws('text')} as w from benchmark),
q as (select query_id, '"' || w[1] || ' ' || w[2] || '" ' || array_to_string(w[3:len(w) - 1], ' ')
             || ' -' || w[len(w)] as query from q0)"""


def _operator_search_sql(query_ctes: str) -> str:
    return f"""
with {STORE_SQL}, {query_ctes}, {OPERATOR_SQL}, {IDX2}, {sql_bm25_ctes('pq')},
banned as (select distinct e.query_id, p.article_id
           from (select query_id, unnest(excluded) as term from tq) e join postings p on p.term = e.term),
ok as (select s.query_id, s.article_id, s.score from scores s
       join tq on tq.query_id = s.query_id join arts a on a.article_id = s.article_id
       where not exists (select 1 from banned b where b.query_id = s.query_id and b.article_id = s.article_id)
         and coalesce(list_bool_and(list_transform(tq.phrases, lambda ph:
               contains(lower(coalesce(a.content, '')), ph) or contains(lower(coalesce(a.title, '')), ph))), true)
         and not coalesce(list_bool_or(list_transform(tq.excluded_phrases, lambda ph:
               contains(lower(coalesce(a.content, '')), ph) or contains(lower(coalesce(a.title, '')), ph))), false)),
{_topk_cte('top', 10, 'ok')}
select query_id, article_id, score, rank, cast(count(*) over (partition by query_id) as bigint) as count
from top"""


@register("text_search_operators", _operator_search_sql(OPQ_SQL))
def text_search_operators(spark, sf_dir):
    arts, idx = _store(spark, sf_dir)
    return text_search(_operator_queries(spark, sf_dir), arts, idx, k=10)


NEGATED_SQL = f"""q0 as (select item_id as query_id, {sql_split_ws('text')} as w from benchmark),
q as (select query_id, case query_id % 3
             when 0 then array_to_string(w, ' ') || ' -"' || w[1] || ' ' || w[2] || '"'
             when 1 then array_to_string(w, ' ') || ' -' || w[1] || '-' || w[2]
             else w[1] || ' "' || w[2] || ' -' || w[3] || '"' end as query from q0)"""


@register("text_search_negated", _operator_search_sql(NEGATED_SQL))
def text_search_negated(spark, sf_dir):
    """Benchmark texts with a negated phrase, a hyphened exclusion or, in
    quotes, a ``-`` that excludes nothing."""
    b = read_table(spark, sf_dir, "benchmark")
    w = b.select(F.col("item_id").cast("long").alias("query_id"), py_split_ws(F.col("text")).alias("w"))
    one, two, three, whole = F.get("w", 0), F.get("w", 1), F.get("w", 2), F.array_join("w", " ")
    kind = F.col("query_id") % 3
    q = (F.when(kind == 0, F.concat(whole, F.lit(' -"'), one, F.lit(" "), two, F.lit('"')))
         .when(kind == 1, F.concat(whole, F.lit(" -"), one, F.lit("-"), two))
         .otherwise(F.concat(one, F.lit(' "'), two, F.lit(" -"), three, F.lit('"'))))
    arts, idx = _store(spark, sf_dir)
    return text_search(w.select("query_id", q.alias("query")), arts, idx, k=10)


@register("qa_best_document", f"""
with {STORE_SQL}, {BENCH_CTE}, {IDX2}, {sql_bm25_ctes()}, {_topk_cte('top', 3)}
select q.query_id,
       case when a.article_id is null then '{qa.NO_MATCH_ANSWER.replace("'", "''")}' else left(coalesce(a.content, ''), 500) end as answer,
       coalesce(t.score, 0.0) as confidence, a.content as context,
       a.article_id as source_id, case when a.article_id is not null then coalesce(a.title, 'Untitled') end as source_title,
       case when a.article_id is not null then coalesce(a.author, 'Unknown') end as source_author,
       cast(a.publish_date as varchar) as source_publish_date
from q left join top t on t.query_id = q.query_id and t.rank = 1
left join arts a on a.article_id = t.article_id""")
def qa_best_document(spark, sf_dir):
    arts, idx = _store(spark, sf_dir)
    return _best_document_rows(qa.best_document_answers(load_queries(spark, sf_dir), arts, idx, k=3))


def _best_document_rows(r):
    return r.select("query_id", "answer", "confidence", "context",
                    F.col("source.id").alias("source_id"), F.col("source.title").alias("source_title"),
                    F.col("source.author").alias("source_author"),
                    F.col("source.publish_date").alias("source_publish_date"))


FILTER_SOURCES = ["src1", "src2", "src3"]


@register("filtered_search_top10", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()},
ok as (select s.* from scores s join docs d on d.article_id = s.article_id
       where d.source in ({", ".join(repr(x) for x in FILTER_SOURCES)})),
{_topk_cte('top', 10, 'ok')}
select * from top""")
def filtered_search_top10(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    return filtered_search(load_queries(spark, sf_dir), arts, idx, {"source": FILTER_SOURCES}, k=10)


@register("filtered_search_bad_value", f"""
with {STORE_SQL}, {BENCH_CTE}, {IDX2}, {sql_bm25_ctes()},
ok as (select s.* from scores s join arts a on a.article_id = s.article_id
       where a.publish_date = try_cast('no date' as timestamp)),
{_topk_cte('top', 10, 'ok')}
select * from top""")
def filtered_search_bad_value(spark, sf_dir):
    """A value that is no date matches no article: an empty result."""
    arts, idx = _store(spark, sf_dir)
    return filtered_search(load_queries(spark, sf_dir), arts, idx, {"publish_date": "no date"}, k=10)


def _first_sentence_reader(pdf):
    """Example batch reader for the hook: the passage's first sentence that
    contains a query word, scored by the share of query words it holds."""
    import re

    import pandas as pd
    rows = []
    for r in pdf.itertuples(index=False):
        words = set(re.findall(r"\w+", (r.query or "").lower()))
        if not words:
            continue
        for sent in re.findall(r"[^.!?\n]+[.!?]?", r.passage or ""):
            s = sent.strip()
            hit = words & set(re.findall(r"\w+", s.lower()))
            if s and hit:
                rows.append((r.query_id, r.article_id, r.doc_rank, s, len(hit) / len(words), s))
                break
    return pd.DataFrame(rows, columns=["query_id", "article_id", "doc_rank", "answer", "score", "context"])


@register("qa_reader_hook", f"""
with {DOCS_CTE}, {BENCH_CTE}, {IDX}, {sql_bm25_ctes()}, {_topk_cte('hits', 5)},
p as (select h.query_id, h.article_id, h.rank as doc_rank, list_distinct({sql_tokens('q.query')}) as words,
             list_transform(regexp_extract_all(coalesce(d.content, ''), '{SENT_RX}'), lambda s: {sql_strip('s')}) as sents
      from hits h join q on q.query_id = h.query_id join docs d on d.article_id = h.article_id),
a as (select query_id, article_id, doc_rank, words,
             list_filter(sents, lambda s: len(list_intersect({sql_tokens('s')}, words)) > 0)[1] as answer from p),
r as (select query_id, article_id, doc_rank, answer, answer as context,
             round(len(list_intersect(list_distinct({sql_tokens('answer')}), words)) / cast(len(words) as double), 6) as score
      from a where answer is not null),
o as (select *, cast(row_number() over (partition by query_id order by score desc, doc_rank, answer) as bigint) as answer_rank from r)
select * from o where answer_rank <= 3""")
def qa_reader_hook(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    return qa.hook_answers(load_queries(spark, sf_dir), arts, idx, _first_sentence_reader, 5, 3)



# ------------------------------------------------------------ second query table

CONV_CTE = ("q as (select cast(conv_id as bigint) * 4294967296 + turn as query_id, text as query "
            "from conversations where role = 'user')")


def _conv_queries(spark, sf_dir):
    from ..sources.tables import queries_from_conversations
    return queries_from_conversations(read_table(spark, sf_dir, "conversations"))


@register("conversation_top5", f"""
with {DOCS_CTE}, {CONV_CTE}, {IDX}, {sql_bm25_ctes()}, {_topk_cte('top', 5)}
select * from top""")
def conversation_top5(spark, sf_dir):
    from ..operators.search import bm25_topk
    arts, idx = _corpus_index(spark, sf_dir)
    return bm25_topk(_conv_queries(spark, sf_dir), idx, 5)


@register("conversation_answers", READER_SQL.replace(BENCH_CTE, CONV_CTE) + """
select query_id, answer_rank, answer, score, article_id, doc_rank from answers""")
def conversation_answers(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    r = qa.reader_answers(_conv_queries(spark, sf_dir), arts, idx, docs_k=5, answers_k=3)
    return r.select("query_id", "answer_rank", "answer", "score", "article_id", "doc_rank")


@register("conversation_qa_answers", _ORACLE_QA_ANSWERS.replace(BENCH_CTE, CONV_CTE))
def conversation_qa_answers(spark, sf_dir):
    arts, idx = _corpus_index(spark, sf_dir)
    return qa.flatten_answers(qa.answer_questions(_conv_queries(spark, sf_dir), arts, idx))


# ------------------------------------------------------------ queries that find nothing

# every fifth query has no terms, every fifth only a term of no document
MIXED_CTE = ("q as (select item_id as query_id, case when item_id % 5 = 0 then '§ … !' when item_id % 5 = 1 "
             "then 'zzqx' || item_id else text end as query from benchmark)")


def _mixed_queries(spark, sf_dir):
    n = F.col("query_id")
    return load_queries(spark, sf_dir).withColumn("query", F.when(n % 5 == 0, "§ … !").when(n % 5 == 1, F.concat(F.lit("zzqx"), n)).otherwise(F.col("query")))


@register("qa_best_document_nomatch", oracle_of("qa_best_document").replace(BENCH_CTE, MIXED_CTE))
def qa_best_document_nomatch(spark, sf_dir):
    """Q5 in the flow: the fixed answer for queries that match nothing."""
    arts, idx = _store(spark, sf_dir)
    return _best_document_rows(qa.best_document_answers(_mixed_queries(spark, sf_dir), arts, idx))


@register("qa_answers_branches", _ORACLE_QA_ANSWERS.replace(BENCH_CTE, MIXED_CTE) + f"""
  and len({sql_tokens('(select query from q where q.query_id = f.query_id)')}) > 0
union all
select query_id, {sql_str(qa.ERROR_ANSWER)}, cast(0.0 as double), {sql_str(qa.NO_TERMS_ERROR)}, null, null, null, null, cast(0 as bigint), {sql_str(qa.NO_TERMS_ERROR)}
from q where len({sql_tokens('query')}) = 0""")
def qa_answers_branches(spark, sf_dir):
    """Q2, Q3 and Q8 in one flow: combined answers, fallbacks, error rows."""
    arts, idx = _corpus_index(spark, sf_dir)
    return qa.flatten_answers(qa.answer_questions(_mixed_queries(spark, sf_dir), arts, idx))
