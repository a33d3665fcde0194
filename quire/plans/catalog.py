"""Registry of named queries: a Spark builder and, where SQL can say it, the
equivalent DuckDB statement over the driver's tables (the correctness oracle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql.strip()
        return fn
    return deco


def oracle_of(name: str) -> str:
    """The statement of a query registered earlier, for another way to the same rows."""
    return _ORACLE[name]


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def _load() -> None:
    # importing the plan modules fills the registry
    from . import answers, articles, retrieval, stored  # noqa: F401


# ------------------------------------------------------------ shared SQL text
# DuckDB fragments mirroring the engine's fixed definitions.

TOKEN_RX = r"([\p{L}\p{N}_]+)"
PY_WS = (r"[\t\n\x0B\x0C\r\x1C\x1D\x1E\x1F \x{85}\x{A0}\x{1680}"
         r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '{TOKEN_RX}', 1)"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def sql_split_ws(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{PY_WS}+'), lambda x: x <> '')"


def sql_snippet(content: str, query: str) -> str:
    c = f"lower(coalesce({content}, ''))"
    terms = sql_split_ws(f"lower(coalesce({query}, ''))")
    p = f"list_min(list_filter(list_transform({terms}, lambda t: instr({c}, t) - 1), lambda x: x >= 0))"
    return (f"'...' || (case when {p} is null then substring({c}, 1, 400) "
            f"else substring({c}, greatest(0, {p} - 100) + 1, "
            f"least(length({c}), {p} + 300) - greatest(0, {p} - 100)) end) || '...'")


def sql_index_ctes(docs: str = "docs", fields: tuple[str, ...] = ("content",)) -> str:
    """CTEs ``toks, postings, doc_stats, corpus, term_stats`` over ``docs``."""
    tok_list = " || ".join(sql_tokens(f) for f in fields)
    return f"""
doc_stats as (select article_id, cast(len({tok_list}) as bigint) as dl from {docs}),
toks as (select article_id, unnest({tok_list}) as term from {docs}),
postings as (select term, article_id, count(*) as tf from toks group by term, article_id),
corpus as (select count(*) as n_docs, avg(dl) as avgdl from doc_stats where dl > 0),
term_stats as (select term, count(*) as df from postings group by term)"""


def sql_bm25_ctes(queries: str = "q", prefix: str = "") -> str:
    """CTEs ``{prefix}qt, {prefix}qw, {prefix}scores`` (needs the index CTEs)."""
    return f"""
{prefix}qt as (select distinct query_id, term from (select query_id, unnest({sql_tokens('query')}) as term from {queries})),
{prefix}qw as (select qt.query_id, qt.term, ln(1 + (c.n_docs - ts.df + 0.5) / (ts.df + 0.5)) as idf
       from {prefix}qt qt join term_stats ts on qt.term = ts.term cross join corpus c),
{prefix}scores as (select qw.query_id, p.article_id,
       round(sum(qw.idf * p.tf * (1.2 + 1) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * d.dl / c.avgdl))), 6) as score
  from {prefix}qw qw join postings p on qw.term = p.term join doc_stats d on d.article_id = p.article_id
  cross join corpus c group by qw.query_id, p.article_id)"""


DOCS_CTE = "docs as (select cast(doc_id as varchar) as article_id, text as content, source from documents)"
BENCH_CTE = "q as (select item_id as query_id, text as query from benchmark)"


# DuckDB rendition of the derived archive of FIXTURES.md §3.
_NL = "chr(10)"
_DATE_STR = "strftime(date '2004-01-01' + cast(doc_id % 5000 as integer), '%Y%m%d')"
ARCHIVE_SQL = f"""
select doc_id,
  case when doc_id % 10 = 0 then concat(source, '_', doc_id, '.txt')
       when doc_id % 10 = 1 then concat(doc_id, '_', {_DATE_STR}, '.txt')
       when doc_id % 17 = 0 then concat(source, '_20061399_', doc_id, '.txt')
       else concat(source, '_', {_DATE_STR}, '_', doc_id, '.txt') end as filename,
  concat(case when doc_id % 7 = 0 then '' else concat('Title: Article ', doc_id, ': part', {_NL}) end,
         case when doc_id % 11 = 0 then '' else concat('Author:  Writer ', doc_id % 23, ' ', {_NL}) end,
         case when doc_id % 5 = 0 then concat('Date: 2010-01-01', {_NL}) else '' end,
         case when doc_id % 13 = 0 then '' else concat('---', {_NL}) end,
         coalesce(text, '')) as raw
from documents"""


def sql_parse_ctes(src: str, out: str) -> str:
    """CTEs parsing ``src (doc_id, filename, raw)`` into ``{out}`` with
    ``doc_id, filename, article_id, pairs, header_text, body, title, author,
    fdate, hdate``."""
    strip = sql_strip
    return f"""
{out}_1 as (select doc_id, filename, string_split(raw, chr(10)) as lines from {src}),
{out}_2 as (select *, coalesce(list_position(list_transform(lines, lambda l: {strip('l')} = '---'), true), 0) as first
            from {out}_1),
{out}_3 as (select doc_id, filename,
       case when first = 0 then lines else lines[1:first - 1] end as hl,
       case when first = 0 then '' else array_to_string(
            list_filter(lines[first + 1:], lambda l: {strip('l')} <> '---'), chr(10)) end as body
       from {out}_2),
{out}_4 as (select doc_id, filename, body,
       list_transform(list_filter(hl, lambda l: instr(l, ':') > 0),
                      lambda l: {{'key': lower({strip("split_part(l, ':', 1)")}),
                                  'value': {strip("substr(l, instr(l, ':') + 1)")}}}) as pairs0
       from {out}_3),
{out}_5 as (select doc_id, filename, body,
       list_sort(list_filter(pairs0, lambda p, i: not list_contains(list_transform(pairs0[i + 1:], lambda q: q.key), p.key))) as pairs
       from {out}_4),
{out} as (select doc_id, filename, left(sha256(filename), 24) as article_id, pairs, body,
       array_to_string(list_transform(pairs, lambda p: p.key || '=' || p.value), chr(10)) as header_text,
       coalesce(list_filter(pairs, lambda p: p.key = 'title')[1].value,
                regexp_replace(filename, '^(.*[^.].*)\\.[^.]*$', '\\1')) as title,
       coalesce(list_filter(pairs, lambda p: p.key = 'author')[1].value, 'Unknown') as author,
       list_filter(pairs, lambda p: p.key = 'date')[1].value as hdate,
       (select case when x is null then null else substr(x, 1, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2) end
          from (select list_filter(string_split(filename, '_'), lambda p: regexp_full_match(p, '[0-9]{{8}}'))[1] as x)) as fdate
       from {out}_5)"""
