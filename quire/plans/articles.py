"""Registered queries: article shaping, import, store maintenance, listing
(P1-P11, S2, S6, J1, J4, K3-K9, A1, A3, R1-R5, F1, L1-L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing, store
from ..operators.parse import error_rows, good_rows, parse_articles
from ..session import shared_path
from ..sources.archive import bare_to_articles, literal_path
from ..sources.tables import (archive_as_raw_files, derived_archive, import_scenario,
                              read_table)
from ..streaming.ingest import read_store, upsert_batch
from .catalog import ARCHIVE_SQL, register, sql_parse_ctes

RUN_1 = "2024-01-01 00:00:00"
RUN_2 = "2024-01-02 00:00:00"

ARCH = f"arch as ({ARCHIVE_SQL}), {sql_parse_ctes('arch', 'pa')}"

# text policy articles in SQL (services): header date, else file-name date
TEXT_ARTICLES = f"""{ARCH},
arts as (select doc_id, article_id, filename, title, author, coalesce(hdate, fdate) as publish_date_raw,
                try_strptime(coalesce(hdate, fdate), '%Y-%m-%d') as publish_date, body as content,
                pairs, header_text
         from pa)"""


def _archive_articles(spark, sf_dir, policy="text", run_ts=None):
    docs = read_table(spark, sf_dir, "documents")
    return parse_articles(archive_as_raw_files(derived_archive(docs)), policy, run_ts=run_ts)


def _text_articles(spark, sf_dir):
    return good_rows(_archive_articles(spark, sf_dir, "text"))


@register("archive_parse", f"""
with {TEXT_ARTICLES}
select filename, article_id, title, author, publish_date_raw,
       cast(publish_date as varchar) as publish_date, content, header_text
from arts""")
def archive_parse(spark, sf_dir):
    p = _archive_articles(spark, sf_dir, "text")
    return p.filter(F.col("error").isNull()).select(
        "filename", "article_id", "title", "author", "publish_date_raw",
        F.col("publish_date").cast("string").alias("publish_date"), "content", "header_text")


@register("archive_parse_importer", f"""
with {ARCH}
select filename, title, fdate as publish_date_raw,
       cast(try_strptime(fdate, '%Y-%m-%d') as varchar) as publish_date,
       case when fdate is not null and try_strptime(fdate, '%Y-%m-%d') is null
            then 'time data ''' || fdate || ''' does not match format ''%Y-%m-%d''' end as error
from pa""")
def archive_parse_importer(spark, sf_dir):
    p = _archive_articles(spark, sf_dir, "importer")
    return p.select("filename", "title", "publish_date_raw",
                    F.col("publish_date").cast("string").alias("publish_date"), "error")


BLANK_ARCHIVE = f"select doc_id, filename, case when doc_id % 6 = 0 then chr(10) || ' ' || chr(9) else raw end as raw from ({ARCHIVE_SQL})"


@register("archive_parse_blank_files", f"""
with arch as (select * from ({BLANK_ARCHIVE}) where regexp_matches(raw, '\\S')), {sql_parse_ctes('arch', 'pa')}
select filename, title, 'archive' as source, body as content from pa""")
def archive_parse_blank_files(spark, sf_dir):
    """An archive where every sixth file is blank."""
    blank = derived_archive(read_table(spark, sf_dir, "documents")).withColumn(
        "raw", F.when(F.col("doc_id") % 6 == 0, F.lit("\n \t")).otherwise(F.col("raw")))
    return good_rows(parse_articles(archive_as_raw_files(blank), "text")).select("filename", "title", "source", "content")


@register("bare_articles", """
select substr(sha256(coalesce(text, '')), 1, 24) as article_id, max(text) as content,
       cast(null as varchar) as title, cast(null as varchar) as author, cast(null as varchar) as publish_date_raw
from documents group by 1""")
def bare_articles(spark, sf_dir):
    """The texts alone as articles without metadata, equal ones once."""
    texts = read_table(spark, sf_dir, "documents").select(F.col("text").alias("content"))
    return bare_to_articles(texts).select("article_id", "content", "title", "author", "publish_date_raw")


@register("archive_count", f"""
with {TEXT_ARTICLES}
select cast(count(*) as bigint) as total from arts""")
def archive_count(spark, sf_dir):
    return _text_articles(spark, sf_dir).select(F.count(F.lit(1)).cast("long").alias("total"))


# ------------------------------------------------------------------ import

def _import(spark, sf_dir):
    from ..schemas import ARTICLES
    stored_raw, incoming_raw = import_scenario(read_table(spark, sf_dir, "documents"))
    empty = spark.createDataFrame([], ARTICLES)
    first = store.classify_import(empty, parse_articles(stored_raw, "importer", run_ts=RUN_1), RUN_1)
    stored = store.apply_import(empty, first)
    second = store.classify_import(stored, parse_articles(incoming_raw, "importer", run_ts=RUN_2), RUN_2)
    return stored, second


IMPORT_SQL = f"""
arch0 as ({ARCHIVE_SQL}),
st_src as (select doc_id, filename, raw from arch0 where doc_id % 3 <> 0),
in_src as (select doc_id, filename, case when doc_id % 5 = 0 then raw || ' [rev 2]' else raw end as raw from arch0),
{sql_parse_ctes('st_src', 'sp')},
{sql_parse_ctes('in_src', 'ip')},
stored as (select filename, article_id, title, body as content, fdate from sp
           where not (fdate is not null and try_strptime(fdate, '%Y-%m-%d') is null)),
incoming as (select filename, article_id, title, body as content, fdate,
                    fdate is not null and try_strptime(fdate, '%Y-%m-%d') is null as bad from ip),
actions as (select i.filename, i.article_id, i.title, i.content, s.article_id as s_id, s.content as s_content,
                   case when i.bad then 'error' when s.filename is null then 'insert'
                        when s.content is distinct from i.content then 'update' else 'skip' end as action
            from incoming i left join stored s on s.filename = i.filename)"""


@register("import_stats", f"""
with {IMPORT_SQL}
select cast(count(*) filter (where action = 'insert') as bigint) as processed,
       cast(count(*) filter (where action = 'skip') as bigint) as skipped,
       cast(count(*) filter (where action = 'update') as bigint) as updated,
       cast(count(*) filter (where action = 'error') as bigint) as errors
from actions""")
def import_stats_q(spark, sf_dir):
    return store.import_stats(_import(spark, sf_dir)[1])


@register("import_actions", f"""
with {IMPORT_SQL}
select filename, action from actions""")
def import_actions(spark, sf_dir):
    return _import(spark, sf_dir)[1].select("filename", "action")


@register("import_errors", f"""
with {IMPORT_SQL}
select filename, 'time data ''' || fdate || ''' does not match format ''%Y-%m-%d''' as error
from incoming where bad""")
def import_errors_q(spark, sf_dir):
    return error_rows(_import(spark, sf_dir)[1])


@register("import_snapshot", f"""
with {IMPORT_SQL},
snap as (
  select s.article_id, s.filename, s.title, s.content, '{RUN_1}' as created_at, '{RUN_1}' as last_updated
  from stored s where s.filename not in (select filename from actions where action in ('insert', 'update'))
  union all
  select coalesce(s_id, article_id), filename, title, content,
         case when action = 'insert' then '{RUN_2}' else '{RUN_1}' end, '{RUN_2}'
  from actions where action in ('insert', 'update'))
select * from snap""")
def import_snapshot(spark, sf_dir):
    stored, second = _import(spark, sf_dir)
    snap = store.apply_import(stored, second)
    return snap.select("article_id", "filename", "title", "content",
                       F.col("created_at").cast("string").alias("created_at"),
                       F.col("last_updated").cast("string").alias("last_updated"))


@register("key_violations", f"""
with arch0 as ({ARCHIVE_SQL}),
both_runs as (select filename from arch0 where doc_id % 3 <> 0 union all select filename from arch0)
select filename, cast(count(*) as bigint) as n from both_runs group by filename having count(*) > 1""")
def key_violations_q(spark, sf_dir):
    stored_raw, incoming_raw = import_scenario(read_table(spark, sf_dir, "documents"))
    return store.key_violations(stored_raw.select("filename").unionByName(incoming_raw.select("filename")))


@register("batch_report", f"""
with {TEXT_ARTICLES}
select filename, article_id,
       cast((row_number() over (order by filename) - 1) // 50 + 1 as bigint) as batch,
       cast(ceil(count(*) over () / 50) as bigint) as n_batches
from arts""")
def batch_report_q(spark, sf_dir):
    return store.batch_report(_text_articles(spark, sf_dir), 50)


# ------------------------------------------------------------------ listing

def _page_sql(order: str, page_no: int, limit: int, preview: str = "content") -> str:
    return f"""
with {TEXT_ARTICLES}
select article_id as id, coalesce(title, 'Untitled') as title, {preview} as content, publish_date_raw as publish_date,
       coalesce(author, 'Unknown') as author, (select cast(count(*) as bigint) from arts) as total,
       {page_no} as page, {limit} as "limit"
from arts order by {order} limit {limit} offset {(page_no - 1) * limit}"""


NEWEST = "arts.publish_date desc nulls last, arts.article_id"


def _page(spark, sf_dir, page_of, page_no, limit, preview):
    arts = _text_articles(spark, sf_dir)
    return listing.list_projection(page_of(arts, page_no, limit), preview, keep=("total", "page", "limit"))


@register("list_newest_page1", _page_sql(NEWEST, 1, 10))
def list_newest_page1(spark, sf_dir):
    return _page(spark, sf_dir, listing.page, 1, 10, None)


@register("list_newest_page3_limit50", _page_sql(NEWEST, 3, 50))
def list_newest_page3(spark, sf_dir):
    return _page(spark, sf_dir, listing.page, 3, 50, None)


def _ranked(spark, sf_dir):
    # several files, so that a page is a part of them
    return listing.write_ranked(_text_articles(spark, sf_dir), shared_path(spark, "ranked"), 12)


@register("list_newest_page_deep", _page_sql(NEWEST, 17, 50))
def list_newest_page_deep(spark, sf_dir):
    """L2 over the written layout: the files of page 17 alone are opened."""
    return listing.list_projection(listing.ranked_page(spark, _ranked(spark, sf_dir), 17, 50), None, keep=("total", "page", "limit"))


@register("list_store_order_page2", _page_sql("arts.article_id", 2, 10, "left(content, 2000)"))
def list_store_order_page2(spark, sf_dir):
    return _page(spark, sf_dir, listing.store_page, 2, 10, 2000)


@register("list_store_order_limit100", _page_sql("arts.article_id", 1, 100, "left(content, 2000)"))
def list_store_order_limit100(spark, sf_dir):
    return _page(spark, sf_dir, listing.store_page, 1, 100, 2000)


LOOKUP_IDS_SQL = """
ids as (select case when l.quality = 1 then a.article_id else 'missing-' || l.doc_id end as id
        from labels l join arts a on a.doc_id = l.doc_id)"""


def _lookup_ids(spark, sf_dir, arts_with_doc):
    labels = read_table(spark, sf_dir, "labels")
    return labels.join(arts_with_doc, "doc_id").select(
        F.when(F.col("quality") == 1, F.col("article_id"))
        .otherwise(F.concat(F.lit("missing-"), F.col("doc_id"))).alias("article_id"))


def _arts_with_doc(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    arch = derived_archive(docs)
    parsed = good_rows(parse_articles(archive_as_raw_files(arch), "text"))
    ids = arch.select("doc_id", store_id_col())
    return parsed, ids


def store_id_col():
    from ..operators.parse import article_id_for
    return article_id_for(F.col("filename")).alias("article_id")


@register("lookup_by_id", f"""
with {TEXT_ARTICLES}, {LOOKUP_IDS_SQL}
select ids.id, arts.article_id is not null as found, arts.title, arts.content,
       arts.publish_date_raw as publish_date, arts.author
from ids left join arts on arts.article_id = ids.id""")
def lookup_by_id(spark, sf_dir):
    parsed, ids = _arts_with_doc(spark, sf_dir)
    return listing.lookup(parsed, _lookup_ids(spark, sf_dir, ids))


@register("update_metadata", f"""
with {TEXT_ARTICLES}, {LOOKUP_IDS_SQL},
upd as (select ids.id, l.quality, l.toxic from labels l join arts a on a.doc_id = l.doc_id
        join ids on ids.id = case when l.quality = 1 then a.article_id else 'missing-' || l.doc_id end)
select upd.id as article_id, arts.article_id is not null as found,
       case when arts.article_id is null then null else array_to_string(list_transform(list_sort(
            list_filter(arts.pairs, lambda p: p.key not in ('quality', 'toxic'))
            || [{{'key': 'quality', 'value': cast(upd.quality as varchar)}},
                {{'key': 'toxic', 'value': cast(upd.toxic as varchar)}}]),
            lambda p: p.key || '=' || p.value), chr(10)) end as header_text
from upd left join arts on arts.article_id = upd.id""")
def update_metadata_q(spark, sf_dir):
    parsed, ids = _arts_with_doc(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels")
    upd = labels.join(ids, "doc_id").select(
        F.when(F.col("quality") == 1, F.col("article_id"))
        .otherwise(F.concat(F.lit("missing-"), F.col("doc_id"))).alias("article_id"),
        F.create_map(F.lit("quality"), F.col("quality").cast("string"),
                     F.lit("toxic"), F.col("toxic").cast("string")).alias("updates"))
    new, report = store.update_metadata(parsed, upd)
    header_text = F.array_join(F.transform(F.array_sort(F.map_entries("header")),
                                           lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    touched = new.join(upd.select("article_id"), "article_id", "left_semi") \
        .select("article_id", header_text.alias("header_text"))
    return report.join(touched, "article_id", "left").select("article_id", "found", "header_text")


@register("update_metadata_snapshot", f"""
with {TEXT_ARTICLES},
snap as (select arts.*, l.doc_id is not null as hit, l.quality, l.toxic
         from arts left join labels l on l.doc_id = arts.doc_id)
select article_id, filename, title, content, case when not hit then author end as author,
       case when not hit then publish_date_raw when toxic = 1 then 'unknown' else '2020-01-01' end as publish_date_raw,
       cast(case when not hit then publish_date when toxic = 1 then null else timestamp '2020-01-01' end as varchar) as publish_date,
       array_to_string(list_transform(list_sort(case when not hit then pairs else
            list_filter(pairs, lambda p: p.key not in ('author', 'publishDate', 'quality'))
            || [{{'key': 'author', 'value': '(null)'}},
                {{'key': 'publishDate', 'value': case when toxic = 1 then 'unknown' else '2020-01-01' end}},
                {{'key': 'quality', 'value': 'q' || quality}}] end),
            lambda p: p.key || '=' || p.value), chr(10)) as header_text
from snap""")
def update_metadata_snapshot(spark, sf_dir):
    """The whole snapshot after two updates of every labelled article."""
    parsed, updates = two_updates(spark, sf_dir)
    return with_header_text(store.update_metadata(parsed, updates, order_col="nth")[0])


def two_updates(spark, sf_dir):
    """The archive's articles, and two updates of each labelled one: the first
    clears the author, the second sets the date and corrects the first."""
    parsed, ids = _arts_with_doc(spark, sf_dir)
    labelled = read_table(spark, sf_dir, "labels").join(ids, "doc_id")
    no = F.lit(None).cast("string")
    first = F.create_map(F.lit("quality"), F.lit("zz"), F.lit("author"), no)
    second = F.create_map(F.lit("quality"), F.concat(F.lit("q"), "quality"),
                          F.lit("publishDate"), F.when(F.col("toxic") == 1, "unknown").otherwise("2020-01-01"))
    updates = labelled.select("article_id", F.inline(F.array(F.struct(F.lit(1).alias("nth"), first.alias("updates")),
                                                             F.struct(F.lit(2).alias("nth"), second.alias("updates")))))
    return parsed, updates


def with_header_text(articles):
    header_text = F.array_join(F.transform(F.array_sort(F.map_entries("header")), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("(null)")))), "\n")
    return articles.select("article_id", "filename", "title", "content", "author", "publish_date_raw",
                           F.col("publish_date").cast("string").alias("publish_date"), header_text.alias("header_text"))


@register("stream_import_snapshot", f"""
with {IMPORT_SQL}
select s.article_id, s.filename, s.title, s.content from stored s
where s.filename not in (select filename from actions where action in ('insert', 'update'))
union all
select coalesce(s_id, article_id), filename, title, content from actions where action in ('insert', 'update')""")
def stream_import_snapshot(spark, sf_dir):
    """ST1: two streams with checkpoints of their own feed one store in the
    shared folder, first the stored files of the import scenario, then the
    incoming ones; the newest snapshot holds what the batch import gives."""
    base = shared_path(spark, "stream-store")
    schema = read_table(spark, sf_dir, "documents").schema
    for nth, name in enumerate(("stored", "incoming")):
        # a file stream takes a folder or a pattern, and the table may be one file
        rows = spark.readStream.schema(schema).parquet(f"{literal_path(sf_dir)}/documents.parquet*")
        upsert = upsert_batch(base, query_key=name)
        query = (import_scenario(rows)[nth].writeStream.foreachBatch(upsert)
                 .option("checkpointLocation", shared_path(spark, f"stream-{name}")).trigger(availableNow=True).start())
        query.awaitTermination()
    return read_store(spark, base).select("article_id", "filename", "title", "content")


@register("delete_toxic", f"""
with {TEXT_ARTICLES}
select article_id, filename from arts
where doc_id not in (select doc_id from labels where toxic = 1)""")
def delete_toxic(spark, sf_dir):
    parsed, deletes = toxic_articles(spark, sf_dir)
    return store.delete_articles(parsed, deletes).select("article_id", "filename")


def toxic_articles(spark, sf_dir):
    """The archive's articles, and the ids of the toxic ones."""
    parsed, ids = _arts_with_doc(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels")
    return parsed, labels.filter(F.col("toxic") == 1).join(ids, "doc_id").select("article_id")


@register("list_newest_keyset_page2", _page_sql(NEWEST, 2, 10).replace(
    ", (select cast(count(*) as bigint) from arts) as total,\n       2 as page, 10 as \"limit\"", ""))
def list_newest_keyset_page2(spark, sf_dir):
    """K11 / L1 scalable form: page 2 read after the cursor of page 1's last
    row (one bounded row to the driver), equal to the offset page."""
    arts = _text_articles(spark, sf_dir)
    last = listing.keyset_page(arts, None, 10).select("publish_date", "article_id").tail(1)
    cursor = (last[0]["publish_date"], last[0]["article_id"]) if last else None
    return listing.list_projection(listing.keyset_page(arts, cursor, 10), None)
