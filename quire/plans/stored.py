"""Registered queries: the store that grows by what an import changes (K5, K8,
K9, ST1), to the same rows as the snapshot stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import article_log
from ..operators.parse import parse_articles
from ..session import shared_path
from ..sources.archive import literal_path
from ..sources.tables import import_scenario, read_table
from ..streaming.ingest import upsert_into_log
from .articles import RUN_1, RUN_2, toxic_articles, two_updates, with_header_text
from .catalog import oracle_of, register


def _imported_twice(spark, sf_dir):
    base = shared_path(spark, "article-log")
    for raw, run_ts in zip(import_scenario(read_table(spark, sf_dir, "documents")), (RUN_1, RUN_2)):
        log, rows = article_log.import_into(spark, base, parse_articles(raw, "importer", run_ts=run_ts), run_ts)
    return log, rows


@register("log_import_snapshot", oracle_of("import_snapshot"))
def log_import_snapshot(spark, sf_dir):
    return _imported_twice(spark, sf_dir)[0].articles.select(
        "article_id", "filename", "title", "content", F.col("created_at").cast("string").alias("created_at"),
        F.col("last_updated").cast("string").alias("last_updated"))


@register("log_compacted_snapshot", oracle_of("import_snapshot"))
def log_compacted_snapshot(spark, sf_dir):
    log = article_log.compact(spark, _imported_twice(spark, sf_dir)[0].base)
    return log.articles.select("article_id", "filename", "title", "content", F.col("created_at").cast("string").alias("created_at"),
                               F.col("last_updated").cast("string").alias("last_updated"))


def _stored(spark, articles):
    base = shared_path(spark, "article-log")
    article_log.import_into(spark, base, articles.withColumn("error", F.lit(None).cast("string")), RUN_1)
    return base


@register("log_update_snapshot", oracle_of("update_metadata_snapshot"))
def log_update_snapshot(spark, sf_dir):
    articles, updates = two_updates(spark, sf_dir)
    log, _ = article_log.update(spark, _stored(spark, articles), updates, order_col="nth")
    return with_header_text(log.articles)


@register("log_delete_toxic", oracle_of("delete_toxic"))
def log_delete_toxic(spark, sf_dir):
    articles, ids = toxic_articles(spark, sf_dir)
    return article_log.delete(spark, _stored(spark, articles), ids).articles.select("article_id", "filename")


@register("stream_import_log", oracle_of("stream_import_snapshot"))
def stream_import_log(spark, sf_dir):
    """ST1: two streams with checkpoints of their own feed one store."""
    base = shared_path(spark, "article-log")
    schema = read_table(spark, sf_dir, "documents").schema
    for nth, name in enumerate(("stored", "incoming")):
        # a file stream takes a folder or a pattern, and the table may be one file
        rows = spark.readStream.schema(schema).parquet(f"{literal_path(sf_dir)}/documents.parquet*")
        query = (import_scenario(rows)[nth].writeStream.foreachBatch(upsert_into_log(base, query_key=name))
                 .option("checkpointLocation", shared_path(spark, f"log-{name}")).trigger(availableNow=True).start())
        query.awaitTermination()
    return article_log.open_log(spark, base).articles.select("article_id", "filename", "title", "content")
