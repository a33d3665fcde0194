"""Driver tables mapped onto the engine's data model.

``documents`` is the article corpus (``doc_id`` → ``article_id``, ``text`` →
``content``), ``benchmark`` and the user turns of ``conversations`` are query
tables, and a raw archive of header-block files is derived from ``documents``
by a fixed formula so that the parser and the upsert run on real volumes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ARTICLES


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def conform_articles(df: DataFrame) -> DataFrame:
    """Select the article columns in schema order, adding missing ones as nulls."""
    cols = []
    for field in ARTICLES.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Corpus without metadata: only id, body and provenance are known."""
    return conform_articles(documents.select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.col("text").alias("content"),
        F.col("source"),
    ))


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(read_table(spark, sf_dir, "documents"))


def queries_from_benchmark(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("query_id"),
                            F.col("text").alias("query"))


def queries_from_conversations(conversations: DataFrame) -> DataFrame:
    """User turns as questions; the id holds the conversation in its upper and
    the turn in its lower 32 bits, so no two turns share one (a conversation id
    beyond 31 bits is an overflow error, not a collision)."""
    return conversations.filter(F.col("role") == "user").select(
        (F.col("conv_id").cast("long") * F.lit(2 ** 32) + F.col("turn")).alias("query_id"),
        F.col("text").alias("query"))


def load_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_from_benchmark(read_table(spark, sf_dir, "benchmark"))


# Fixed values of the derived archive formula (FIXTURES.md §3).
ARCHIVE_EPOCH = "2004-01-01"
ARCHIVE_DAYS = 5000


def derived_archive(documents: DataFrame) -> DataFrame:
    """Raw archive files ``(doc_id, filename, raw)`` derived from ``documents``.

    Exercises every header and file-name case: missing title / author / date,
    a body-less file (no ``---``), dates in the last name part and invalid
    dates.
    """
    d = F.col("doc_id")
    nl = F.lit("\n")
    date_str = F.date_format(F.date_add(F.lit(ARCHIVE_EPOCH).cast("date"),
                                        (d % ARCHIVE_DAYS).cast("int")), "yyyyMMdd")
    filename = (F.when(d % 10 == 0, F.concat(F.col("source"), F.lit("_"), d, F.lit(".txt")))
                .when(d % 10 == 1, F.concat(d, F.lit("_"), date_str, F.lit(".txt")))
                .when(d % 17 == 0, F.concat(F.col("source"), F.lit("_20061399_"), d, F.lit(".txt")))
                .otherwise(F.concat(F.col("source"), F.lit("_"), date_str, F.lit("_"), d, F.lit(".txt"))))
    raw = F.concat(
        F.when(d % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Title: Article "), d, F.lit(": part"), nl)),
        F.when(d % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("Author:  Writer "), d % 23, F.lit(" "), nl)),
        F.when(d % 5 == 0, F.concat(F.lit("Date: 2010-01-01"), nl)).otherwise(F.lit("")),
        F.when(d % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("---"), nl)),
        F.coalesce(F.col("text"), F.lit("")),
    )
    return documents.select(d.alias("doc_id"), filename.alias("filename"), raw.alias("raw"))


def archive_as_raw_files(archive: DataFrame) -> DataFrame:
    """The derived archive in the ``raw_files`` shape a folder scan produces."""
    return archive.select(F.concat(F.lit("archive/"), "filename").alias("path"),
                          "filename", F.encode("raw", "UTF-8").alias("content"))


def import_scenario(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, incoming) raw files for the upsert scenario of FIXTURES.md §4.

    Stored: ids not divisible by 3. Incoming: all ids, with `` [rev 2]``
    appended to every file whose id is divisible by 5.
    """
    arch = derived_archive(documents)
    stored = archive_as_raw_files(arch.filter(F.col("doc_id") % 3 != 0))
    incoming = archive_as_raw_files(arch.withColumn(
        "raw", F.when(F.col("doc_id") % 5 == 0, F.concat("raw", F.lit(" [rev 2]"))).otherwise(F.col("raw"))))
    return stored, incoming
