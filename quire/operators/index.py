"""Inverted text index as ordinary tables.

Layout
------
``doc_terms``  one row per article: ``article_id, dl, terms array<struct<term, tf>>``.
               Built inside each document's row (sort + run lengths), so the
               index build needs **no shuffle** to count term frequencies, and
               all postings of an article stay in one task.
``postings``   ``doc_terms`` exploded: ``term, article_id, tf, dl``.
``term_stats`` ``term, df``: one partial-aggregated shuffle over terms; a hot
               term is combined map-side, so it cannot overload one task.
``doc_stats``  ``article_id, len``.
``corpus``     one row ``n_docs, avgdl`` over articles with at least one token.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import run_lengths, run_starts, tokens_or_empty
from ..session import cut_lineage


@dataclass
class TextIndex:
    doc_terms: DataFrame
    term_stats_table: DataFrame | None = None
    fields: tuple[str, ...] = ("content",)
    corpus_table: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        # inline_outer: a plain inline makes Catalyst infer ``size(terms) > 0``
        # and push it below the projections, re-running the tokenizer.
        return (self.doc_terms.select("article_id", "dl", F.inline_outer("terms"))
                .filter(F.col("term").isNotNull())
                .select("term", "article_id", "tf", "dl"))

    @property
    def doc_stats(self) -> DataFrame:
        return self.doc_terms.select("article_id", F.col("dl").alias("len"))

    @property
    def term_stats(self) -> DataFrame:
        if self.term_stats_table is not None:
            return self.term_stats_table
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    @property
    def corpus(self) -> DataFrame:
        if self.corpus_table is not None:
            return self.corpus_table
        nonempty = F.col("dl") > 0
        return self.doc_terms.agg(
            F.count_if(nonempty).cast("long").alias("n_docs"),
            F.avg(F.when(nonempty, F.col("dl"))).alias("avgdl"))

    def n_docs(self):
        """Scalar subquery column: documents with at least one token."""
        return self.corpus.select("n_docs").scalar()

    def avgdl(self):
        return self.corpus.select("avgdl").scalar()


def build_index(articles: DataFrame, fields: tuple[str, ...] = ("content",),
                materialize: bool = False, partitions: int | None = None) -> TextIndex:
    """Build the index over ``fields`` of ``articles``; equal field weights.

    With ``materialize`` the per-document term vectors are hash-partitioned by
    ``article_id`` and checkpointed once into the shared checkpoint folder.
    Every later use reads them instead of re-tokenising, and the checkpoint
    keeps the partitioning: the per-(query, article) score sum of a query batch
    then needs **no shuffle** (all postings of an article sit in one task), and
    only each partition's top-k per query crosses the network.
    """
    n = partitions or int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = articles.select("article_id", *fields)
    if materialize:
        # the one shuffle of the build moves (id, text) rows, so the
        # CPU-heavy tokenising below runs in every task and its output is
        # already partitioned by article_id
        src = src.repartition(n, "article_id")
    toks = None
    for f in fields:
        t = tokens_or_empty(F.col(f))
        toks = t if toks is None else F.concat(toks, t)
    # Three projections, each input referenced several times by the next one,
    # so Catalyst keeps them apart and the sort runs once per document (a
    # lambda that referenced the sort expression would re-run it per element).
    sorted_toks = src.select("article_id", F.sort_array(toks).alias("_s"))
    with_starts = sorted_toks.select(
        "article_id", "_s", F.size("_s").cast("long").alias("dl"),
        run_starts(F.col("_s"), F.size("_s")).alias("_st"))
    doc_terms = with_starts.select(
        "article_id", "dl", run_lengths(F.col("_s"), F.col("_st"), F.col("dl")).alias("terms"))
    index = TextIndex(doc_terms=doc_terms, fields=tuple(fields))
    if materialize:
        index = TextIndex(doc_terms=cut_lineage(doc_terms, keep_partitioning=True), fields=tuple(fields))
        index.term_stats_table = cut_lineage(index.term_stats)
        # one row, so that a query batch doesn't scan the index for it
        index.corpus_table = cut_lineage(index.corpus)
    return index


DOC_TERMS_DDL = "article_id STRING, dl BIGINT, terms ARRAY<STRUCT<term: STRING, tf: BIGINT>>"


def _table_name(path: str) -> str:
    import hashlib
    return "quire_doc_terms_" + hashlib.sha1(path.encode()).hexdigest()[:16]


def save_index(index: TextIndex, path: str, buckets: int | None = None) -> str:
    """Write the index as parquet tables in a new folder under ``path`` (a shared folder) and name that folder in
    ``path/_CURRENT`` once all is written, so that an index may be saved over the one that it was loaded from.

    ``doc_terms`` is written as a table **bucketed by article_id** (one file
    per bucket), so a later session that loads it keeps the co-partitioning
    and scores without shuffling candidate pairs. ``term_stats`` is
    range-partitioned and sorted by term, so a lookup of a few terms skips
    files and row groups by their min/max statistics.
    """
    spark = index.doc_terms.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = f"v-{uuid.uuid4().hex[:16]}"
    at = os.path.join(path, version)
    dt_path = os.path.join(at, "doc_terms")
    name = _table_name(dt_path)
    (index.doc_terms.repartition(n, "article_id").write.mode("errorifexists")
     .bucketBy(n, "article_id").option("path", dt_path).format("parquet").saveAsTable(name))
    (index.term_stats.repartitionByRange("term").sortWithinPartitions("term")
     .write.mode("errorifexists").parquet(os.path.join(at, "term_stats")))
    index.corpus.write.mode("errorifexists").parquet(os.path.join(at, "corpus"))
    with open_text(spark, os.path.join(at, "_BUCKETS")) as f:
        f.write(str(n))
    with open_text(spark, os.path.join(path, "_CURRENT")) as f:
        f.write(version)
    return path


def open_text(spark: SparkSession, path: str):
    """A small text file written through the Hadoop FileSystem API."""
    import io
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    class _W(io.StringIO):
        def close(self):
            out = fs.create(p, True)
            out.write(bytearray(self.getvalue().encode()))
            out.close()
            super().close()
    return _W()


def _read_text(spark: SparkSession, path: str) -> str | None:
    """First line of a small text file, through the Hadoop FileSystem API."""
    if not _exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_index(spark: SparkSession, path: str, fields: tuple[str, ...] = ("content",)) -> TextIndex:
    """Attach a saved index; ``doc_terms`` is read as a bucketed table."""
    if current := _read_text(spark, os.path.join(path, "_CURRENT")):
        path = os.path.join(path, current)
    dt_path = os.path.join(path, "doc_terms")
    n = _read_text(spark, os.path.join(path, "_BUCKETS"))
    if n:
        # keep the bucketed scan: the automatic rule cannot see that the
        # per-(query, article) aggregation above Generate + broadcast join
        # relies on the bucketing, and would drop it
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        name = _table_name(dt_path)
        location = dt_path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({DOC_TERMS_DDL}) USING parquet "
                  f"CLUSTERED BY (article_id) INTO {int(n)} BUCKETS LOCATION '{location}'")
        doc_terms = spark.table(name)
    else:
        doc_terms = spark.read.parquet(dt_path)
    return TextIndex(doc_terms=doc_terms,
                     term_stats_table=spark.read.parquet(os.path.join(path, "term_stats")),
                     fields=fields, corpus_table=spark.read.parquet(os.path.join(path, "corpus")))
