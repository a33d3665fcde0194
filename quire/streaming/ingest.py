"""Incremental archive ingest as a Structured Streaming job (ST1).

``readStream.format("binaryFile")`` delivers each new ``.txt`` file of the
archive folder once (the file-source log in the checkpoint remembers paths);
``foreachBatch`` parses the micro-batch and upserts it into the article store
with the same batch operators as the importer (K5). Every micro-batch writes the
next snapshot version after those in the store; the version of each epoch is
recorded, so an epoch that runs again finds its own, and no snapshot is ever
overwritten.

A file *edited in place* is not delivered again by a file stream that has
already seen its path; the batch importer remains the way to pick up edits.
"""

from __future__ import annotations

import hashlib
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import article_log, store
from ..operators.parse import parse_articles
from ..schemas import ARTICLES
from ..sources.archive import ARCHIVE_GLOB, literal_path


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Snapshot versions present under ``base`` (a short directory listing)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v") and name[1:].isdigit():
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[1:]))
    return sorted(out)


def latest_snapshot(spark: SparkSession, base: str, before: int | None = None) -> str | None:
    vs = [v for v in _versions(spark, base) if before is None or v < before]
    return store.snapshot_path(base, vs[-1]) if vs else None


def read_store(spark: SparkSession, base: str) -> DataFrame:
    path = latest_snapshot(spark, base)
    return spark.read.parquet(path) if path else spark.createDataFrame([], ARTICLES)


# The fixed schema of Spark's binaryFile source.
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def archive_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("pathGlobFilter", ARCHIVE_GLOB)
              .option("recursiveFileLookup", "false"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(literal_path(folder))
    return df.select("path", F.substring_index("path", "/", -1).alias("filename"), "content")


def _epoch_versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The store versions reserved by a query's epochs; the last reservation of an epoch counts."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.schema("epoch long, version long").parquet(path).groupBy("epoch").agg(F.max("version").alias("version"))
    return {r["epoch"]: r["version"] for r in rows.collect()}


def upsert_batch(store_base: str, compare: str = "content", stats_base: str | None = None, query_key: str = "ingest"):
    """The ``foreachBatch`` body: parse, classify against the newest snapshot and write the next version.

    The version follows from the store, not from the epoch, so a fresh
    checkpoint or a batch import between epochs never meets an existing one.
    Each epoch's version is recorded first under ``query_key``: an epoch that is
    run again and whose snapshot is whole does nothing, else it takes the next
    free version. A snapshot is never overwritten."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        n_files = batch.select("path").count()   # file listing rows: no parse needed
        if n_files == 0:
            return
        reserved = os.path.join(store_base, "_ingest", query_key)
        mine = _epoch_versions(spark, reserved)
        present = _versions(spark, store_base)
        if mine.get(epoch_id) in present:
            return
        run_ts = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        target = max([*present, *mine.values(), 0]) + 1
        spark.createDataFrame([(epoch_id, target)], "epoch long, version long").coalesce(1).write.mode("append").parquet(reserved)
        prev = latest_snapshot(spark, store_base, before=target)
        stored = spark.read.parquet(prev) if prev else spark.createDataFrame([], ARTICLES)
        incoming = store.one_per_name(parse_articles(batch, "importer", run_ts=run_ts))
        classified = store.classify_import(stored, incoming, run_ts, compare, incoming_bound=n_files)
        if stats_base:
            (store.import_stats(classified).withColumn("epoch", F.lit(epoch_id).cast("long"))
             .write.mode("overwrite").parquet(os.path.join(stats_base, f"epoch={epoch_id}")))
        snap = store.apply_import(stored, classified, changed_bound=n_files)
        snap.write.mode("errorifexists").parquet(store.snapshot_path(store_base, target))

    return run


def upsert_into_log(base: str, compare: str = "content", query_key: str = "ingest"):
    """The ``foreachBatch`` body for a store kept as an ``article_log``: several streams and batch imports may feed one
    store at a time. The epoch is committed with its rows, so an epoch that runs again changes nothing."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        run_ts = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        article_log.import_into(batch.sparkSession, base, parse_articles(batch, "importer", run_ts=run_ts), run_ts, compare, (query_key, epoch_id))

    return run


def start_ingest(spark: SparkSession, folder: str, store_base: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 compare: str = "content", stats_base: str | None = None,
                 processing_time: str | None = None, into_log: bool = False) -> StreamingQuery:
    """Start ST1. ``available_now`` processes everything present and stops;
    otherwise the query keeps polling every ``processing_time``. ``into_log``:
    the store is an ``article_log``, which several writers may feed; snapshot
    stores have one writer at a time."""
    key = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    upsert = upsert_into_log(store_base, compare, key) if into_log else upsert_batch(store_base, compare, stats_base, key)
    w = (archive_stream(spark, folder, max_files_per_trigger).writeStream
         .foreachBatch(upsert)
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
