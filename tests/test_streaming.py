"""ST1: the file-stream ingest equals the batch import on the same files."""

import os

from pyspark.sql import functions as F

from quire.operators import store
from quire.operators.parse import parse_articles
from quire.sources.archive import scan_archive
from quire.sources.tables import derived_archive, read_table
from quire.streaming.ingest import read_store, start_ingest

from conftest import SF_SMALL


def write_files(rows, folder):
    os.makedirs(folder, exist_ok=True)
    for r in rows:
        with open(os.path.join(folder, r["filename"]), "w", encoding="utf-8") as f:
            f.write(r["raw"])


def test_stream_equals_batch(spark, scratch):
    arch = derived_archive(read_table(spark, SF_SMALL, "documents")).collect()
    folder = os.path.join(scratch, "archive")
    write_files(arch[:120], folder)
    base, ckpt = os.path.join(scratch, "store"), os.path.join(scratch, "ckpt")
    start_ingest(spark, folder, base, ckpt).awaitTermination()
    write_files(arch[120:], folder)            # new files arrive
    start_ingest(spark, folder, base, ckpt).awaitTermination()
    start_ingest(spark, folder, base, ckpt).awaitTermination()   # nothing new: harmless
    streamed = read_store(spark, base)

    raw, problem = scan_archive(spark, folder)
    assert problem is None
    p, _ = store.import_articles(spark, None, parse_articles(raw, "importer", run_ts="2024-01-01 00:00:00"),
                                 os.path.join(scratch, "batch"), "2024-01-01 00:00:00")
    batch = spark.read.parquet(p)
    cols = ["article_id", "filename", "title", "author", "content"]
    s = sorted(map(tuple, streamed.select(*cols).collect()))
    b = sorted(map(tuple, batch.select(*cols).collect()))
    assert s == b and len(s) > 150
    assert streamed.groupBy("filename").count().filter(F.col("count") > 1).count() == 0


def test_fresh_checkpoint_and_batch_import_keep_the_store(spark, scratch):
    arch = derived_archive(read_table(spark, SF_SMALL, "documents")).collect()
    folder, base = os.path.join(scratch, "archive"), os.path.join(scratch, "store")
    write_files(arch[:40], folder)
    start_ingest(spark, folder, base, os.path.join(scratch, "first")).awaitTermination()
    before = {r["filename"] for r in read_store(spark, base).select("filename").collect()}
    edited = read_store(spark, base).withColumn("title", F.lit("edited by a batch"))
    edited.write.parquet(store.snapshot_path(base, 2))
    write_files(arch[40:80], folder)
    start_ingest(spark, folder, base, os.path.join(scratch, "second")).awaitTermination()
    after = read_store(spark, base)
    assert before < {r["filename"] for r in after.select("filename").collect()}
    assert spark.read.parquet(store.snapshot_path(base, 2)).where("title = 'edited by a batch'").count() == len(before)
    assert after.where("title = 'edited by a batch'").count() == len(before)
