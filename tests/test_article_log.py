"""The store that grows by what changes: upserts, files kept, several writers, epochs."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import article_log, store, versions
from quire.operators.parse import parse_articles
from quire.sources.tables import derived_archive, import_scenario, read_table
from quire.streaming.ingest import start_ingest, upsert_into_log

from conftest import SF_SMALL

T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
COLUMNS = ["article_id", "filename", "title", "author", "content", "publish_date", "created_at", "last_updated"]


def rows(df, columns=COLUMNS):
    return sorted(map(str, df.select(columns).collect()))


def raw(spark, files):
    return spark.createDataFrame([(f"/x/{n}", n, bytearray(t.encode())) for n, t in files.items()], "path string, filename string, content binary")


def put(spark, base, files, ts=T1, **kw):
    return article_log.import_into(spark, base, parse_articles(raw(spark, files), "importer", run_ts=ts), ts, **kw)


def contents(spark, base):
    return {r["filename"]: r["content"] for r in article_log.open_log(spark, base).articles.collect()}


def text(body):
    return f"Title: t\n---\n{body}"


def test_log_equals_the_snapshot_import(spark, scratch):
    stored_raw, incoming_raw = import_scenario(read_table(spark, SF_SMALL, "documents"))
    first, second = parse_articles(stored_raw, "importer", run_ts=T1), parse_articles(incoming_raw, "importer", run_ts=T2)
    store.import_articles(spark, None, first, scratch + "/one", T1)
    _, stats = store.import_articles(spark, scratch + "/one", second, scratch + "/two", T2)
    base = scratch + "/log"
    article_log.import_into(spark, base, first, T1)
    log, classified = article_log.import_into(spark, base, second, T2)
    assert rows(log.articles) == rows(spark.read.parquet(scratch + "/two"))
    assert store.import_stats(classified).first() == stats.first()
    again, classified = article_log.import_into(spark, base, second, T2)
    assert again.version == log.version, "nothing to change, no version"
    assert {r["action"] for r in classified.select("action").distinct().collect()} == {"skip", "error"}
    assert rows(article_log.compact(spark, base).articles) == rows(log.articles)


def test_files_of_earlier_versions_are_kept_and_not_rewritten(spark, scratch):
    base = scratch + "/log"
    first, _ = put(spark, base, {f"a_{k}.txt": text(f"body {k}") for k in range(30)})
    held = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{base}/rows/*/*.parquet")}
    second, _ = put(spark, base, {"a_3.txt": text("new body"), "b.txt": text("b")}, T2)
    assert set(first.files()) < set(second.files())
    assert {f: os.stat(f).st_mtime_ns for f in held} == held
    assert sum(e["rows"] for e in second.manifest["segments"]) == 30 + 2 and [e["rows"] for e in second.manifest["tombstones"]] == [1]
    assert article_log.open_log(spark, base, first.version).articles.where("content = 'body 3'").count() == 1
    changed = second.articles.where("filename = 'a_3.txt'").first()
    assert str(changed["created_at"]) == T1 and str(changed["last_updated"]) == T2 and changed["content"] == "new body"


def test_an_import_reads_no_stored_text(spark, scratch):
    log, _ = put(spark, scratch + "/log", {"a.txt": text("a")})
    incoming = store.one_per_name(parse_articles(raw(spark, {"a.txt": text("b")}), "importer", run_ts=T2))
    plan = store.classify_import(log.keys, incoming, T2, incoming_bound=1)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert schemas and all("content_digest" in s.split("ReadSchema")[1] and "content:" not in s.split("ReadSchema")[1] for s in schemas)


def test_update_and_delete(spark, scratch):
    base = scratch + "/log"
    log, _ = put(spark, base, {f"{k}.txt": text(str(k)) for k in range(5)})
    ids = {r["filename"]: r["article_id"] for r in log.articles.collect()}
    updates = spark.createDataFrame([(ids["1.txt"], {"title": "new"}), ("none", {"title": "x"})], "article_id string, updates map<string,string>")
    log, report = article_log.update(spark, base, updates)
    assert {r["article_id"]: r["found"] for r in report.collect()} == {ids["1.txt"]: True, "none": False}
    assert {r["title"] for r in log.articles.where("filename = '1.txt'").collect()} == {"new"} and log.articles.count() == 5
    gone = article_log.delete(spark, base, spark.createDataFrame([(ids["1.txt"],), (ids["2.txt"],), ("none",)], "article_id string"))
    assert set(contents(spark, base)) == {"0.txt", "3.txt", "4.txt"}
    assert article_log.delete(spark, base, spark.createDataFrame([("none",)], "article_id string")).version == gone.version
    put(spark, base, {"1.txt": text("back")}, T2)
    assert contents(spark, base)["1.txt"] == "back"


def test_two_writers_lose_nothing(spark, scratch, monkeypatch):
    base = scratch + "/log"
    put(spark, base, {"a.txt": text("a"), "b.txt": text("b")})
    commit, raced = versions.commit, []

    def late(spark_, base_, version, manifest):
        if not raced:
            raced.append(version)
            put(spark, base, {"b.txt": text("b of the other"), "c.txt": text("c")}, T2)
        commit(spark_, base_, version, manifest)

    monkeypatch.setattr(versions, "commit", late)
    log, _ = put(spark, base, {"a.txt": text("a anew"), "d.txt": text("d")}, T2)
    assert (log.version, raced) == (3, [2])
    assert contents(spark, base) == {"a.txt": "a anew", "b.txt": "b of the other", "c.txt": "c", "d.txt": "d"}
    assert log.articles.count() == 4


def test_two_streams_and_an_epoch_that_runs_again(spark, scratch):
    base = scratch + "/log"
    batch = [raw(spark, {"a.txt": text("1")}), raw(spark, {"a.txt": text("2"), "b.txt": text("2")}), raw(spark, {"b.txt": text("3")})]
    one, two = upsert_into_log(base, query_key="one"), upsert_into_log(base, query_key="two")
    one(batch[0], 0)
    two(batch[1], 0)
    one(batch[2], 1)
    log = article_log.open_log(spark, base)
    one(batch[0], 0)  # an old epoch of the first stream again
    one(batch[2], 1)
    assert article_log.open_log(spark, base).version == log.version and log.manifest["streams"] == {"one": 1, "two": 0}
    assert contents(spark, base) == {"a.txt": "2", "b.txt": "3"}


def test_archive_stream_into_a_log(spark, scratch):
    folder, base = scratch + "/archive", scratch + "/log"
    os.makedirs(folder)
    for r in derived_archive(read_table(spark, SF_SMALL, "documents")).limit(20).collect():
        with open(os.path.join(folder, r["filename"]), "w", encoding="utf-8") as f:
            f.write(r["raw"])
    for _ in range(2):
        start_ingest(spark, folder, base, scratch + "/checkpoint", into_log=True).awaitTermination()
    log = article_log.open_log(spark, base)
    assert log.version == 1 and 0 < log.articles.count() <= 20
    assert log.articles.groupBy("filename").count().where(F.col("count") > 1).count() == 0


def test_an_empty_store(spark, scratch):
    log = article_log.open_log(spark, scratch + "/log")
    assert log.version == 0 and log.articles.count() == 0
    assert put(spark, scratch + "/log", {})[0].version == 0
    with pytest.raises(Exception):
        article_log.open_log(spark, scratch + "/log", 5)
