"""Store maintenance properties: idempotent import, paging, lookups."""

import pytest
from pyspark.sql import functions as F

from quire.operators import listing, store
from quire.operators.parse import good_rows, parse_articles
from quire.schemas import ARTICLES
from quire.sources.tables import archive_as_raw_files, derived_archive, import_scenario, read_table

from quire.sources.archive import literal_path

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_SMALL, "documents")


@pytest.fixture(scope="module")
def articles(spark, docs):
    return good_rows(parse_articles(archive_as_raw_files(derived_archive(docs)), "text")).cache()


def test_import_twice_is_idempotent(spark, docs, scratch):
    raw = archive_as_raw_files(derived_archive(docs))
    p1, s1 = store.import_articles(spark, None, parse_articles(raw, "importer", run_ts="2024-01-01 00:00:00"),
                                   scratch + "/v1", "2024-01-01 00:00:00")
    first = s1.collect()[0]
    assert first["processed"] > 0 and first["updated"] == 0 and first["skipped"] == 0
    p2, s2 = store.import_articles(spark, p1, parse_articles(raw, "importer", run_ts="2024-01-02 00:00:00"),
                                   scratch + "/v2", "2024-01-02 00:00:00")
    second = s2.collect()[0]
    assert second["processed"] == 0 and second["updated"] == 0
    assert second["skipped"] == first["processed"] and second["errors"] == first["errors"]
    a = spark.read.parquet(p1).select("filename", "created_at", "last_updated")
    b = spark.read.parquet(p2).select("filename", "created_at", "last_updated")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_import_scenario_counts(spark, docs):
    stored_raw, incoming_raw = import_scenario(docs)
    empty = spark.createDataFrame([], ARTICLES)
    first = store.classify_import(empty, parse_articles(stored_raw, "importer"), "2024-01-01 00:00:00")
    stored = store.apply_import(empty, first)
    second = store.classify_import(stored, parse_articles(incoming_raw, "importer"), "2024-01-02 00:00:00")
    s = second.groupBy("action").count().collect()
    counts = {r["action"]: r["count"] for r in s}
    assert sum(counts.values()) == docs.count()
    # an update keeps the id and created_at of the stored row
    upd = second.filter("action = 'update'").join(
        stored.select("filename", F.col("article_id").alias("sid"), F.col("created_at").alias("sc")), "filename")
    assert upd.filter((F.col("article_id") != F.col("sid")) | (F.col("created_at") != F.col("sc"))).count() == 0
    # compare="all" never finds fewer changes than the body-only default
    all_cmp = store.classify_import(stored, parse_articles(incoming_raw, "importer"), "2024-01-02 00:00:00", "all")
    assert all_cmp.filter("action = 'update'").count() >= counts.get("update", 0)


def test_pages_cover_everything(spark, articles):
    total = articles.count()
    ids = []
    p = 1
    while True:
        rows = listing.page(articles, p, 50).collect()
        if not rows:
            break
        assert rows[0]["total"] == total
        ids += [r["article_id"] for r in rows]
        p += 1
    assert len(ids) == total and len(set(ids)) == total


def test_keyset_pages_match_offset_pages(spark, articles):
    first = listing.keyset_page(articles, None, 10).collect()
    last = first[-1]
    nxt = listing.keyset_page(articles, (last["publish_date"], last["article_id"]), 10).collect()
    by_offset = listing.page(articles, 2, 10).collect()
    assert [r["article_id"] for r in nxt] == [r["article_id"] for r in by_offset]


def test_page_validation(articles):
    with pytest.raises(ValueError):
        listing.page(articles, 0, 10)
    with pytest.raises(ValueError):
        listing.page(articles, 1, 51)
    with pytest.raises(ValueError):
        listing.page(articles, 1, 51, listing.newest_first())
    with pytest.raises(ValueError):
        listing.page(articles, 1, 9, listing.store_order(), max_limit=8)
    assert listing.store_page(articles, 1, 51).count() == min(51, articles.count())


def test_delete_then_lookup(spark, articles):
    some = articles.select("article_id").limit(3)
    remaining = store.delete_articles(articles, some)
    got = listing.lookup(remaining, some).collect()
    assert len(got) == 3 and not any(r["found"] for r in got)
    assert remaining.count() == articles.count() - 3


def test_update_unknown_and_known(spark, articles):
    aid = articles.select("article_id").first()["article_id"]
    upd = spark.createDataFrame([(aid, {"title": "New", "k": "v"}), ("nope", {"a": "b"})],
                                "article_id string, updates map<string,string>")
    new, report = store.update_metadata(articles, upd)
    rep = {r["article_id"]: r["found"] for r in report.collect()}
    assert rep == {aid: True, "nope": False}
    row = new.filter(F.col("article_id") == aid).first()
    assert row["title"] == "New" and row["header"]["k"] == "v"


def test_batch_report_and_violations(spark, articles):
    rep = store.batch_report(articles, 50).collect()
    n = len(rep)
    assert {r["n_batches"] for r in rep} == {(n - 1) // 50 + 1}
    ordered = sorted(rep, key=lambda r: r["filename"])
    assert [r["batch"] for r in ordered] == [i // 50 + 1 for i in range(n)]
    dup = articles.select("filename").unionByName(articles.select("filename").limit(2))
    assert store.key_violations(dup).count() == 2
    assert store.dedupe_on_key(articles.unionByName(articles.limit(2))).count() == articles.count()


def test_load_once(spark, articles, scratch):
    path = scratch + "/store"
    assert store.load_once(spark, articles, path) is True
    assert store.load_once(spark, articles, path) is False
    assert store.write_articles(articles.limit(0), scratch + "/none") is False


def test_date_layout(spark, articles, scratch):
    path = store.write_date_sorted(articles, scratch + "/bydate", partitions=4)
    df = spark.read.parquet(path)
    assert df.count() == articles.count()


def test_dedupe_hot_key_keeps_newest(spark):
    """A key holding most rows is reduced by aggregation, newest row wins."""
    from quire.sources.tables import conform_articles
    rows = [(f"id{i:04d}", "hot.txt", f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(300)]
    rows += [("solo", "cold.txt", "2024-01-01 00:00:00")]
    df = conform_articles(spark.createDataFrame(rows, "article_id string, filename string, last_updated string")
                          .withColumn("last_updated", F.col("last_updated").cast("timestamp")))
    out = {r["filename"]: r for r in store.dedupe_on_key(df).collect()}
    assert set(out) == {"hot.txt", "cold.txt"}
    hot = out["hot.txt"]
    assert str(hot["last_updated"]) == "2024-01-28 00:00:00"
    newest = sorted(r[0] for r in rows if r[2] == "2024-01-28 00:00:00")
    assert hot["article_id"] == newest[0]


def test_updates_of_one_id_merge_and_can_clear(spark):
    arts = spark.createDataFrame(
        [("a", "T", "A", {"title": "T", "date": "2001-01-01"}, "2001-01-01", 3), ("b", "U", "B", None, None, 4)],
        "article_id string, title string, author string, header map<string,string>, publish_date_raw string, bucket int") \
        .withColumn("publish_date", F.to_timestamp("publish_date_raw"))
    updates = spark.createDataFrame(
        [("a", {"author": None, "quality": "1"}, 1), ("a", {"quality": "2", "publishDate": "2020-01-02"}, 2), ("x", {"title": "n"}, 1),
         ("b", {"date": "no date", "title": None}, 1)], "article_id string, updates map<string,string>, nth int")
    new, report = store.update_metadata(arts, updates, order_col="nth")
    got = {r["article_id"]: r for r in new.collect()}
    assert len(got) == new.count() == 2 and new.columns == arts.columns
    assert got["a"]["title"] == "T" and got["a"]["author"] is None and got["a"]["bucket"] == 3
    assert got["a"]["header"] == {"title": "T", "date": "2001-01-01", "author": None, "quality": "2", "publishDate": "2020-01-02"}
    assert got["a"]["publish_date_raw"] == "2020-01-02" and got["a"]["publish_date"].day == 2
    assert got["b"]["title"] is None and got["b"]["publish_date_raw"] == "no date" and got["b"]["publish_date"] is None
    assert {tuple(r) for r in report.collect()} == {("a", True), ("b", True), ("x", False)}


def test_import_takes_one_row_per_file_name(spark, scratch):
    raw = spark.createDataFrame([("p/x.txt", "x.txt", bytearray(b"Title: A\n---\none")), ("q/x.txt", "x.txt", bytearray(b"Title: A\n---\ntwo")),
                                 ("p/y.txt", "y.txt", bytearray(b"---\nthree"))], "path string, filename string, content binary")
    path, stats = store.import_articles(spark, None, parse_articles(raw, "importer"), scratch + "/v1", "2024-01-01 00:00:00")
    assert stats.collect()[0]["processed"] == 2
    assert sorted(r["filename"] for r in spark.read.parquet(path).collect()) == ["x.txt", "y.txt"]


def test_ranked_pages_open_only_their_files(spark, articles, scratch):
    n = articles.count()
    path = listing.write_ranked(articles, scratch + "/[ranked]", 8)
    for page_no, limit in ((1, 10), (3, 7), (2, 50), (n // 10 + 1, 10), (n, 1)):
        by_offset = [r["article_id"] for r in listing.page(articles, page_no, limit).collect()]
        found = listing.ranked_page(spark, path, page_no, limit)
        rows = found.collect()
        assert [r["article_id"] for r in rows] == by_offset and all((r["total"], r["page"], r["limit"]) == (n, page_no, limit) for r in rows)
    assert listing.ranked_page(spark, path, n + 1, 10).count() == 0
    opened = listing.ranked_page(spark, path, 2, 5).inputFiles()
    assert 1 <= len(opened) < len(spark.read.parquet(literal_path(path + "/rows")).inputFiles())
    with pytest.raises(ValueError):
        listing.ranked_page(spark, path, 1, 51)
