"""Unreadable files, native row numbers, whole text-search rows."""

import os

from pyspark.sql import functions as F

from quire.operators import store
from quire.operators.index import build_index
from quire.operators.parse import parse_articles, unread_files
from quire.operators.search import text_search_rows
from quire.session import cut_lineage
from quire.sources.archive import scan_archive


def test_an_unreadable_file_becomes_an_error_row(spark, scratch):
    for name in ("a.txt", "b.txt", "c.txt"):
        with open(os.path.join(scratch, name), "w") as f:
            f.write(f"Title: {name}\n---\nbody")
    raw, problem = scan_archive(spark, scratch, tolerant=True)
    assert problem is None
    listed = cut_lineage(raw.select("filename"))
    os.unlink(os.path.join(scratch, "b.txt"))  # listed, but gone when it is read
    parsed = cut_lineage(parse_articles(raw, "importer"))
    assert sorted(r["filename"] for r in parsed.collect()) == ["a.txt", "c.txt"]
    assert [tuple(r) for r in unread_files(listed, parsed).collect()] == [("b.txt", "unreadable file")]


def test_row_numbers_are_dense_and_native(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.sha2(F.col("id").cast("string"), 256).alias("filename"), F.col("id").cast("string").alias("article_id"))
    found = store.row_index(df, ["filename"])
    rows = found.collect()
    assert [r["row_index"] for r in sorted(rows, key=lambda r: r["filename"])] == list(range(1, 1001))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan
    assert store.row_index(df.where("false"), ["filename"]).count() == 0


def test_text_search_rows_hold_the_article_and_the_query(spark):
    arts = store.conform_articles(spark.createDataFrame([("a", "a.txt", "Fox", "red fox"), ("b", "b.txt", "Dog", "brown dog")], "article_id string, filename string, title string, content string"))
    queries = spark.createDataFrame([(1, "fox"), (2, "dog fox"), (3, "none")], "query_id long, query string")
    rows = text_search_rows(queries, arts, build_index(arts, ("title", "content"), materialize=True)).collect()
    assert sorted((r["query_id"], r["query"], r["count"], r["id"], r["content"]) for r in rows) == [
        (1, "fox", 1, "a", "red fox"), (2, "dog fox", 2, "a", "red fox"), (2, "dog fox", 2, "b", "brown dog")]
