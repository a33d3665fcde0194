"""Documents from a list in code, without metadata."""

from quire.operators.answer import prompts
from quire.operators.index import build_index
from quire.operators.search import search
from quire.schemas import ARTICLES
from quire.sources.archive import bare_to_articles, literal_documents

TEXTS = ["The red fox jumps.", "A lazy dog sleeps.", "The red fox jumps.", "", None, "Über den Fluss"]


def test_literal_documents_keep_the_list(spark):
    got = literal_documents(spark, TEXTS)
    assert got.columns == ["content"] and sorted(r[0] or "" for r in got.collect()) == sorted(t or "" for t in TEXTS)
    assert literal_documents(spark, []).count() == 0


def test_bare_documents_become_articles(spark):
    arts = bare_to_articles(literal_documents(spark, TEXTS))
    assert arts.columns == [f.name for f in ARTICLES.fields]
    rows = arts.collect()
    assert sorted(r["content"] or "" for r in rows) == sorted({t or "" for t in TEXTS})
    assert len({r["article_id"] for r in rows}) == len(rows)
    assert all(r["title"] is None and r["author"] is None and r["publish_date"] is None for r in rows)


def test_bare_documents_are_searched_and_prompted(spark):
    arts = bare_to_articles(literal_documents(spark, TEXTS))
    idx = build_index(arts, materialize=True)
    q = spark.createDataFrame([(1, "red fox"), (2, "nothing here")], "query_id long, query string")
    hits = search(arts, q, idx, k=5).collect()
    assert [(r["query_id"], r["title"], r["author"], r["total"]) for r in hits] == [(1, "Untitled", "Unknown", 1)]
    rows = {r["query_id"]: r["prompt"] for r in prompts(q, arts, idx).collect()}
    assert rows[1].count("The red fox jumps.") == 1
