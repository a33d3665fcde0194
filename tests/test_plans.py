"""Plan-shape guards for the scale properties the design relies on."""

import pytest

from quire.operators import listing, sizing, store
from quire.operators.answer import answer_questions, flatten_answers
from quire.operators.index import build_index, load_index, save_index
from quire.operators.parse import good_rows, parse_articles
from quire.operators.search import bm25_topk, search
from quire.schemas import ARTICLES
from quire.session import cut_lineage
from quire.sources.tables import (archive_as_raw_files, derived_archive, import_scenario,
                                  load_corpus, load_queries, read_table)

from conftest import SF_SMALL


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    arts = load_corpus(spark, SF_SMALL)
    return arts, build_index(arts, materialize=True)


def test_bm25_has_one_hash_exchange_after_partial_topk(spark, corpus):
    arts, idx = corpus
    plan = executed(bm25_topk(load_queries(spark, SF_SMALL), idx, 5))
    assert plan.count("Exchange hashpartitioning") == 1      # only the query_id exchange
    assert "hashpartitioning(query_id" in plan
    assert plan.count("WindowGroupLimit") >= 2                # partial + final top-k
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_loaded_index_scans_bucketed(spark, corpus, scratch):
    arts, idx = corpus
    path = save_index(idx, scratch + "/idx", buckets=4)
    plan = executed(bm25_topk(load_queries(spark, SF_SMALL), load_index(spark, path), 5))
    assert "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_sizes_are_bounded_by_bytes_too(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "ä" * 100, {"k": "v" * 100}, [None, "w"]), (2, None, None, None)],
                                 "`a.b` long, text string, m map<string,string>, a array<string>")
    assert sizing.count_upto(rows, 10) == 2 and sizing.count_upto(rows, 1) == 2 and sizing.count_upto(rows.limit(0), 0) == 0
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", 390)  # 64 + 200 for the text + 108 and 10 as JSON
    assert sizing.count_upto(rows, 10) == 2 and sizing.count_upto(rows, 10, copies=2) == 11
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", 300)
    assert sizing.count_upto(rows, 10) == 11 and sizing.count_upto(rows.select("`a.b`"), 10) == 2


def test_long_queries_are_not_broadcast(spark, corpus, monkeypatch):
    arts, idx = corpus
    queries = load_queries(spark, SF_SMALL)
    whole = search(arts, queries, idx, 3).collect()
    answers = flatten_answers(answer_questions(queries, arts, idx)).collect()
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", 100)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for key, value in off.items():
            spark.conf.set(key, value)
        rows = search(arts, queries, idx, 3)
        plan = executed(rows)
        found = rows.collect()
        again = flatten_answers(answer_questions(queries, arts, idx)).collect()
    finally:
        for key in off:
            spark.conf.unset(key)
    assert "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan
    assert sorted(found) == sorted(whole) and sorted(map(str, again)) == sorted(map(str, answers))


def test_import_does_not_shuffle_the_store(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    stored_raw, incoming_raw = import_scenario(docs)
    empty = spark.createDataFrame([], ARTICLES)
    stored = store.apply_import(empty, store.classify_import(
        empty, parse_articles(stored_raw, "importer"), "2024-01-01 00:00:00", incoming_bound=200),
        changed_bound=200)
    classified = store.classify_import(stored, parse_articles(incoming_raw, "importer"),
                                       "2024-01-02 00:00:00", incoming_bound=200)
    plan = executed(store.apply_import(stored, classified, changed_bound=200))
    assert "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan


def test_lookup_and_delete_do_not_shuffle(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    arts = good_rows(parse_articles(archive_as_raw_files(derived_archive(docs)), "text"))
    ids = arts.select("article_id").limit(5)
    for df in (listing.lookup(arts, ids), store.delete_articles(arts, ids)):
        plan = executed(df)
        assert "SortMergeJoin" not in plan


def broadcast_columns(node):
    """The columns of every broadcast side below a physical plan node."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    own = [node.output().mkString(",")] if node.nodeName() == "BroadcastExchange" else []
    children = node.children()
    return own + [c for i in range(children.size()) for c in broadcast_columns(children.apply(i))]


def test_no_article_text_is_broadcast(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    incoming_raw = import_scenario(docs)[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # only the hinted ones
    try:
        arts = cut_lineage(good_rows(parse_articles(archive_as_raw_files(derived_archive(docs)), "text")))
        incoming = cut_lineage(parse_articles(incoming_raw, "importer"))
        for df in (listing.lookup(arts, arts.select("article_id").limit(5)),
                   store.classify_import(arts, incoming, "2024-01-02 00:00:00", "all", incoming_bound=200)):
            sides = broadcast_columns(df._jdf.queryExecution().executedPlan())
            assert sides
            for columns in sides:
                # digests (s_content, s_title, s_author) are of a fixed width
                assert not {"content", "title", "header"} & {c.split("#")[0] for c in columns.split(",")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paging_has_no_single_task_window(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    arts = good_rows(parse_articles(archive_as_raw_files(derived_archive(docs)), "text"))
    plan = executed(listing.page(arts, 3, 10))
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
