"""The stored index: same rows as the built one, pruning, updates, several writers."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import segments, versions
from quire.operators.index import build_index, load_index, save_index
from quire.operators.search import bm25_topk, filter_condition, filtered_search
from quire.sources.tables import load_corpus, load_queries

from conftest import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.select("query_id", "article_id", "score", "rank").collect()))


def built(articles, queries, k=5, fields=("content",)):
    return rows(bm25_topk(queries, build_index(articles, fields, materialize=True), k))


@pytest.fixture(scope="module")
def corpus(spark):
    return load_corpus(spark, SF_SMALL).select("article_id", "content").cache(), load_queries(spark, SF_SMALL)


def test_stored_index_gives_the_same_rows_and_scores_fewer_pairs(spark, corpus, scratch, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    articles, queries = corpus
    segments.add(articles, scratch + "/index", parts=4)
    index = segments.open_index(spark, scratch + "/index")
    expected = built(articles, queries)
    assert rows(segments.segment_topk(queries, index, 5)) == expected
    assert rows(segments.segment_topk(queries, index, 5, max_broadcast_rows=10)) == expected, "beyond the broadcast bound"
    scored, matching = segments.postings_read(queries, index, 5)
    assert 0 < scored < matching
    directory = index.blocks.groupBy("term", "seg", "block").count().where("count > 1")
    assert directory.count() == 0 and index.postings.where(F.size("entries") > 8).count() == 0


def test_lookup_opens_only_the_terms_parts(spark, corpus, scratch, monkeypatch):
    articles, _ = corpus
    index = segments.add(articles, scratch + "/index", parts=8)
    word = index.term_stats.orderBy(F.desc("df"), "term").first()["term"]
    queries = spark.createDataFrame([(1, word)], "query_id long, query string")
    weighted = segments.weighted_terms(queries, index)
    found = segments.block_scores(segments.block_bounds(weighted, index), weighted, index)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):].split("\n")[0]
    assert "PartitionFilters: [isnotnull(part" in scan and f"part#" in scan.split("PartitionFilters")[1]
    assert f"term,{word}" in scan.split("PushedFilters")[1]
    # the one generator is that of the joined blocks: the scan's postings aren't exploded
    assert plan.count("Generate ") <= 2 and plan.index("Generate") < plan.index("BroadcastHashJoin") < plan.index("FileScan parquet")
    # with more terms than are named, the parts alone
    monkeypatch.setattr(segments, "NAMED_TERMS", 0)
    assert rows(segments.segment_topk(queries, index, 5)) == built(articles, queries)


def test_updates_equal_a_rebuild(spark, corpus, scratch, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    articles, queries = corpus
    n = F.col("article_id").cast("long")
    base = scratch + "/index"
    segments.add(articles.where(n % 2 == 0), base, parts=4)
    changed = articles.where(n % 4 == 0).withColumn("content", F.concat(F.lit("anew "), F.reverse("content")))
    second = segments.add(changed.unionByName(articles.where(n % 2 == 1)), base)
    now = articles.where(n % 4 != 0).unionByName(changed)
    assert rows(segments.segment_topk(queries, second, 5)) == built(now, queries)
    third = segments.remove(spark, base, articles.where(n % 5 == 0).select("article_id"))
    now = now.where(n % 5 != 0)
    fresh = build_index(now, materialize=True)
    assert sorted(map(tuple, third.term_stats.collect())) == sorted(map(tuple, fresh.term_stats.select("term", "df").collect()))
    corpus_row = fresh.corpus.first()
    assert (third.n_docs, round(third.avgdl, 9)) == (corpus_row["n_docs"], round(corpus_row["avgdl"], 9))
    assert rows(segments.segment_topk(queries, third, 5)) == built(now, queries)
    merged = segments.compact(spark, base)
    assert len(merged.segments) == 1 and not merged.manifest["tombstones"]
    assert rows(segments.segment_topk(queries, merged, 5)) == built(now, queries)
    assert segments.compact(spark, base).version == merged.version, "nothing left to merge"
    # a reader of an earlier version still has it
    assert rows(segments.segment_topk(queries, segments.open_index(spark, base, second.version), 5)) == rows(segments.segment_topk(queries, second, 5))


def test_removed_ids_that_the_index_lacks(spark, corpus, scratch):
    articles, queries = corpus
    index = segments.add(articles, scratch + "/index")
    assert segments.remove(spark, index.base, spark.createDataFrame([("none",)], "article_id string")).version == index.version
    with pytest.raises(FileNotFoundError):
        segments.open_index(spark, scratch + "/other")


def test_awkward_articles_and_queries(spark, scratch):
    rng = random.Random(4)
    words = ["a", "b", "c", "Été", "same"]
    data = [(f"x{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for k in range(40)] + [("null", None), ("empty", ""), ("tie1", "q z"), ("tie2", "q z"), ("long", "a " * 5000)]
    articles = spark.createDataFrame(data, "article_id string, content string")
    queries = spark.createDataFrame([(1, "a été"), (2, ""), (3, None), (4, "unknown"), (5, "z"), (5, "q"), (6, "same " * 50)], "query_id long, query string")
    index = segments.add(articles, scratch + "/index")
    assert rows(segments.segment_topk(queries, index, 3)) == built(articles, queries, 3)
    empty = segments.add(articles.where("false"), scratch + "/empty")
    assert segments.segment_topk(queries, empty, 3).count() == 0


def test_two_writers_lose_nothing(spark, scratch, monkeypatch):
    """The second writer commits while the first is at work; the first starts again from the newer version."""
    base = scratch + "/index"
    one = spark.createDataFrame([("a", "red fox"), ("b", "blue")], "article_id string, content string")
    two = spark.createDataFrame([("b", "blue fox"), ("c", "fox")], "article_id string, content string")
    segments.add(one, base)
    commit, raced = versions.commit, []

    def late(spark_, base_, version, manifest):
        if not raced:
            raced.append(version)
            segments.add(two, base)
        commit(spark_, base_, version, manifest)

    monkeypatch.setattr(versions, "commit", late)
    index = segments.add(spark.createDataFrame([("a", "red"), ("d", "fox fox")], "article_id string, content string"), base)
    assert index.version == 3 and raced == [2]
    queries = spark.createDataFrame([(1, "fox blue red")], "query_id long, query string")
    now = spark.createDataFrame([("a", "red"), ("b", "blue fox"), ("c", "fox"), ("d", "fox fox")], "article_id string, content string")
    assert rows(segments.segment_topk(queries, index, 9)) == built(now, queries, 9)


def test_a_commit_that_never_ended_holds_no_version(spark, scratch):
    assert versions.latest(spark, scratch) == (0, None)
    versions.commit(spark, scratch, 1, {"n": 1})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, scratch, 1, {"n": 2})
    open(f"{scratch}/_log/v000000002.json", "w").close()
    assert versions.latest(spark, scratch) == (2, {"n": 1})
    assert versions.change(spark, scratch, lambda m: m | {"n": 3}) == (3, {"n": 3})


def test_an_index_is_saved_over_the_one_it_was_loaded_from(spark, corpus, scratch):
    articles, queries = corpus
    path = save_index(build_index(articles, materialize=True), scratch + "/it's")
    expected = rows(bm25_topk(queries, load_index(spark, path), 5))
    save_index(load_index(spark, path), path)
    assert rows(bm25_topk(queries, load_index(spark, path), 5)) == expected


def test_filters_reach_the_blocks(spark, corpus, scratch, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    _, queries = corpus
    articles = load_corpus(spark, SF_SMALL)
    index = segments.add(articles, scratch + "/index", parts=4)
    allowed = {"source": ["src1", "src2"]}
    expected = rows(filtered_search(queries, articles, build_index(articles, materialize=True), allowed, 5))
    assert expected and rows(segments.segment_topk(queries, index, 5, only=articles.where(filter_condition(allowed)))) == expected
    assert segments.segment_topk(queries, index, 5, only=articles.where("false")).count() == 0


def test_terms_that_add_little_find_no_candidates(spark, scratch, monkeypatch):
    """Only the needed terms' postings are read, also with an id of several rows; the vectors are written once."""
    monkeypatch.setattr(segments, "BLOCK", 8)
    rng = random.Random(9)
    data = [(f"x{k:03}", "the of " + " ".join(rng.choice(["the", "of", "in", f"w{k % 40}"]) for _ in range(rng.randrange(3, 20)))) for k in range(400)]
    data += [("x001", "the of w1 w1"), ("x002", "the the w7"), (None, "of w3")]
    articles = spark.createDataFrame(data, "article_id string, content string")
    queries = spark.createDataFrame([(1, "the of w1"), (2, "of in w3 w7"), (3, "the of"), (4, "w39 the unknown")], "query_id long, query string")
    monkeypatch.setattr(segments, "cut_lineage", lambda df: pytest.fail("the vectors are written twice"))
    monkeypatch.setattr("quire.operators.index.cut_lineage", lambda df, **kw: pytest.fail("the vectors are written twice"))
    index = segments.add(articles, scratch + "/index", parts=4)
    monkeypatch.undo()
    weighted = segments.weighted_terms(queries, index)
    threshold = segments._threshold(segments._first_scores(segments.block_bounds(weighted, index), weighted, index, 1.2, 0.75, 1000), 3)
    needed = {(r["query_id"], r["term"]) for r in segments._needed(threshold, weighted, index, 1.2, 0.75, 1000).collect()}
    assert (1, "the") not in needed and (1, "w1") in needed and (4, "w39") in needed
    expected = built(articles, queries, 3)
    assert rows(segments.segment_topk(queries, index, 3)) == expected
    assert rows(segments.segment_topk(queries, index, 3, max_broadcast_rows=2)) == expected, "beyond the broadcast bound"
