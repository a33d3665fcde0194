"""Index and BM25 retrieval: brute force on a small fixture plus properties."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators.index import build_index, load_index, save_index
from quire.operators.search import bm25_topk, filtered_search, search, text_search
from quire.sources.tables import load_corpus, load_queries

from conftest import SF_SMALL

def py_tokens(s):
    return [t for t in re.findall(r"[\w]+", (s or "").lower())]


@pytest.fixture(scope="module")
def corpus(spark):
    arts = load_corpus(spark, SF_SMALL)
    return arts, build_index(arts, materialize=True)


def brute_force(docs, queries, k, k1=1.2, b=0.75):
    toks = {d: py_tokens(t) for d, t in docs}
    nonempty = {d: t for d, t in toks.items() if t}
    n = len(nonempty)
    avgdl = sum(len(t) for t in nonempty.values()) / n
    df = Counter()
    for t in nonempty.values():
        df.update(set(t))
    out = {}
    for qid, q in queries:
        terms = set(py_tokens(q))
        scores = {}
        for d, t in nonempty.items():
            tf = Counter(t)
            s = 0.0
            for term in terms:
                if tf[term]:
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    s += idf * tf[term] * (k1 + 1) / (tf[term] + k1 * (1 - b + b * len(t) / avgdl))
            if any(tf[term] for term in terms):
                scores[d] = round(s, 6)
        ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out[qid] = ranked
    return out


def test_bm25_matches_brute_force(spark, corpus):
    arts, idx = corpus
    queries = load_queries(spark, SF_SMALL)
    docs = [(r["article_id"], r["content"]) for r in arts.select("article_id", "content").collect()]
    qs = [(r["query_id"], r["query"]) for r in queries.collect()]
    expected = brute_force(docs, qs, 5)
    got = {}
    for r in bm25_topk(queries, idx, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["article_id"], r["score"]))
    for qid, ranked in expected.items():
        mine = [(a, s) for _, a, s in sorted(got.get(qid, []))]
        assert [a for a, _ in mine] == [a for a, _ in ranked]
        for (_, s1), (_, s2) in zip(mine, ranked):
            assert abs(s1 - s2) < 1e-6


def test_sum_tf_equals_length(corpus):
    _, idx = corpus
    by_doc = idx.postings.groupBy("article_id").agg(F.sum("tf").alias("s"))
    bad = by_doc.join(idx.doc_stats, "article_id").filter(F.col("s") != F.col("len"))
    assert bad.count() == 0


def test_topk_is_prefix(spark, corpus):
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    k3 = {(r["query_id"], r["rank"]): r["article_id"] for r in bm25_topk(q, idx, 3).collect()}
    k4 = {(r["query_id"], r["rank"]): r["article_id"] for r in bm25_topk(q, idx, 4).collect()}
    assert all(k4[key] == v for key, v in k3.items())


def test_independent_of_partitioning(spark, corpus):
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    base = sorted(tuple(r) for r in bm25_topk(q, idx, 5).collect())
    idx2 = build_index(arts.repartition(7), materialize=True)
    other = sorted(tuple(r) for r in bm25_topk(q.repartition(3), idx2, 5).collect())
    assert base == other


def test_save_and_load_index(spark, corpus, scratch):
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    path = save_index(idx, scratch + "/idx")
    idx2 = load_index(spark, path)
    assert sorted(map(tuple, bm25_topk(q, idx, 5).collect())) == sorted(map(tuple, bm25_topk(q, idx2, 5).collect()))


def test_search_rows(spark, corpus):
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    rows = search(arts, q, idx, k=5).collect()
    assert rows and all(r["preview"].startswith("...") and r["preview"].endswith("...") for r in rows)
    assert all(r["total"] <= 5 and r["title"] == "Untitled" for r in rows)


def test_empty_and_unknown_queries(spark, corpus):
    arts, idx = corpus
    q = spark.createDataFrame([(1, ""), (2, None), (3, "zzzzqqq")], "query_id long, query string")
    assert bm25_topk(q, idx, 5).count() == 0


def test_text_search_operators(spark):
    arts = spark.createDataFrame(
        [("a", "Red fox", "the quick brown fox"), ("b", "Blue", "quick red fox jumps"),
         ("c", "Green", "slow brown dog")], "article_id string, title string, content string")
    idx = build_index(arts, fields=("title", "content"))
    q = spark.createDataFrame([(1, '"brown fox" quick'), (2, "fox -jumps"), (3, "brown"), (4, 'brown -"brown fox"'),
                               (5, '"quick -brown"'), (6, "brown -brown-dog"), (7, "quick -brown-cow -red-fox")],
                              "query_id long, query string")
    got = {}
    for r in text_search(q, arts, idx, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["article_id"])
    assert got[1] == {"a"}
    assert got[2] == {"a"}
    assert got[3] == {"a", "c"}
    assert got[4] == {"c"}         # a negated phrase bans its holders
    assert 5 not in got            # a - in quotes is text, which no article has
    assert got[6] == {"a", "c"}    # "brown-dog" as a whole is in no article
    assert got[7] == {"a", "b"}


def test_filtered_search(spark, corpus):
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    allowed = {r["article_id"] for r in arts.filter(F.col("source").isin("src1", "src2")).collect()}
    rows = filtered_search(q, arts, idx, {"source": ["src1", "src2"]}, k=10).collect()
    assert rows and all(r["article_id"] in allowed for r in rows)


def test_filter_value_of_another_type_matches_nothing(spark, corpus):
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    for bad in ({"publish_date": "abc"}, {"publish_date": ["abc", 5]}, {"source": True}):
        assert filtered_search(q, arts, idx, bad, k=10).count() == 0
    assert filtered_search(q, arts, idx, {"publish_date": None}, k=10).count() > 0


def test_bucketed_store_same_results_and_pruning(spark, corpus, scratch):
    from quire.operators import store
    from quire.operators import answer as qa
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    store.write_bucketed_store(arts, scratch + "/store", 16)
    st = store.read_bucketed_store(spark, scratch + "/store")
    a = sorted(map(tuple, search(arts, q, idx, 5).collect()))
    b = sorted(map(tuple, search(st, q, idx, 5).collect()))
    assert a == b
    a = sorted(map(tuple, qa.flatten_answers(qa.answer_questions(q, arts, idx)).collect()))
    b = sorted(map(tuple, qa.flatten_answers(qa.answer_questions(q, st, idx)).collect()))
    assert a == b
    plan = search(st, q.limit(1), idx, 5)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_chunked_query_terms_same_result(spark, corpus):
    """Query terms beyond the broadcast bound are joined by a shuffle."""
    arts, idx = corpus
    q = load_queries(spark, SF_SMALL)
    base = sorted(map(tuple, bm25_topk(q, idx, 5).collect()))
    chunked = sorted(map(tuple, bm25_topk(q, idx, 5, max_broadcast_rows=150).collect()))
    assert base == chunked
