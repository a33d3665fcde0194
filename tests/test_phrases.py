"""Phrase queries: postings decide on whole words, article text on the rest."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.index import build_index

WORDS = ["red", "fox", "foxes", "jump", "jumps", "over", "lazy", "dog", "hotdog", "über", "a_b", "x1"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", "-", "\n"]) for _ in range(n))

    rows = [(f"d{k}", None if k % 9 == 0 else text(rng.randrange(1, 5)), None if k % 11 == 0 else text(rng.randrange(0, 60)).title())
            for k in range(900)]
    arts = spark.createDataFrame(rows, "article_id string, title string, content string")
    return rows, arts, build_index(arts, fields=("title", "content"), materialize=True)


QUERIES = [
    (1, '"red fox jumps"'), (2, '"d fox ju" lazy'), (3, '"hotdog over"'), (4, '"over lazy d" "red"'), (5, '"fox, red fox"'),
    (6, 'red -"fox jumps over"'), (7, '"lazy dog over" -über'), (8, '"red zzz fox" red'), (9, "fox dog"), (10, '" red "'),
    (11, '"ÜBER a_b x1"'), (12, '"dog-red fox" -hotdog'), (13, '"fox\njumps over"'), (14, None), (15, '""'),
]


def contained(title, content, phrase):
    return any(phrase in (t or "").lower() for t in (title, content))


def expected(rows):
    """Article ids per query by the definition, without an index."""
    out = {}
    for qid, q in QUERIES:
        q = q or ""
        negated = [p.lower() for p in re.findall(r'(?:^|\s)-"([^"]*)"', q)]
        rest = re.sub(r'(?:^|\s)-"[^"]*"', " ", q)
        phrases = [p.lower() for p in re.findall(r'"([^"]*)"', rest) if p]
        bare = re.sub(r'"[^"]*"', " ", rest)
        excluded = {w.lower() for w in re.findall(r"(?:^|\s)-(\w+)", bare)}
        terms = set(re.findall(r"\w+", " ".join([re.sub(r"(?:^|\s)-\w+", " ", bare), *phrases]).lower()))
        out[qid] = set()
        for i, title, content in rows:
            words = set(re.findall(r"\w+", f"{title or ''} \n {content or ''}".lower()))
            if (words & terms and not words & excluded and all(contained(title, content, p) for p in phrases)
                    and not any(contained(title, content, p) for p in negated)):
                out[qid].add(i)
    return out


@pytest.mark.parametrize("bound", [2_000_000, 3])
def test_phrases_match_containment(spark, corpus, bound):
    rows, arts, idx = corpus
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    got = {qid: set() for qid, _ in QUERIES}
    for r in search.text_search_scores(q, arts, idx, max_broadcast_rows=bound).collect():
        got[r["query_id"]].add(r["article_id"])
    want = expected(rows)
    assert got == want
    assert sum(bool(x) for x in want.values()) >= 9  # the queries do find something


def test_scores_are_those_of_the_words(spark, corpus):
    _, arts, idx = corpus
    q = spark.createDataFrame([(1, '"red fox jumps" lazy')], "query_id long, query string")
    plain = spark.createDataFrame([(1, "red fox jumps lazy")], "query_id long, query string")
    want = {r["article_id"]: r["score"] for r in search.bm25_scores(plain, idx).collect()}
    rows = search.text_search_scores(q, arts, idx).collect()
    assert rows and all(want[r["article_id"]] == r["score"] for r in rows)


def test_postings_decide_on_whole_words(spark, corpus):
    rows, arts, idx = corpus
    q = spark.createDataFrame([(1, '"red fox jumps over dog"')], "query_id long, query string")
    parsed = search.parse_text_query(q)
    kept = {r["article_id"] for r in search.phrase_scores(parsed, idx).collect()}
    holders = {i for i, t, c in rows if {"fox", "jumps", "over"} <= set(re.findall(r"\w+", f"{t or ''} {c or ''}".lower()))}
    assert kept == holders
    every = search.text_match(parsed.select("query_id", parsed["positive"].alias("query")), idx).count()
    assert len(kept) < every


def test_index_without_titles_checks_every_candidate(spark, corpus):
    """A phrase may stand in a title that such an index doesn't hold."""
    rows, arts, _ = corpus
    idx = build_index(arts, fields=("content",), materialize=True)
    q = spark.createDataFrame([(1, '"red fox jumps"')], "query_id long, query string")
    got = {r["article_id"] for r in search.text_search_scores(q, arts, idx).collect()}
    want = {i for i, t, c in rows if contained(t, c, "red fox jumps") and {"red", "fox", "jumps"} & set(re.findall(r"\w+", (c or "").lower()))}
    assert got == want


def test_plain_queries_are_not_written_down(spark, corpus, monkeypatch):
    """Only candidates of queries with phrases are checkpointed."""
    from quire import session
    _, arts, idx = corpus
    written = []
    real = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df, **kw: written.append(real(df, **kw)) or written[-1])
    q = spark.createDataFrame([(1, "red dog"), (2, '"fox jumps over"'), (3, "lazy")], "query_id long, query string")
    assert {r["query_id"] for r in search.text_search_scores(q, arts, idx).collect()} == {1, 2, 3}
    assert [{r["query_id"] for r in df.collect()} for df in written] == [{2}]


def test_excluded_terms_are_decided_in_the_aggregate(spark):
    """No join of all scores with all postings of excluded terms; a null id equals none, repeated ids are one article."""
    data = [("a", "red fox"), ("b", "red hen"), ("c", "blue fox"), ("c", "red hen"), (None, "red fox"), ("d", "hen")]
    articles = spark.createDataFrame(data, "article_id string, content string").withColumn("title", F.lit(None).cast("string"))
    index = build_index(articles, ("title", "content"), materialize=True)
    queries = spark.createDataFrame([(1, "red -fox"), (2, "red -unknown"), (3, "fox -fox"), (None, "red -fox"), (4, "-hen")], "query_id long, query string")
    scores = search.text_search_scores(queries, articles, index)
    found = sorted(((r["query_id"], r["article_id"]) for r in scores.collect()), key=str)
    assert found == sorted([(1, "b"), (1, None), (2, "a"), (2, "b"), (2, "c"), (2, None), (3, None), (None, "a"), (None, "b"), (None, "c"), (None, None)], key=str)
    assert "LeftAnti" not in scores._jdf.queryExecution().executedPlan().toString()
