"""

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line. Every timing executes the
whole plan through the ``noop`` sink (nothing is collected to the driver);
warm: one untimed run, then the median of ``$BENCH_REPEAT`` (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.operators import answer as qa  # noqa: E402
from quire.operators import listing, store  # noqa: E402
from quire.operators.index import build_index  # noqa: E402
from quire.operators.parse import good_rows, parse_articles  # noqa: E402
from quire.operators.search import bm25_topk, search, text_search  # noqa: E402
from quire.schemas import ARTICLES  # noqa: E402
from quire.session import get_session  # noqa: E402
from quire.sources.tables import (archive_as_raw_files, derived_archive, import_scenario,  # noqa: E402
                                  load_corpus, load_queries, read_table)


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn, repeat):
    fn()  # warm-up
    times = []
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return round(statistics.median(times), 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_session(f"local[{cpus}]", app_name="quire-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})

    docs = read_table(spark, sf_dir, "documents")
    articles = load_corpus(spark, sf_dir)
    queries = load_queries(spark, sf_dir)
    n_docs, n_queries = docs.count(), queries.count()

    t = {}
    t["index_build"] = timed(lambda: build_index(articles, materialize=True), repeat)
    idx = build_index(articles, materialize=True)

    t["bm25_top5"] = timed(lambda: run_noop(bm25_topk(queries, idx, 5)), repeat)
    t["search_results"] = timed(lambda: run_noop(search(articles, queries, idx, k=5)), repeat)
    t["qa_answers"] = timed(lambda: run_noop(qa.answer_questions(queries, articles, idx)), repeat)
    t["prompts_top10"] = timed(lambda: run_noop(qa.prompts(queries, articles, idx, k=10)), repeat)

    raw = archive_as_raw_files(derived_archive(docs))
    t["archive_parse"] = timed(lambda: run_noop(parse_articles(raw, "text")), repeat)

    stored_raw, incoming_raw = import_scenario(docs)
    empty = spark.createDataFrame([], ARTICLES)
    stored = store.apply_import(empty, store.classify_import(
        empty, parse_articles(stored_raw, "importer"), "2024-01-01 00:00:00")).cache()
    stored.count()
    incoming = parse_articles(incoming_raw, "importer", run_ts="2024-01-02 00:00:00")

    n_incoming = incoming_raw.count()

    def upsert():
        classified = store.classify_import(stored, incoming, "2024-01-02 00:00:00", incoming_bound=n_incoming)
        run_noop(store.apply_import(stored, classified, changed_bound=n_incoming))
    t["import_upsert"] = timed(upsert, repeat)

    arts = good_rows(parse_articles(raw, "text")).cache()
    arts.count()
    t["page_first"] = timed(lambda: run_noop(listing.page(arts, 1, 10)), repeat)
    t["page_100"] = timed(lambda: run_noop(listing.page(arts, 100, 10)), repeat)

    store_arts = good_rows(parse_articles(raw, "importer")).cache()
    store_arts.count()
    sidx = build_index(store_arts, fields=("title", "content"), materialize=True)
    t["text_search_top10"] = timed(lambda: run_noop(text_search(queries, store_arts, sidx, 10)), repeat)

    throughput = {
        "bm25_top5_queries_per_s": round(n_queries / t["bm25_top5"], 2),
        "answers_queries_per_s": round(n_queries / t["qa_answers"], 2),
        "archive_parse_files_per_s": round(n_docs / t["archive_parse"], 1),
        "upsert_rows_per_s": round(n_docs / t["import_upsert"], 1),
        "index_docs_per_s": round(n_docs / t["index_build"], 1),
    }
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(t.values()), 3), "unit": "sec",
                      "queries": t, "throughput": throughput, "sf": float(sf) if sf else sf_dir,
                      "docs": n_docs, "queries_n": n_queries, "cpus": int(cpus), "repeat": repeat}))


if __name__ == "__main__":
    main()
