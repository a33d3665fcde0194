"""Article store maintenance on snapshot tables.

The store is a directory of parquet snapshots. Every change writes a **new**
snapshot directory and returns its path; the snapshot being read is never
overwritten. Key lookups run as one join for the whole batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import conform_articles
from .parse import DATE_FORMAT, error_rows
from .sizing import MAX_BROADCAST_ROWS, count_upto, lookup_join, maybe_broadcast

ACTIONS = ("insert", "update", "skip", "error")


# ------------------------------------------------------------------ writes

def store_is_empty(spark: SparkSession, path: str) -> bool:
    """K2 emptiness test: a missing store or one without rows is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return True
    return spark.read.parquet(path).limit(1).count() == 0


def write_articles(articles: DataFrame, path: str, max_records_per_file: int | None = None) -> bool:
    """K1 bulk write; nothing is written when there is nothing to write.

    ``max_records_per_file`` gives K3's batched write (50 per file in the
    deployment variant) as parallel task writes instead of sequential batches.
    """
    if articles.limit(1).count() == 0:
        return False
    w = conform_articles(articles).write.mode("errorifexists")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)
    return True


def load_once(spark: SparkSession, articles: DataFrame, path: str) -> bool:
    """K2: write only if the store holds no documents yet."""
    if not store_is_empty(spark, path):
        return False
    return write_articles(articles, path)


BUCKET_COL = "bucket"


def article_bucket(article_id, buckets: int):
    """Store partition of an article: a hash bucket of its id."""
    return F.pmod(F.xxhash64(article_id), F.lit(buckets)).cast("int")


def write_bucketed_store(articles: DataFrame, path: str, buckets: int) -> str:
    """Article store partitioned (directories) by ``bucket`` of ``article_id``.

    A join from a small hit table on ``(bucket, article_id)`` then lets
    dynamic partition pruning read only the buckets that hold hits instead of
    every article's text."""
    from .index import open_text
    df = conform_articles(articles).withColumn(BUCKET_COL, article_bucket(F.col("article_id"), buckets))
    df.repartition(BUCKET_COL).write.mode("errorifexists").partitionBy(BUCKET_COL).parquet(path)
    with open_text(articles.sparkSession, os.path.join(path, "_quire_buckets")) as f:
        f.write(str(buckets))
    return path


def read_bucketed_store(spark: SparkSession, path: str) -> DataFrame:
    """Read a bucketed store; the bucket count rides on the ``bucket``
    column's metadata so joins can compute the bucket of a hit."""
    from .index import _read_text
    n = int(_read_text(spark, os.path.join(path, "_quire_buckets")))
    df = spark.read.parquet(path)
    return df.withColumn(BUCKET_COL, F.col(BUCKET_COL).alias(BUCKET_COL, metadata={"quire.buckets": n}))


def write_date_sorted(articles: DataFrame, path: str, partitions: int | None = None) -> str:
    """Date layout for the newest-first listing.

    Range-partitioned and sorted by ``publish_date`` so parquet min/max
    statistics let a date-bounded or keyset page skip files and row groups.
    """
    df = conform_articles(articles)
    df = df.repartitionByRange(partitions, "publish_date") if partitions else df.repartitionByRange("publish_date")
    df.sortWithinPartitions(F.col("publish_date").desc_nulls_last(), "article_id") \
        .write.mode("errorifexists").parquet(path)
    return path


def row_index(df: DataFrame, order_cols: list[str], index_col: str = "row_index") -> DataFrame:
    """A dense 1-based index in ``order_cols`` order without a single-task window.

    Range-partition + sort, and number the rows within each partition: the
    number of ``monotonically_increasing_id`` holds the partition and the row's
    place there. A table with one row per partition turns into offsets.
    """
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    # materialised once, so that both readings see the same numbers
    from ..session import cut_lineage
    ordered = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.select("*", F.shiftright("_id", 33).cast("int").alias("_pid"))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (ordered.join(F.broadcast(offsets), "_pid").withColumn(index_col, F.col("_before") + place + 1)
            .drop("_pid", "_id", "_before"))


def batch_report(articles: DataFrame, batch_size: int = 50) -> DataFrame:
    """K3 report: batch ``i`` of ``n`` for each article in file-name order,
    ``n = (len - 1) // batch_size + 1``."""
    indexed = row_index(articles.select("filename", "article_id"), ["filename"])
    total = articles.select(F.count(F.lit(1))).scalar()
    return indexed.select(
        "filename", "article_id",
        (F.floor((F.col("row_index") - 1) / batch_size) + 1).cast("long").alias("batch"),
        F.ceil(total / F.lit(batch_size)).cast("long").alias("n_batches"),
    )


# ------------------------------------------------------------------ upsert

def classify_import(stored: DataFrame, incoming: DataFrame, run_ts: str,
                    compare: str = "content", max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                    incoming_bound: int | None = None) -> DataFrame:
    """J1 + K4/K5 action column for every incoming file.

    ``incoming`` is a parse result (with ``error``). One outer join on the
    unique key ``filename`` replaces a per-file lookup. The error case comes
    before the comparison. ``compare="content"`` compares the body only (a
    title-only edit is skipped); ``compare="all"`` also title, author, date.
    ``incoming_bound`` is a known upper bound of the incoming rows (e.g. the
    number of raw files, cheap to count); without it the parse is counted.
    A stored table may bring its digests (``content_digest`` and so on) instead
    of the texts.
    """
    if compare not in ("content", "all"):
        raise ValueError("compare must be 'content' or 'all'")

    def digest(c: str) -> F.Column:
        return F.sha2(F.col(c).cast("binary"), 256)

    # texts are compared by digest, so the looked-up rows have a fixed width
    # and no article text is broadcast
    texts = ["content"] if compare == "content" else ["content", "title", "author"]
    s = stored.select(*[F.col(c).alias(f"s_{c}") for c in ("article_id", "filename", "publish_date", "created_at")],
                      *[(F.col(f"{c}_digest") if f"{c}_digest" in stored.columns else digest(c)).alias(f"s_{c}") for c in texts])
    # an increment that is proven small is looked up without shuffling the
    # store (the store streams once past the broadcast file names); otherwise
    # a sort-merge join on the key
    n = incoming_bound if incoming_bound is not None else count_upto(incoming.select("filename"), max_broadcast_rows)
    j = lookup_join(incoming, s, "filename", "s_filename", small_is_bounded=n <= max_broadcast_rows)
    differs = F.lit(False) if compare == "content" else ~F.col("publish_date").eqNullSafe(F.col("s_publish_date"))
    for c in texts:
        differs = differs | ~digest(c).eqNullSafe(F.col(f"s_{c}"))
    action = (F.when(F.col("error").isNotNull(), F.lit("error"))
              .when(F.col("s_filename").isNull(), F.lit("insert"))
              .when(differs, F.lit("update"))
              .otherwise(F.lit("skip")))
    ts = F.lit(run_ts).cast("timestamp")
    return j.select(
        F.when(F.col("s_article_id").isNotNull(), F.col("s_article_id"))
        .otherwise(F.col("article_id")).alias("article_id"),
        "filename", "title", "author", "publish_date", "publish_date_raw", "content",
        "source", "header",
        F.when(F.col("s_filename").isNull(), ts).otherwise(F.col("s_created_at")).alias("created_at"),
        ts.alias("last_updated"),
        "error", action.alias("action"))


def apply_import(stored: DataFrame, classified: DataFrame, changed_bound: int | None = None) -> DataFrame:
    """New snapshot: inserted and updated rows replace or join the stored rows;
    skipped, failed and untouched stored rows stay as they were.
    ``changed_bound``: a known upper bound of the changed rows (the incoming
    count); without it the classified frame is counted."""
    changed = conform_articles(classified.filter(F.col("action").isin("insert", "update")))
    n_changed = changed_bound if changed_bound is not None else \
        count_upto(changed.select("filename"), MAX_BROADCAST_ROWS)
    kept = stored.join(maybe_broadcast(changed.select("filename"), n_changed <= MAX_BROADCAST_ROWS),
                       "filename", "left_anti")
    return conform_articles(kept).unionByName(changed)


def import_stats(classified: DataFrame) -> DataFrame:
    """K6 / A3: processed (new only), skipped, updated, errors as one row."""
    a = F.col("action")
    return classified.agg(
        F.count_if(a == "insert").cast("long").alias("processed"),
        F.count_if(a == "skip").cast("long").alias("skipped"),
        F.count_if(a == "update").cast("long").alias("updated"),
        F.count_if(a == "error").cast("long").alias("errors"))


def import_errors(classified: DataFrame) -> DataFrame:
    return error_rows(classified)


def import_articles(spark: SparkSession, stored_path: str | None, incoming: DataFrame,
                    out_path: str, run_ts: str, compare: str = "content",
                    incoming_bound: int | None = None) -> tuple[str, DataFrame]:
    """D end to end: classify, write the new snapshot to ``out_path`` and
    return ``(out_path, stats)``. ``stored_path`` None means an empty store.
    Incoming rows that share a file name become one; ``key_violations(incoming)``
    reports them."""
    from ..schemas import ARTICLES
    stored = spark.read.parquet(stored_path) if stored_path else spark.createDataFrame([], ARTICLES)
    classified = classify_import(stored, one_per_name(incoming), run_ts, compare, incoming_bound=incoming_bound)
    from ..session import cut_lineage
    classified = cut_lineage(classified)
    apply_import(stored, classified, changed_bound=incoming_bound).write.mode("errorifexists").parquet(out_path)
    return out_path, import_stats(classified)


# ------------------------------------------------------------------ keys

def key_violations(articles: DataFrame, key: str = "filename") -> DataFrame:
    """K7: keys held by more than one row."""
    return articles.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("n")).filter(F.col("n") > 1)


def one_per_name(incoming: DataFrame) -> DataFrame:
    """K7 before an upsert: one parse row per file name. Rows that parsed come
    before error rows, then the least body hash and title decide. An
    aggregation, as in ``dedupe_on_key``."""
    order = F.struct(F.col("error").isNotNull(), F.sha2(F.coalesce("content", F.lit("")), 256),
                     F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")))
    return (incoming.groupBy("filename").agg(F.min_by(F.struct(*incoming.columns), order).alias("_row"))
            .select("_row.*"))


def dedupe_on_key(articles: DataFrame, key: str = "filename", newest: str = "last_updated") -> DataFrame:
    """K7: keep one row per key (the newest, ties by article id).

    An aggregation (``min_by``), not a window: rows of a hot key are reduced
    map-side, so a key holding a large share of the rows never lands whole
    in one task."""
    order = F.struct(F.coalesce(-F.unix_micros(F.col(newest)), F.lit(2 ** 62)).alias("o1"),
                     F.col("article_id").alias("o2"))
    cols = [c for c in articles.columns]
    return (articles.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_row"))
            .select("_row.*"))


# ------------------------------------------------------------------ update / delete

# Fixed value: the update key that sets an article's date.
UPDATED_DATE = "publishDate"


def merge_updates(updates: DataFrame, order_col: str | None = None) -> DataFrame:
    """One update map per article: of several values for a key the last by
    ``order_col`` wins, else (and among equals) the greatest, null above all.
    Two aggregations, so a hot id is reduced map-side key by key."""
    order = [F.col(order_col).alias("_o")] if order_col else []
    entries = updates.select("article_id", *order, F.explode("updates").alias("_k", "_v"))
    last = F.max_by("_v", F.struct(*(["_o"] if order else []), F.col("_v").isNull(), "_v"))
    return (entries.groupBy("article_id", "_k").agg(last.alias("_v"))
            .groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("updates")))


def update_metadata(articles: DataFrame, updates: DataFrame, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K8: merge ``updates (article_id, updates MAP)`` into each article's
    ``header`` (updated keys win, to null too; ``title``, ``author`` and
    ``date`` / ``publishDate`` also set their columns). Several updates of one
    id become one (``merge_updates``). Returns ``(new_articles, report)``; the
    report has one row per id, ``found = false`` for ids not in the store."""
    u = merge_updates(updates, order_col).withColumnRenamed("updates", "_u")
    u_small = count_upto(u, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
    j = articles.join(maybe_broadcast(u, u_small), "article_id", "left")
    upd = F.col("_u")

    def has(key) -> F.Column:
        return F.coalesce(F.map_contains_key(upd, key), F.lit(False))

    merged = F.when(upd.isNull(), F.col("header")).otherwise(
        F.map_zip_with(F.coalesce("header", F.create_map().cast("map<string,string>")), upd,
                       lambda k, v1, v2: F.when(F.map_contains_key(upd, k), v2).otherwise(v1)))
    raw = F.when(has(UPDATED_DATE), upd.getItem(UPDATED_DATE)).when(has("date"), upd.getItem("date"))
    dated = has(UPDATED_DATE) | has("date")
    changed = {
        "title": F.when(has("title"), upd.getItem("title")).otherwise(F.col("title")),
        "author": F.when(has("author"), upd.getItem("author")).otherwise(F.col("author")),
        "publish_date_raw": F.when(dated, raw).otherwise(F.col("publish_date_raw")),
        "publish_date": F.when(dated, F.try_to_timestamp(raw, F.lit(DATE_FORMAT))).otherwise(F.col("publish_date")),
        "header": merged}
    new = j.select(*[changed[c].alias(c) if c in changed else c for c in articles.columns])
    ids = updates.select("article_id").distinct()
    n = count_upto(ids, MAX_BROADCAST_ROWS)
    report = lookup_join(ids, articles.select(F.col("article_id").alias("_aid"), F.lit(True).alias("found")),
                         "article_id", "_aid", small_is_bounded=n <= MAX_BROADCAST_ROWS) \
        .select("article_id", F.coalesce("found", F.lit(False)).alias("found"))
    return new, report


def delete_articles(articles: DataFrame, deletes: DataFrame) -> DataFrame:
    """Everything except the deleted ids (anti join)."""
    ids = deletes.select("article_id")
    small = count_upto(ids, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
    return articles.join(maybe_broadcast(ids, small), "article_id", "left_anti")


def snapshot_path(base: str, version: int) -> str:
    return os.path.join(base, f"v{version:06d}")
