"""Listing, paging and lookup.

Paging uses ``orderBy(...).offset(o).limit(n)``, which Spark runs as a
per-partition top-(o+n) and a merge (``TakeOrderedAndProject``) — never a
global ``row_number`` that would pull every row into one task. For deep pages
``keyset_page`` continues after a cursor and only reads rows past it, and
``ranked_page`` opens only the files of its page in a store written in order.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARTICLES
from ..sources.archive import literal_path
from ..sources.tables import conform_articles

# Fixed values of the services.
DEFAULT_TITLE = "Untitled"
DEFAULT_AUTHOR = "Unknown"
PAGE_DEFAULT, LIMIT_DEFAULT, LIMIT_MAX = 1, 10, 50
PREVIEW_CHARS = {"local": 2000, "test": 500, "production": None}


def with_default(c: str, default: str | None) -> Column:
    """A default for a missing value only; an empty string stays."""
    return F.coalesce(F.col(c), F.lit(default)) if default is not None else F.col(c)


def newest_first() -> list[Column]:
    """L1: ``publish_date`` descending, nulls last; ``article_id`` breaks ties."""
    return [F.col("publish_date").desc_nulls_last(), F.col("article_id").asc()]


def store_order() -> list[Column]:
    return [F.col("article_id").asc()]


def check_page(page: int, limit: int, max_limit: int | None = LIMIT_MAX) -> None:
    if not isinstance(page, int) or page < 1:
        raise ValueError("page must be an integer >= 1")
    if not isinstance(limit, int) or limit < 1 or (max_limit is not None and limit > max_limit):
        raise ValueError(f"limit must be an integer in 1..{max_limit}")


def list_projection(articles: DataFrame, preview: int | None = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """R2 (list) / R3 (detail, ``preview=None``) with R1 defaults and R4 ids;
    ``keep`` names further columns to hand on, such as a page's."""
    content = F.col("content") if preview is None else F.left(F.col("content"), F.lit(preview))
    return articles.select(
        F.col("article_id").cast("string").alias("id"),
        with_default("title", DEFAULT_TITLE).alias("title"),
        content.alias("content"),
        F.col("publish_date_raw").alias("publish_date"),
        with_default("author", DEFAULT_AUTHOR).alias("author"),
        *keep,
    )


def page(articles: DataFrame, page_no: int = PAGE_DEFAULT, limit: int = LIMIT_DEFAULT,
         order: list[Column] | None = None, max_limit: int | None = LIMIT_MAX) -> DataFrame:
    """L2: one page plus ``total`` (A1), ``page`` and ``limit`` columns; newest first unless another ``order`` is given.
    ``limit`` is 1 to ``max_limit`` in any order."""
    check_page(page_no, limit, max_limit)
    total = articles.select(F.count(F.lit(1)).cast("long")).scalar()
    rows = articles.orderBy(*(order or newest_first())).offset((page_no - 1) * limit).limit(limit)
    return rows.select("*", total.alias("total"), F.lit(page_no).alias("page"), F.lit(limit).alias("limit"))


def store_page(articles: DataFrame, page_no: int = PAGE_DEFAULT, limit: int = LIMIT_DEFAULT) -> DataFrame:
    """L3: one page in store order, whose limit has no bound of its own."""
    return page(articles, page_no, limit, store_order(), max_limit=None)


def keyset_page(articles: DataFrame, after: tuple | None, limit: int = LIMIT_DEFAULT) -> DataFrame:
    """Scalable newest-first page: rows strictly after the cursor
    ``(publish_date, article_id)`` of the previous page's last row."""
    df = articles
    if after is not None:
        d, aid = after
        if d is None:
            df = df.filter(F.col("publish_date").isNull() & (F.col("article_id") > aid))
        else:
            ts = F.lit(d).cast("timestamp")
            df = df.filter(F.col("publish_date").isNull() | (F.col("publish_date") < ts)
                           | ((F.col("publish_date") == ts) & (F.col("article_id") > aid)))
    return df.orderBy(*newest_first()).limit(limit)


def write_ranked(articles: DataFrame, path: str, partitions: int | None = None) -> str:
    """K11 with a rank directory: the articles in newest-first order, a range of it in each file, and a table of the
    files with how many rows each holds. ``ranked_page`` then opens only the files of its page."""
    keys = [F.col("publish_date").desc_nulls_last(), F.col("article_id").asc()]
    rows = conform_articles(articles)
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    rows.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(os.path.join(path, "rows"))
    stored = articles.sparkSession.read.schema(rows.schema).parquet(literal_path(os.path.join(path, "rows")))
    # a file's name begins with its partition's number; a partition may be written as several files, numbered at the end
    name = F.substring_index(F.input_file_name(), "/", -1)
    files = stored.select(name.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    files.coalesce(1).write.mode("errorifexists").parquet(os.path.join(path, "files"))
    return path


def ranked_page(spark: SparkSession, path: str, page_no: int = PAGE_DEFAULT, limit: int = LIMIT_DEFAULT,
                max_limit: int | None = LIMIT_MAX) -> DataFrame:
    """L2 over ``write_ranked``: the rows of ``page``, from the few files that hold them, at any depth."""
    check_page(page_no, limit, max_limit)
    # a row for each file, not for its articles
    files = spark.read.schema("file string, n long").parquet(literal_path(os.path.join(path, "files")))
    upto = F.sum("n").over(Window.orderBy(F.regexp_extract("file", "[0-9]+", 0).cast("long"), "file"))
    files = files.select("file", "n", upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    first = (page_no - 1) * limit
    found = files.where((F.col("upto") > first) & (F.col("upto") - F.col("n") < first + limit)).orderBy("upto").collect()
    if not found:
        return spark.createDataFrame([], T.StructType([*ARTICLES.fields, T.StructField("total", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("page", "limit")]]))
    rows = spark.read.schema(ARTICLES).parquet(*[literal_path(os.path.join(path, "rows", r["file"])) for r in found])
    before = found[0]["upto"] - found[0]["n"]
    rows = rows.orderBy(*newest_first()).offset(first - before).limit(limit)
    return rows.select("*", F.lit(found[0]["total"]).cast("long").alias("total"), F.lit(page_no).alias("page"), F.lit(limit).alias("limit"))


def lookup(articles: DataFrame, ids: DataFrame, preview: int | None = None) -> DataFrame:
    """F1 + R3: one row per requested id; ``found`` tells a missing article
    apart from an empty one."""
    from .sizing import MAX_BROADCAST_ROWS, count_upto, maybe_broadcast
    detail = list_projection(articles, preview)
    want = ids.select(F.col("article_id").cast("string").alias("id"))
    small = count_upto(want, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
    # only ids are broadcast: the text streams past them, and the ids without
    # an article are found from the id column alone
    found = detail.join(maybe_broadcast(want, small), "id").withColumn("found", F.lit(True))
    held = detail.select("id").join(maybe_broadcast(want.distinct(), small), "id", "left_semi")
    missing = want.join(maybe_broadcast(held, small), "id", "left_anti").withColumn("found", F.lit(False))
    return found.unionByName(missing, allowMissingColumns=True) \
        .select("id", "found", "title", "content", "publish_date", "author")
