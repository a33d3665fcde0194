"""Fixed table schemas. Nothing in the engine infers a schema."""

from pyspark.sql import types as T

RAW_FILES = T.StructType([
    T.StructField("path", T.StringType(), True),
    T.StructField("filename", T.StringType(), False),
    T.StructField("content", T.BinaryType(), True),
])

ARTICLES = T.StructType([
    T.StructField("article_id", T.StringType(), False),
    T.StructField("filename", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("publish_date", T.TimestampType(), True),
    T.StructField("publish_date_raw", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("header", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("last_updated", T.TimestampType(), True),
])

BARE_DOCUMENTS = T.StructType([T.StructField("content", T.StringType(), True)])

IMPORT_ERRORS = T.StructType([
    T.StructField("filename", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("query", T.StringType(), True),
])

HITS = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("article_id", T.StringType(), False),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("rank", T.LongType(), False),
])

SOURCE = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("publish_date", T.StringType(), True),
])

EXCERPT = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("excerpt", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
])

UPDATES = T.StructType([
    T.StructField("article_id", T.StringType(), False),
    T.StructField("updates", T.MapType(T.StringType(), T.StringType()), True),
])

DELETES = T.StructType([T.StructField("article_id", T.StringType(), False)])
