"""Scalar functions: snippet goldens (FIXTURES.md §6), tokens, strip, split."""

from pyspark.sql import functions as F

from quire.functions.text import (file_name_date, py_split_ws, py_strip, snippet, strip_extension,
                                  tokens)


def one(spark, col, **kw):
    df = spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} string" for k in kw))
    return df.select(col.alias("x")).collect()[0]["x"]


def test_snippet_goldens(spark):
    c = "a" * 500 + " Tang"
    assert one(spark, snippet("c", "q"), c=c, q="tang") == "..." + "a" * 99 + " tang..."
    assert one(spark, snippet("c", "q"), c="Tang x", q="TANG") == "...tang x..."
    long = "b" * 1000
    assert one(spark, snippet("c", "q"), c=long, q="zzz") == "..." + "b" * 400 + "..."
    assert one(spark, snippet("c", "q"), c="concatenate", q="cat") == "...concatenate..."
    assert one(spark, snippet("c", "q"), c="b a", q="a b") == "...b a..."


def test_tokens_unicode(spark):
    assert one(spark, tokens(F.col("s")), s="Été, x_1 ÇA-va") == ["été", "x_1", "ça", "va"]


def test_strip_and_split(spark):
    assert one(spark, py_strip(F.col("s")), s=" \t a b \n") == "a b"
    assert one(spark, py_split_ws(F.col("s")), s="  a　b\n\nc ") == ["a", "b", "c"]


def test_file_names(spark):
    assert one(spark, strip_extension(F.col("s")), s="a.b.txt") == "a.b"
    assert one(spark, strip_extension(F.col("s")), s=".txt") == ".txt"
    assert one(spark, file_name_date(F.col("s")), s="x_20061117_y.txt") == "2006-11-17"
    assert one(spark, file_name_date(F.col("s")), s="x_20061117.txt") is None
