"""Archive folder scan (S1-S3) and literal sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BARE_DOCUMENTS, RAW_FILES
from .tables import conform_articles

# Fixed value: archive files are the names ending in ``.txt`` (case-sensitive).
ARCHIVE_GLOB = "*.txt"


def _folder(spark: SparkSession, path: str) -> tuple[str | None, bool]:
    """The qualified name of folder ``path`` (None: there is none) and whether
    an archive file lies directly in it, through the Hadoop FileSystem API (any
    cluster file system). The listing ends at the first such file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None, False
    root, entries = fs.makeQualified(p).toString(), fs.listStatusIterator(p)
    while entries.hasNext():
        entry = entries.next()
        name = entry.getPath().getName()
        if entry.isFile() and name.endswith(ARCHIVE_GLOB[1:]) and name[0] not in "_.":
            return root, True
    return root, False


def literal_path(path: str) -> str:
    """``path`` with its glob characters escaped: a reader takes it as it is."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def scan_archive(spark: SparkSession, folder: str, tolerant: bool = False) -> tuple[DataFrame, str | None]:
    """S1 + S3: ``raw_files (path, filename, content)`` for the ``.txt`` files
    directly in ``folder`` (not recursive).

    Returns ``(raw_files, problem)``; on a missing folder or a folder without
    ``.txt`` files the frame is empty (fixed schema) and ``problem`` says why.
    Differences to a plain folder listing: Spark skips names starting with
    ``_`` or ``.``. With ``tolerant``, a file that can't be opened or read is
    left out instead of failing the job; ``parse.unread_files`` names it. (A file
    system's own refusal of access still fails it.)
    """
    root, any_file = _folder(spark, folder)
    if root is None:
        return spark.createDataFrame([], RAW_FILES), f"archive folder is missing: {folder}"
    if not any_file:
        return spark.createDataFrame([], RAW_FILES), f"No .txt file in archive folder: {folder}"
    df = (spark.read.format("binaryFile")
          .option("pathGlobFilter", ARCHIVE_GLOB)
          .option("recursiveFileLookup", "false")
          .option("ignoreMissingFiles", str(tolerant).lower())
          .option("ignoreCorruptFiles", str(tolerant).lower())
          .load(literal_path(folder)))
    # the name comes from the path: _metadata.file_name is percent-encoded
    name = F.substring_index("path", "/", -1)
    return df.select("path", name.alias("filename"), "content") \
        .where(F.col("path") == F.concat(F.lit(root.rstrip("/") + "/"), "filename")), None


def literal_documents(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Documents from an in-code list, content only, no metadata."""
    return spark.createDataFrame([(t,) for t in texts], BARE_DOCUMENTS)


def bare_to_articles(bare: DataFrame) -> DataFrame:
    """Bare documents as articles: id from the content hash, no metadata. Equal
    documents are one article, as an id names one; null and empty are equal."""
    ids = F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 24)
    return conform_articles(bare.groupBy(ids.alias("article_id")).agg(F.max("content").alias("content")))
