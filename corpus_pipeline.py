"""From documents to packed training sequences, in five stages.

``STAGES`` names them in order. Each takes ``(spark, docs, sf_dir)`` and works
on all that the one before it kept; ``run`` writes each result to the shared
folder and reads it back as the next stage's ``docs``.

Nulls, empty texts, repeated rows and empty tables: as each operator's module
says. A null or empty text doesn't pass the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, neardup, packing, quality, secrets
from quire.llm.common import documents, drop, importable, written


#: Tables that a stage's result reads until it's written.
_read_by_result: list[str] = []


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    importable(spark)
    kept, paths = quality.good(docs)
    _read_by_result.extend(paths)
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id. Texts that share an id are judged apart."""
    kept, paths = neardup.one_of_each(docs)
    _read_by_result.extend(paths)
    return kept


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    masked = secrets.redact(docs, secrets.scan(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    split, path = written(packing.pieces(docs), "pieces")
    packed, paths = packing.pack(split)
    _read_by_result.extend([path, *paths])
    return packed


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

# SQL has neither the vocabularies nor the forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
        drop(spark, *_read_by_result, *([last] if last else []))
        _read_by_result.clear()
        last = path
    return docs
