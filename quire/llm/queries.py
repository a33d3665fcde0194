"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking, decontaminate, divergence, kneser_ney, neardup, packing, pii, quality, secrets, sharding, tokenfiles, variants, warc
from .common import documents, drop, importable, written
from .oracles import ORACLE_SQL  # noqa: F401


def _finished(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """The result as a written table, so that the tables on the way to it can go."""
    out, _ = written(df, name)
    drop(df.sparkSession, *paths)
    return out


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = kneser_ney.prepared(documents(spark, sf_dir))
    model, paths = kneser_ney.train(texts.where("not held_out").select("text"))
    return _finished(kneser_ney.score(texts, model), "op1", paths)


def op2_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    placed, _, paths = sharding.place_by_bytes(documents(spark, sf_dir), shards)
    rows = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         "virtual_slot", "first_shard")
    return _finished(rows, "op3", paths)


def op4_oph_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, paths = neardup.near_duplicates(documents(spark, sf_dir))
    return _finished(found, "op4", paths)


def op5_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, path = written(packing.pieces(documents(spark, sf_dir)), "pieces")
    packed, paths = packing.pack(split)
    return _finished(packed, "op5", [path, *paths])


def op6_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured, path = written(quality.measures(documents(spark, sf_dir)), "measures")
    bands, bands_path = quality.fit(measured)
    judged = quality.judge(measured, bands)
    rows = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_tokens", "chars_per_token", "byte_share", "token_entropy", "in_band", "outside")
    return _finished(rows, "op6", [path, bands_path])


def op7_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, paths = tokenfiles.round_trip(documents(spark, sf_dir))
    return _finished(rows, "op7", paths)


def op8_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, paths = chunking.repeated_passages(documents(spark, sf_dir))
    return _finished(rows.select("doc_id", "start", "end", "n_chunks", "first_doc_id"), "op8", paths)


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, paths = pii.extract(documents(spark, sf_dir))
    return _finished(rows, "op9", paths)


def op10_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir)).where("is_secret")
    return found.select("doc_id", "nth", "start", "end", F.sha2("value", 256).alias("value_sha256"), "label", F.round("probability", 6).alias("probability"))


def op11_chunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, paths = variants.variants(documents(spark, sf_dir))
    return _finished(found, "op11", paths)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, paths = divergence.audit(documents(spark, sf_dir))
    return _finished(found, "op12", paths)


def op13_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    read, paths = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return _finished(read, "op13", paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_kneser_ney, op2_pigeonhole, op3_virtual_slots, op4_oph_neardup, op5_linear_grouping, op6_tokenizer_fertility,
    op7_rans_files, op8_gear_chunks, op9_bootstrapped_pii, op10_forest_secrets, op11_chunk_variants, op12_source_divergence, op13_warc_members)}
