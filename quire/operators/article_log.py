"""An article store that grows by what an import changes (K5, K8, K9, ST1, S6).

Below a base folder, ``rows`` holds immutable segments of article rows with the
digests that an import compares, and ``gone`` the (file name, segment) pairs that
later changes have replaced or deleted. A change writes one segment with the new
rows and one of tombstones, and commits both as a version of the log
(``versions``): nothing written earlier is read whole or written again. A reader
merges them: all segments of its version without the tombstoned rows. ``compact``
writes the merged rows as one segment.

An import looks its files up by reading only keys and digests of the stored
rows, never their texts. Several writers, batches and streams, may change one
store at a time: each commits on the version that it has read or starts again.
A stream's last epoch is part of the manifest, so an epoch that runs again after
its commit changes nothing, and the record doesn't grow with the epochs.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARTICLES
from ..session import cut_lineage
from ..sources.tables import conform_articles
from . import store, versions
from .sizing import MAX_BROADCAST_ROWS, count_upto, maybe_broadcast

DIGESTED = ("content", "title", "author")
_ROWS = T.StructType([*ARTICLES.fields, *[T.StructField(f"{c}_digest", T.StringType()) for c in DIGESTED], T.StructField("seg", T.StringType())])
_GONE = "filename STRING, of STRING, seg STRING"
_KEYS = ["article_id", "filename", "publish_date", "created_at", *[f"{c}_digest" for c in DIGESTED], "seg"]
_NEW = {"segments": [], "tombstones": [], "streams": {}}


@dataclass
class ArticleLog:
    """One version of a store."""

    spark: SparkSession
    base: str
    version: int
    manifest: dict

    def _read(self, table: str, schema, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        top = os.path.join(self.base, table)
        return self.spark.read.schema(schema).option("basePath", top).parquet(*[f"{top}/seg={e['name']}" for e in entries])

    @property
    def _live(self) -> DataFrame:
        rows, dead = self._read("rows", _ROWS, self.manifest["segments"]), self.manifest["tombstones"]
        if not dead:
            return rows
        gone = self._read("gone", _GONE, dead).select("filename", F.col("of").alias("seg"))
        # names and segment names, whose number the manifest knows
        return rows.join(maybe_broadcast(gone, sum(e["rows"] for e in dead) <= MAX_BROADCAST_ROWS), ["filename", "seg"], "left_anti")

    @property
    def articles(self) -> DataFrame:
        return conform_articles(self._live)

    @property
    def keys(self) -> DataFrame:
        """The live rows' keys and digests."""
        return self._live.select(_KEYS)

    def files(self) -> list[str]:
        """The folders that the version is made of."""
        return sorted([*(f"rows/seg={e['name']}" for e in self.manifest["segments"]), *(f"gone/seg={e['name']}" for e in self.manifest["tombstones"])])


def open_log(spark: SparkSession, base: str, version: int | None = None) -> ArticleLog:
    """The newest version (a store without rows, if there is none), or a given one."""
    if version is None:
        number, found = versions.latest(spark, base)
        return ArticleLog(spark, base, number, found or _NEW)
    if (found := versions.read(spark, base, version)) is None:
        raise FileNotFoundError(f"{base} has no version {version}")
    return ArticleLog(spark, base, version, found)


def _write(df: DataFrame, base: str, table: str) -> dict | None:
    """Writes a segment; its entry, or None where it has no rows."""
    name = uuid.uuid4().hex[:16]
    path = os.path.join(base, table, f"seg={name}")
    df.write.mode("errorifexists").parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).count()
    return {"name": name, "rows": rows} if rows else None


def _write_rows(articles: DataFrame, base: str) -> dict | None:
    digests = {f"{c}_digest": F.sha2(F.col(c).cast("binary"), 256) for c in DIGESTED}
    return _write(conform_articles(articles).withColumns(digests), base, "rows")


def _replaced(log: ArticleLog, names: DataFrame) -> dict | None:
    """Tombstones of the live rows with these file names."""
    small = count_upto(names.select("filename"), MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
    dead = log.keys.join(maybe_broadcast(names.select("filename"), small), "filename", "left_semi")
    return _write(dead.select("filename", F.col("seg").alias("of")), log.base, "gone")


def _after(manifest: dict, rows: dict | None, gone: dict | None) -> dict:
    return manifest | {"segments": manifest["segments"] + ([rows] if rows else []), "tombstones": manifest["tombstones"] + ([gone] if gone else [])}


def import_into(spark: SparkSession, base: str, incoming: DataFrame, run_ts: str, compare: str = "content",
                stream: tuple[str, int] | None = None) -> tuple[ArticleLog, DataFrame | None]:
    """K5: upserts a parse result; the version and the classified rows (see ``store.classify_import``). ``stream``: the
    key of a streaming query and its epoch; an epoch that the store already has changes nothing and gives None for rows."""
    incoming = cut_lineage(store.one_per_name(incoming))
    n, done = incoming.count(), {}

    def change(found: dict | None) -> dict | None:
        now = found or _NEW
        done.clear()
        if stream and now["streams"].get(stream[0], -1) >= stream[1]:
            return None
        log = ArticleLog(spark, base, 0, now)
        rows = done["rows"] = cut_lineage(store.classify_import(log.keys, incoming, run_ts, compare, incoming_bound=n))
        changed = _write_rows(rows.where(F.col("action").isin("insert", "update")), base)
        after = _after(now, changed, _replaced(log, rows.where("action = 'update'")) if changed else None)
        if stream:
            return after | {"streams": now["streams"] | {stream[0]: stream[1]}}
        return after if changed else None

    number, manifest = versions.change(spark, base, change)
    return ArticleLog(spark, base, number, manifest or _NEW), done.get("rows")


def update(spark: SparkSession, base: str, updates: DataFrame, order_col: str | None = None) -> tuple[ArticleLog, DataFrame]:
    """K8 on the store: writes the touched articles only; the version and the report."""
    report = {}

    def change(found: dict | None) -> dict | None:
        log = ArticleLog(spark, base, 0, found or _NEW)
        ids = updates.select("article_id").distinct()
        small = count_upto(ids, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
        touched = cut_lineage(log.articles.join(maybe_broadcast(ids, small), "article_id", "left_semi"))
        new, report["rows"] = store.update_metadata(touched, updates, order_col)
        rows = _write_rows(new, base)
        return _after(log.manifest, rows, _replaced(log, touched)) if rows else None

    number, manifest = versions.change(spark, base, change)
    return ArticleLog(spark, base, number, manifest or _NEW), report["rows"]


def delete(spark: SparkSession, base: str, ids: DataFrame) -> ArticleLog:
    """K9 on the store: writes tombstones only."""

    def change(found: dict | None) -> dict | None:
        log = ArticleLog(spark, base, 0, found or _NEW)
        small = count_upto(ids, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
        names = log.keys.join(maybe_broadcast(ids.select("article_id"), small), "article_id", "left_semi")
        gone = _replaced(log, cut_lineage(names.select("filename")))
        return _after(log.manifest, None, gone) if gone else None

    number, manifest = versions.change(spark, base, change)
    return ArticleLog(spark, base, number, manifest or _NEW)


def compact(spark: SparkSession, base: str) -> ArticleLog:
    """One segment without tombstones in place of all; earlier versions keep their files."""

    def change(found: dict | None) -> dict | None:
        if not found or len(found["segments"]) + len(found["tombstones"]) < 2:
            return None
        rows = _write_rows(ArticleLog(spark, base, 0, found).articles, base)
        return found | {"segments": [rows] if rows else [], "tombstones": []}

    number, manifest = versions.change(spark, base, change)
    return ArticleLog(spark, base, number, manifest or _NEW)
