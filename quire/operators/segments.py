"""A stored text index that is looked up by term.

Layout below a base folder, each a Parquet table partitioned by segment:

``postings``  ``part, term, block, entries array<struct<article_id, tf, dl>>``:
              the postings of a term in a block of ``BLOCK`` articles. ``part``
              is a hash bucket of the term, a partition folder, and files are
              sorted by (term, block): the scan opens only the parts of a batch's
              terms and skips row groups without them, and a term of many
              articles is cut into blocks that range partitioning spreads over
              files.
``blocks``    ``part, term, block, n, max_tf, min_dl``: the block directory.
``terms``     ``term, df``.
``docs``      ``article_id, dl, block, terms``: term vectors, for updates.

A segment is never changed. ``add`` writes one for the new and changed articles
and tombstones for their earlier versions; ``remove`` writes tombstones only.
Both read the changed articles' vectors and no other text or postings, and store
the terms that tombstoned articles take out of the counts, so that N, avgdl and
df are those of a rebuild. ``compact`` merges all segments into one. The list of
segments and tombstones is a manifest in a versioned log (``versions``), so a
reader keeps its version and two writers lose nothing.

**Exact top-k with pruning.** Articles are put into blocks by length. For a
query, a block can give no article more than the sum over its terms of
``idf * impact(max_tf, min_dl)``, as the impact grows with tf and falls with dl.
The ``FIRST`` blocks of greatest bound are scored, and the k-th score found there
is the query's threshold. The terms that can add least, and together less than
the threshold, find no article that the others don't: only the others' postings
are read. Articles whose sum over those can still reach the threshold are scored
whole by their term vectors. Rows are those of ``bm25_topk``.

**Filters.** With a table of allowed articles (F3), the threshold is set by blocks
that have one, and only allowed articles are scored whole.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import versions
from .index import build_index
from .search import B, K1, SCORE_DIGITS, query_term_table, rank_within
from .sizing import MAX_BROADCAST_ROWS, count_upto, maybe_broadcast

BLOCK = 128  # articles
PARTS = 16  # folders by hash of the term
NAMED_TERMS = 2_000  # up to so many terms of a batch are named in the scans' filters; beyond, only their parts
FIRST = 4  # blocks of a query that set its threshold

_POSTINGS = "term STRING, block BIGINT, entries ARRAY<STRUCT<article_id: STRING, tf: BIGINT, dl: BIGINT>>, seg STRING, part INT"
_BLOCKS = "term STRING, block BIGINT, n BIGINT, max_tf BIGINT, min_dl BIGINT, seg STRING, part INT"
_TERMS = "term STRING, df BIGINT, seg STRING"
_DOCS = "article_id STRING, dl BIGINT, block BIGINT, terms ARRAY<STRUCT<term: STRING, tf: BIGINT>>, seg STRING"
_GONE = "article_id STRING, of STRING, seg STRING"


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


@dataclass
class SegmentIndex:
    """One version of a stored index."""

    spark: SparkSession
    base: str
    version: int
    manifest: dict

    def _read(self, table: str, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        top = os.path.join(self.base, table)
        return self.spark.read.schema(schema).option("basePath", top).parquet(*[f"{top}/seg={n}" for n in names])

    @property
    def segments(self) -> list[str]:
        return [s["name"] for s in self.manifest["segments"]]

    @property
    def postings(self) -> DataFrame:
        """Blocks of postings, those of tombstoned articles among them."""
        return self._read("postings", _POSTINGS, self.segments)

    @property
    def blocks(self) -> DataFrame:
        return self._read("blocks", _BLOCKS, self.segments)

    @property
    def gone(self) -> DataFrame:
        """``article_id, seg`` of tombstoned articles: the segment that holds the dead version."""
        return self._read("gone", _GONE, self.manifest["tombstones"]).select("article_id", F.col("of").alias("seg"))

    @property
    def live(self) -> DataFrame:
        """``article_id, dl, terms, seg, block`` of the articles that the version has."""
        docs = self._read("docs", _DOCS, self.segments)
        return docs.join(self.gone, ["article_id", "seg"], "left_anti") if self.manifest["tombstones"] else docs

    @property
    def term_stats(self) -> DataFrame:
        counts = self._read("terms", _TERMS, self.segments).unionByName(self._read("gone_terms", _TERMS, self.manifest["tombstones"]))
        return counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def n_docs(self) -> int:
        """Articles with at least one token."""
        return sum(s["n_docs"] for s in self.manifest["segments"]) - self.manifest["gone_docs"]

    @property
    def avgdl(self) -> float | None:
        length = sum(s["length"] for s in self.manifest["segments"]) - self.manifest["gone_length"]
        return length / self.n_docs if self.n_docs else None


def _write_segment(doc_terms: DataFrame, base: str, parts: int) -> dict:
    """Writes the tables of a segment; its entry in the manifest. Articles are numbered by length within their tasks and
    cut into blocks, so a block is of one task and its postings meet without leaving it."""
    spark, name = doc_terms.sparkSession, uuid.uuid4().hex[:16]

    def path(table: str) -> str:
        return os.path.join(base, table, f"seg={name}")

    ordered = doc_terms.sortWithinPartitions("dl", "article_id")
    ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)).select("article_id", "dl", "block", "terms").write.parquet(path("docs"))
    docs = spark.read.schema(_DOCS).parquet(path("docs"))
    entries = docs.select("article_id", "dl", "block", F.inline_outer("terms")).where("term is not null")
    # the one shuffle of the postings: blocks are collected in the range that they're written from
    entries = entries.withColumn("part", _part(F.col("term"), parts)).repartitionByRange("part", "term", "block")
    blocks = entries.groupBy("part", "term", "block").agg(F.sort_array(F.collect_list(F.struct("article_id", "tf", "dl"))).alias("entries"))
    blocks = blocks.select("term", "block", "entries", "part").sortWithinPartitions("part", "term", "block")
    blocks.write.partitionBy("part").parquet(path("postings"))
    stored = spark.read.schema(_POSTINGS).parquet(path("postings"))
    directory = stored.select("term", "block", F.size("entries").cast("long").alias("n"), F.array_max("entries.tf").alias("max_tf"),
                              F.array_min("entries.dl").alias("min_dl"), "part")
    directory.write.partitionBy("part").parquet(path("blocks"))
    spark.read.schema(_BLOCKS).parquet(path("blocks")).groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(path("terms"))
    row = docs.agg(F.count_if(F.col("dl") > 0).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    # an id should have one row; how many it has at most is known, as bounds on an article's score depend on it
    most = docs.groupBy("article_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    return {"name": name, "n_docs": row["n"], "length": row["length"], "rows_of_an_id": most}


def _tombstones(index: SegmentIndex, ids: DataFrame) -> dict | None:
    """Writes tombstones of the live articles among ``ids``; their entry, or None where there are none."""
    spark, name = index.spark, uuid.uuid4().hex[:16]
    ids = ids.select("article_id").distinct()
    small = count_upto(ids, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
    dead = index.live.join(maybe_broadcast(ids, small), "article_id", "left_semi")
    gone = os.path.join(index.base, "gone", f"seg={name}")
    dead.select("article_id", F.col("seg").alias("of")).write.parquet(gone)
    stored = spark.read.schema(_GONE).parquet(gone).select("article_id", F.col("of").alias("seg"))
    small = count_upto(stored, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS
    dead = index._read("docs", _DOCS, index.segments).join(maybe_broadcast(stored, small), ["article_id", "seg"], "left_semi")
    (dead.select(F.inline_outer("terms")).where("term is not null").groupBy("term").agg((-F.count("*")).alias("df"))
     .write.parquet(os.path.join(index.base, "gone_terms", f"seg={name}")))
    row = dead.agg(F.count("*").alias("rows"), F.count_if(F.col("dl") > 0).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    return {"name": name, "n_docs": row["n"], "length": row["length"]} if row["rows"] else None


def open_index(spark: SparkSession, base: str, version: int | None = None) -> SegmentIndex:
    """The newest version, or a given one."""
    if version is not None:
        found = versions.read(spark, base, version)
        number = version
    else:
        number, found = versions.latest(spark, base)
    if found is None:
        raise FileNotFoundError(f"no index at {base}")
    return SegmentIndex(spark, base, number, found)


def add(articles: DataFrame, base: str, fields: tuple[str, ...] = ("content",), parts: int = PARTS) -> SegmentIndex:
    """Indexes new and changed ``articles`` (``article_id`` and ``fields``; one row for an id); a new base folder begins
    with the ``fields`` and ``parts`` given, an existing one keeps its own. Only these articles are read."""
    spark = articles.sparkSession
    _, now = versions.latest(spark, base)
    fields, parts = (tuple(now["fields"]), now["parts"]) if now else (tuple(fields), parts)
    # numbered as they are written, once: all else is read from the vectors written
    shuffled = articles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "article_id")
    entry = _write_segment(build_index(shuffled, fields).doc_terms, base, parts)
    vectors = spark.read.schema(_DOCS).parquet(os.path.join(base, "docs", f"seg={entry['name']}"))

    def next_manifest(found: dict | None) -> dict:
        after = dict(found or {"segments": [], "tombstones": [], "gone_docs": 0, "gone_length": 0, "fields": list(fields), "parts": parts})
        if found and found["segments"]:
            after = _with(after, _tombstones(SegmentIndex(spark, base, 0, found), vectors))
        return after | {"segments": [*after["segments"], entry]}

    return SegmentIndex(spark, base, *versions.change(spark, base, next_manifest))


def _with(manifest: dict, dead: dict | None) -> dict:
    if dead is None:
        return manifest
    return manifest | {"tombstones": [*manifest["tombstones"], dead["name"]], "gone_docs": manifest["gone_docs"] + dead["n_docs"],
                       "gone_length": manifest["gone_length"] + dead["length"]}


def remove(spark: SparkSession, base: str, ids: DataFrame) -> SegmentIndex:
    """Takes the articles with these ids out; ids that the index doesn't hold are passed over."""

    def next_manifest(found: dict | None) -> dict | None:
        if found is None:
            raise FileNotFoundError(f"no index at {base}")
        dead = _tombstones(SegmentIndex(spark, base, 0, found), ids)
        return _with(found, dead) if dead else None

    return SegmentIndex(spark, base, *versions.change(spark, base, next_manifest))


def compact(spark: SparkSession, base: str) -> SegmentIndex:
    """One segment without tombstones in place of all; earlier versions keep their files. Reads the term vectors, no text."""

    def next_manifest(found: dict | None) -> dict | None:
        if found is None:
            raise FileNotFoundError(f"no index at {base}")
        if len(found["segments"]) < 2 and not found["tombstones"]:
            return None
        live = SegmentIndex(spark, base, 0, found).live.select("article_id", "dl", "terms")
        # shuffled by id, as at a build
        entry = _write_segment(live.repartition("article_id"), base, found["parts"])
        return found | {"segments": [entry], "tombstones": [], "gone_docs": 0, "gone_length": 0}

    return SegmentIndex(spark, base, *versions.change(spark, base, next_manifest))


def _impact(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass
class Weighted:
    """A batch's ``query_id, term, idf, part``, whether it was proven small enough to broadcast, and what a scan of the
    index needs to read for it."""

    terms: DataFrame
    small: bool
    where: Column


def weighted_terms(queries: DataFrame, index: SegmentIndex, text_col: str = "query",
                   max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> Weighted:
    """The query terms that the index has."""
    terms = query_term_table(queries, text_col)
    small = count_upto(terms, max_broadcast_rows) <= max_broadcast_rows
    known = index.term_stats.join(maybe_broadcast(terms, small), "term")
    idf = F.log(1.0 + (index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = cut_lineage(known.select("query_id", "term", idf.alias("idf"), _part(F.col("term"), index.manifest["parts"]).alias("part")))
    # at most NAMED_TERMS strings, or a number for each part, reach the driver
    named = [r["term"] for r in weighted.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    where = F.col("part").isin([r["part"] for r in weighted.select("part").distinct().collect()])
    return Weighted(weighted, small, where & F.col("term").isin(named) if len(named) <= NAMED_TERMS else where)


def block_bounds(weighted: Weighted, index: SegmentIndex, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, seg, block, bound, n``: the most that an article of a block can score, and how many postings match there."""
    found = index.blocks.where(weighted.where).join(maybe_broadcast(weighted.terms, weighted.small), ["part", "term"])
    most = F.col("idf") * _impact(F.col("max_tf"), F.col("min_dl"), index.avgdl, k1, b)
    return found.groupBy("query_id", "seg", "block").agg(F.sum(most).alias("bound"), F.sum("n").alias("n"))


def block_scores(chosen: DataFrame, weighted: Weighted, index: SegmentIndex, k1: float = K1, b: float = B,
                 max_broadcast_rows: int = MAX_BROADCAST_ROWS, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, article_id, score`` of the live articles in the ``chosen`` (``query_id, seg, block``) blocks; with
    ``allowed`` (``article_id, seg, block``) of those alone."""
    wanted = cut_lineage(chosen.select("query_id", "seg", "block").join(maybe_broadcast(weighted.terms, weighted.small), "query_id"))
    few = count_upto(wanted, max_broadcast_rows) <= max_broadcast_rows
    met = index.postings.where(weighted.where).join(maybe_broadcast(wanted, few), ["part", "term", "seg", "block"])
    pairs = met.select("query_id", "seg", "idf", F.inline("entries"))
    if allowed is not None:
        ids = allowed.select("article_id", "seg")
        pairs = pairs.join(maybe_broadcast(ids, count_upto(ids, max_broadcast_rows) <= max_broadcast_rows), ["article_id", "seg"], "left_semi")
    weight = F.col("idf") * _impact(F.col("tf"), F.col("dl"), index.avgdl, k1, b)
    sums = pairs.groupBy("query_id", "seg", "article_id").agg(F.sum(weight).alias("w"))
    if index.manifest["tombstones"]:
        gone = index.gone
        sums = sums.join(maybe_broadcast(gone, count_upto(gone, max_broadcast_rows) <= max_broadcast_rows), ["article_id", "seg"], "left_anti")
    return sums.select("query_id", "article_id", F.round("w", SCORE_DIGITS).alias("score"))


def segment_topk(queries: DataFrame, index: SegmentIndex, k: int = 10, k1: float = K1, b: float = B, text_col: str = "query",
                 max_broadcast_rows: int = MAX_BROADCAST_ROWS, only: DataFrame | None = None) -> DataFrame:
    """The top ``k`` articles of each query, ``query_id, article_id, score, rank``, as ``bm25_topk`` gives them;
    F3: among the articles of ``only`` (``article_id``), with the statistics of the whole corpus."""
    if not index.n_docs:
        return index.spark.createDataFrame([], "query_id long, article_id string, score double, rank long")
    weighted = weighted_terms(queries, index, text_col, max_broadcast_rows)
    bounds, allowed = block_bounds(weighted, index, k1, b), None
    if only is not None:
        ids = only.select("article_id").distinct()
        small = count_upto(ids, max_broadcast_rows) <= max_broadcast_rows
        allowed = cut_lineage(index.live.select("article_id", "seg", "block").join(maybe_broadcast(ids, small), "article_id", "left_semi"))
        places = allowed.select("seg", "block").distinct()
        bounds = bounds.join(maybe_broadcast(places, count_upto(places, max_broadcast_rows) <= max_broadcast_rows), ["seg", "block"], "left_semi")
    needed = _needed(_threshold(_first_scores(bounds, weighted, index, k1, b, max_broadcast_rows, allowed), k), weighted, index, k1, b, max_broadcast_rows)
    return rank_within(_candidate_scores(needed, weighted, index, k, k1, b, max_broadcast_rows, allowed), k)


def _first(bounds: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "block")
    return bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST)


def _first_scores(bounds: DataFrame, weighted: Weighted, index: SegmentIndex, k1: float, b: float,
                  max_broadcast_rows: int, allowed: DataFrame | None = None) -> DataFrame:
    return block_scores(_first(bounds), weighted, index, k1, b, max_broadcast_rows, allowed)


def _threshold(scores: DataFrame, k: int) -> DataFrame:
    """``query_id, least``: a score that the ``k``-th best article has at least; no row where none is known."""
    return cut_lineage(rank_within(scores, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))


def _needed(threshold: DataFrame, weighted: Weighted, index: SegmentIndex, k1: float, b: float, max_broadcast_rows: int) -> DataFrame:
    """``query_id, term, idf, part, slack, least``: of each query the terms without which no article reaches its threshold.
    The others, those that can add least, add up to ``slack`` at most."""
    most = index.blocks.where(weighted.where).groupBy("term").agg(F.max(_impact(F.col("max_tf"), F.col("min_dl"), index.avgdl, k1, b)).alias("most"))
    rows_of_an_id = max([1, *(s.get("rows_of_an_id", 1) for s in index.manifest["segments"])])
    small = count_upto(threshold, max_broadcast_rows) <= max_broadcast_rows  # a row for each query at most
    terms = most.join(maybe_broadcast(weighted.terms, weighted.small), "term").join(maybe_broadcast(threshold, small), "query_id", "left")
    terms = terms.withColumn("most", F.col("idf") * F.col("most") * rows_of_an_id)
    adding = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    # a score is rounded and the bound is a sum of another order: a margin of a last digit
    spare = F.col("upto") + _MARGIN < F.col("least")
    terms = terms.withColumn("upto", F.sum("most").over(adding)).withColumn("spare", F.coalesce(spare, F.lit(False)))
    slack = F.coalesce(F.max(F.when(F.col("spare"), F.col("upto"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    return cut_lineage(terms.withColumn("slack", slack).where("not spare").select("query_id", "term", "idf", "part", "slack", "least"))


_MARGIN = 2 * 10.0 ** -SCORE_DIGITS


def _candidate_scores(needed: DataFrame, weighted: Weighted, index: SegmentIndex, k: int, k1: float, b: float,
                      max_broadcast_rows: int, allowed: DataFrame | None) -> DataFrame:
    """``query_id, article_id, score`` of the live articles that can reach their query's threshold: found by the postings
    of the ``needed`` terms, and scored by their term vectors."""
    small = count_upto(needed, max_broadcast_rows) <= max_broadcast_rows
    met = index.postings.where(weighted.where).join(maybe_broadcast(needed, small), ["part", "term"])
    pairs = met.select("query_id", "seg", "idf", "slack", "least", F.inline("entries"))
    weight = F.col("idf") * _impact(F.col("tf"), F.col("dl"), index.avgdl, k1, b)
    sums = pairs.groupBy("query_id", "seg", "article_id").agg(F.sum(weight).alias("w"), F.first("slack").alias("slack"), F.first("least").alias("least"))
    can = F.col("least").isNull() | (F.col("w") + F.col("slack") + _MARGIN >= F.col("least"))
    found = sums.where(can).select("query_id", "seg", "article_id", "w", "slack")
    if allowed is not None:
        found = found.join(allowed.select("article_id", "seg").distinct(), ["article_id", "seg"], "left_semi")
    if index.manifest["tombstones"]:
        gone = index.gone
        found = found.join(maybe_broadcast(gone, count_upto(gone, max_broadcast_rows) <= max_broadcast_rows), ["article_id", "seg"], "left_anti")
    found = cut_lineage(found)
    # where all terms of a query are needed, the sum is the score
    whole = found.where("slack = 0").select("query_id", "article_id", "w")
    found = found.where("slack > 0")
    # the best sums' whole scores are a better threshold than that of the first blocks
    best = rank_within(found.withColumn("score", F.col("w")), 2 * k).select("query_id", "seg", "article_id")
    better = _threshold(_whole_scores(best, weighted, index, k1, b, max_broadcast_rows), k)
    small = count_upto(better, max_broadcast_rows) <= max_broadcast_rows
    found = found.join(maybe_broadcast(better, small), "query_id", "left")
    found = found.where(F.col("least").isNull() | (F.col("w") + F.col("slack") + _MARGIN >= F.col("least")))
    scored = _whole_scores(found.select("query_id", "seg", "article_id"), weighted, index, k1, b, max_broadcast_rows)
    return scored.unionByName(whole.select("query_id", "article_id", F.round("w", SCORE_DIGITS).alias("score")))


def _whole_scores(found: DataFrame, weighted: Weighted, index: SegmentIndex, k1: float, b: float, max_broadcast_rows: int) -> DataFrame:
    """``query_id, article_id, score`` of ``query_id, seg, article_id``, by the articles' term vectors."""
    found = cut_lineage(found.select("query_id", F.col("seg").alias("_seg"), F.col("article_id").alias("_id")))
    few = count_upto(found, max_broadcast_rows) <= max_broadcast_rows
    docs = index._read("docs", _DOCS, index.segments)
    vectors = docs.join(maybe_broadcast(found, few), docs["article_id"].eqNullSafe(F.col("_id")) & (docs["seg"] == F.col("_seg")))
    entries = vectors.select("query_id", "seg", "article_id", "dl", F.inline("terms"))
    weights = entries.join(maybe_broadcast(weighted.terms.select("query_id", "term", "idf"), weighted.small), ["query_id", "term"])
    scored = weights.groupBy("query_id", "seg", "article_id").agg(F.sum(F.col("idf") * _impact(F.col("tf"), F.col("dl"), index.avgdl, k1, b)).alias("w"))
    return scored.select("query_id", "article_id", F.round("w", SCORE_DIGITS).alias("score"))


def postings_read(queries: DataFrame, index: SegmentIndex, k: int = 10, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> tuple[int, int]:
    """How many (query, posting) pairs ``segment_topk`` scores before it knows the candidates, and how many match."""
    weighted = weighted_terms(queries, index, max_broadcast_rows=max_broadcast_rows)
    bounds = cut_lineage(block_bounds(weighted, index))
    threshold = _threshold(_first_scores(bounds, weighted, index, K1, B, max_broadcast_rows), k)
    needed = _needed(threshold, weighted, index, K1, B, max_broadcast_rows)
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return total(_first(bounds)) + total(index.blocks.join(needed, ["part", "term"])), total(bounds)
