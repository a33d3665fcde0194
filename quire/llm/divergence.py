"""Divergence between the sources of a language, by a sparse merge for each pair of sources.

Terms are counted over whole texts by (language, source); a language keeps those
of enough documents. A group's counts are sorted arrays of (term id, count), cut
into blocks of ``BLOCK`` ids. Each unordered pair of groups of a language is
co-grouped on every block: a galloping intersection finds the terms of both,
which are priced together; terms of one side alone are priced against the
other's price of an absent term, and what neither has, by its number. Groups
travel in tiles of ``TILE``, so that a task holds two tiles of one block at
most, whatever the vocabulary, and a group's arrays are sent once for each tile
and not once for each pair. Blocks and tiles make a hot source no different
from any other. All arithmetic is in whole numbers.

A price is ``1 + floor(10^9 (count + 2) / (N + 2 V))``; two prices cost
``floor((p - q)^2 / (p + q))``.

Defined results: null text, language and source are read as empty; a group
without terms gives every kept term the price of an absent one; each row is a
document, so repeated rows count again; a language that keeps no term has pairs
of value 0; equal values are ranked by their items' UTF-8; long texts are read
in pieces that end between terms; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts, written
from .variants import pieces

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
BLOCK_BITS = 14
TILE = 16
HELD = 200_000  # counts that a task holds before it hands them on
STRIDE = 512  # sorted ids that are placed by one leap


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: a term's occurrences in a group and the documents that hold it; the empty
    term stands for the group's documents."""
    letter, outside = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs, holds, held = defaultdict(Counter), defaultdict(Counter), 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in holds.items():
                n = occurs[lang, source]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array([source] * len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()),
                                                  pa.array([n[t] for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                                 names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for rows in slices(batch, "text"):
                for lang, source, text in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), texts(rows, "text")):
                    # bytes have only A-Z lower-cased; a byte from 0x80 on is part of a code point from U+0080 on
                    found = Counter()
                    for piece in pieces(text.lower(), outside):
                        found.update(letter.findall(piece))
                    group = holds[lang, source]
                    held -= len(group)
                    occurs[lang, source].update(found)
                    group.update(found.keys())
                    group[b""] += 1
                    held += len(group)
                if held >= HELD:
                    yield from out()
                    occurs.clear(), holds.clear()
                    held = 0
        yield from out()

    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, total, id``: the terms of at least ``least`` documents of a language, its occurrences of them, and a number for each."""
    totals = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    return totals.where(F.col("docs") >= least).select("lang", "term", "total", F.monotonically_increasing_id().alias("id"))


def price(count: Column, n: Column, v: Column) -> Column:
    """Exact: ``div`` of decimals is that of whole numbers."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", wide(count + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(n + 2 * v))


def cost(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def prices(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """As ``price``, by long division in steps of a thousand, so that no product leaves 64 bits."""
    out, rest, whole = np.zeros(len(counts), np.int64), counts + 2, n + 2 * v
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return 1 + out


def costs(p: np.ndarray, q) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def gallop(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of what two sorted arrays of distinct ids share. For every run of the shorter one, leaps of doubling
    length from where the last run ended find how far it reaches in the longer one; only that part is searched."""
    where, at = np.zeros(len(few), np.int64), 0
    for start in range(0, len(few), STRIDE):
        run, leap = few[start:start + STRIDE], STRIDE
        while at + leap < len(many) and many[at + leap] < run[-1]:
            leap *= 2
        where[start:start + STRIDE] = at + np.searchsorted(many[at:at + leap + 1], run)
        at = int(where[start + len(run) - 1])
    inside = np.flatnonzero(where < len(many))
    found = inside[many[where[inside]] == few[inside]]
    return found, where[found]


def merged(a: dict, b: dict, size: int) -> int:
    """The cost of a block of ``size`` terms between two groups: shared, one-sided both ways, and absent terms."""
    if len(a["ids"]) > len(b["ids"]):
        a, b = b, a
    in_a, in_b = gallop(a["ids"], b["ids"])
    pa_, pb_ = a["prices"], b["prices"]
    to_b, to_a = costs(pa_, b["absent"]), costs(pb_, a["absent"])
    return int(costs(pa_[in_a], pb_[in_b]).sum() + to_b.sum() - to_b[in_a].sum() + to_a.sum() - to_a[in_b].sum()
               + (size - len(pa_) - len(pb_) + len(in_a)) * costs(a["absent"], b["absent"]))


def _groups(table: pa.Table) -> list[dict]:
    out = []
    columns = [table.column(c) for c in ("source", "place", "n", "v", "ids", "counts")]
    for source, place, n, v, ids, counts in zip(*columns):
        n, v = n.as_py(), v.as_py()
        one = {"source": source.as_py(), "place": place.as_py()}
        if v:
            one["ids"] = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int64)
            one["prices"] = prices(counts.values.to_numpy(), n, v) if counts.is_valid else np.zeros(0, np.int64)
            one["absent"] = prices(np.zeros(1, np.int64), n, v)[0]
        out.append(one)
    return sorted(out, key=lambda g: g["place"])


def pair_values(grid: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of all unordered pairs of a language's groups, from a row for each group and block."""
    here = F.col("tile")
    left = grid.withColumn("other", F.explode(F.sequence(here, F.col("tiles") - 1))).withColumn("i", here).withColumn("j", F.col("other"))
    right = grid.withColumn("other", F.explode(F.sequence(F.lit(0), here))).withColumn("i", F.col("other")).withColumn("j", here)

    def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        size = left.column("size")[0].as_py() if left.num_rows else 0
        rows, others = [], _groups(right)
        for a in _groups(left):
            for b in others:
                if a["place"] < b["place"]:
                    rows.append((a["source"], b["source"], merged(a, b, size) if size else 0))
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "a": pa.array([r[0] for r in rows], pa.string()),
                         "b": pa.array([r[1] for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.int64())})

    key = ["lang", "block", "i", "j"]
    columns = [*key, "size", "source", "place", "n", "v", "ids", "counts"]
    found = left.select(columns).groupBy(*key).cogroup(right.select([F.col(c).alias(c) for c in columns]).groupBy(*key)).applyInArrow(task, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS,
          top: int = TOP_TERMS) -> tuple[DataFrame, list[str]]:
    """``lang, source, part, item, value, rank``: how far each group is from the others of its language, and the terms
    that it has most beyond its language; and the paths written."""
    counts, counts_path = written(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    terms, terms_path = written(kept_terms(counts, least), "divergence-terms")
    kept, kept_path = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "id", "n", "total"), "divergence-kept")

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    # a row for each group, not for its documents
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    last = F.max("place").over(Window.partitionBy("lang"))
    groups = groups.withColumn("place", place).withColumn("tile", F.floor(F.col("place") / TILE).cast("int")).withColumn("tiles", F.floor(last / TILE).cast("int") + 1)
    groups, groups_path = written(groups, "divergence-groups")

    block = F.shiftright("id", BLOCK_BITS).alias("block")
    blocks = terms.groupBy("lang", block).agg(F.count("*").alias("size"))
    blocks = blocks.unionByName(groups.where("v = 0").select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("size")))
    arrays = kept.groupBy("lang", "source", block).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("found"))
    arrays = arrays.select("lang", "source", "block", F.col("found.id").alias("ids"), F.col("found.n").alias("counts"))
    grid = groups.join(blocks, "lang").join(arrays, ["lang", "source", "block"], "left")
    pairs = pair_values(grid)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", sides.alias("side")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")

    priced = kept.join(groups.select("lang", "source", F.col("n").alias("group_n"), "lang_n", "v"), ["lang", "source"])
    priced = priced.withColumn("p", price(F.col("n"), F.col("group_n"), F.col("v"))).withColumn("q", price(F.col("total"), F.col("lang_n"), F.col("v"))).where("p > q")
    found = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), cost(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    first = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(first), [counts_path, terms_path, kept_path, groups_path]
