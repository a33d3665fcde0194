"""Near-duplicate documents by one-permutation MinHash.

A document's set holds its distinct 5-word shingles. Every shingle is hashed
once; the hash's range is cut into bins and the least hash of each bin makes
the signature. Empty bins are filled by optimal densification: each draws bins
from a fixed hash sequence until it meets a full one. Bands of bins are the
keys of buckets.

Documents of equal sets are one class and go on as one representative, a number
that follows the order of the classes' smallest ids. Within
a bucket the candidate edges form a star: the least representative against each
other member, confirmed on full sets. Members that the star leaves outside its
component come back. A second star begins at the member that shares most of its
shingles with others; then each member still outside is held against the
bucket's members of other components, so that no link between two members of a
bucket is lost. Pairs that cannot meet the threshold are never made: what two
sets have in common is bounded by what each has in common with the star's
centre, and beyond that by the shingles that each shares with any other set,
both counted in each of ``PARTS`` parts of the hash range.

Defined results: null and empty texts have the empty set and stay alone; texts
of fewer than five words are one shingle; rows that share an id with different
texts are judged by their own text, and each row gets its result; a null id
stays alone; very long texts are hashed in pieces that end between words; ties
go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import hashing
from .common import drop, release, slices, written

SHINGLE = 5
BANDS, ROWS = 64, 6
PERCENT = 75
PARTS = 32  # a power of two; what sets have in common is bounded for each part of the hash range
BROADCAST_IDS = 500_000  # up to so many classes (16 MB) go to all tasks, so that texts needn't be shuffled to be picked; beyond, a join
U = np.uint64

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows, one after the other, and how many each row has."""
    data, offsets = hashing.buffer(column)
    _, _, words, firsts = hashing.words(data, offsets)
    counts = np.diff(firsts)
    row = hashing.rows_of(firsts)
    grams = hashing.grams(words, n)
    inside = row[n - 1:] == row[:len(grams)]
    values, owner = grams[inside], row[:len(grams)][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.array([hashing.grams(words[firsts[k]:firsts[k + 1]], int(counts[k]))[0] + U(counts[k]) for k in short], np.uint64)
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    sets, sizes, at = [], np.zeros(len(counts), np.int64), np.searchsorted(owner, np.arange(len(counts) + 1))
    for k in range(len(counts)):
        one = np.unique(values[at[k]:at[k + 1]])
        sizes[k] = len(one)
        sets.append(one)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def signatures(values: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures with optimal densification; a row for each set that isn't empty."""
    full = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(len(full)), sizes[full])
    # the bin of a hash is the product's high part; sorted values have ascending bins
    which = ((values >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    cell = owner * bins + which
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out, filled = np.zeros(len(full) * bins, np.uint64), np.zeros(len(full) * bins, bool)
    out[cell[first]] = values[first]
    filled[cell[first]] = True
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        attempt += 1
        draw = hashing.mix64((empty % bins).astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(attempt)) % U(bins)
        source = empty - empty % bins + draw.astype(np.int64)
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    return out.reshape(len(full), bins)


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signed.reshape(len(signed), bands, rows)
    key = np.zeros((len(signed), bands), np.uint64)
    for k in range(rows):
        key = hashing.mix64(key + cut[:, :, k])
    return key + np.arange(bands, dtype=np.uint64)


def digests(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set, which don't depend on the order of its shingles."""
    ends = np.cumsum(sizes)
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(hashing.mix64(values), out=sums[0, 1:])
    np.cumsum(hashing.mix64(values ^ U(0x2545F4914F6CDD1D)), out=sums[1, 1:])
    return (sums[:, ends] - sums[:, ends - sizes]).view(np.int64)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, a 128-bit digest of the set and the band keys of every text; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                values, sizes = shingle_sets(part.column("text"))
                digest = digests(values, sizes)
                keys = band_keys(signatures(values, sizes, bands * rows), bands, rows).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(digest[0]), pa.array(digest[1]),
                                                  pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()))], schema=_SIGNED)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SIGNED_DDL)


def _sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rep, set`` (sorted hashes) of the classes in ``members`` (``rep, doc, set_a, set_b``), from documents of their
    smallest id; a text of that id whose set is another class's is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                values, sizes = shingle_sets(part.column("text"))
                digest = digests(values, sizes)
                own = np.flatnonzero((digest[0] == part.column("set_a").to_numpy()) & (digest[1] == part.column("set_b").to_numpy()))
                ends = np.cumsum(sizes)
                raw = [values[ends[k] - sizes[k]:ends[k]].tobytes() for k in own]
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(own)), pa.array(raw, pa.binary())], names=["rep", "set"])

    small = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(members) if small else members, "doc")
    return rows.select("rep", "set_a", "set_b", "text").mapInArrow(run, "rep long, set binary")


def _by_part(values: np.ndarray) -> np.ndarray:
    """How many of the hashes lie in each part of their range."""
    return np.bincount((values.view(U) >> U(65 - PARTS.bit_length())).astype(np.int64), minlength=PARTS).astype(np.int32)


def _lists(counts: np.ndarray) -> pa.Array:
    """A row of counts as a list each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * PARTS, pa.int32()), pa.array(counts.ravel(), pa.int32()))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, both, both_parts``: how many shingles the two sets have in common, in all and by part, counted on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            parts = np.zeros((batch.num_rows, PARTS), np.int32)
            a_ids = batch.column("a").to_pylist()
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                if a_ids[k] != last:
                    last, one = a_ids[k], np.frombuffer(x.as_buffer(), np.uint64)
                parts[k] = _by_part(np.intersect1d(one, np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(parts.sum(axis=1, dtype=np.int64)), _lists(parts)],
                                             names=["a", "b", "both", "both_parts"])

    joined = (pairs.select("a", "b").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
              .join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a"))
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, both long, both_parts array<int>")


def _linked(pairs: DataFrame, sets: DataFrame, n_of: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that meet the threshold. Pairs whose sizes alone rule that out go before any set is moved."""
    sized = (pairs.join(n_of.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a").join(n_of.select(F.col("rep").alias("b"), F.col("n").alias("n_b")), "b")
             .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    return _meeting(_overlaps(sized, sets), n_of, percent)


def _meeting(overlaps: DataFrame, n_of: DataFrame, percent: int) -> DataFrame:
    sized = overlaps.join(n_of.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a").join(n_of.select(F.col("rep").alias("b"), F.col("n").alias("n_b")), "b")
    return sized.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def components(links: DataFrame, name: str = "components") -> tuple[DataFrame, str]:
    """``node, root``: the least node that links reach, for every linked node; and the path of its table. Each round
    hands the least root on along links, then along roots (pointer jumping); ends when no root changes."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both, path_links = written(both.distinct(), f"{name}-links")
    roots, path = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), name)
    while True:
        seen = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = roots.join(seen, "node").select("node", "root", F.least("root", "near").alias("next"))
        # a root's own root is one more step on
        up = step.select(F.col("node").alias("next"), F.col("next").alias("above"))
        after, after_path = written(step.join(up, "next", "left").select("node", "root", F.least("next", F.coalesce("above", "next")).alias("next")), name)
        changed = after.where("root <> next").limit(1).count()
        drop(links.sparkSession, path)
        roots, path = after.select("node", F.col("next").alias("root")), after_path
        if not changed:
            drop(links.sparkSession, path_links)
            return roots, path


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, b, root, main``: the members of buckets with several components, their roots and that of the largest one."""
    rooted = members.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").select("key", "b", F.coalesce("root", "b").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.count("*").alias("parts"))
    return rooted.join(largest.where("parts > 1").drop("parts"), "key")


def _bounds(sets: DataFrame) -> DataFrame:
    """``rep, n, shared, shared_parts``: a set's size, and how many of its shingles any other of these sets has, in all and
    by part; no two of them have more in common."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, raw in zip(batch.column("rep").to_pylist(), batch.column("set")):
                values = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), rep)), pa.array(values)], names=["rep", "shingle"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.array([_by_part(np.frombuffer(raw.as_buffer(), U)) for raw in batch.column("set")], np.int32).reshape(-1, PARTS)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(parts.sum(axis=1, dtype=np.int64)), _lists(parts)], names=["rep", "n", "parts"])

    alone = (sets.mapInArrow(spread, "rep long, shingle long").groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).where("rep = last")
             .groupBy("rep", F.shiftrightunsigned("shingle", 65 - PARTS.bit_length()).cast("int").alias("part")).agg(F.count("*").cast("int").alias("alone"))
             .groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("part", "alone"))).alias("alone")))
    sizes = (sets.mapInArrow(count, "rep long, n long, parts array<int>").groupBy("rep")
             .agg(F.max("n").alias("n"), F.array(*[F.sum(F.get("parts", F.lit(k))).cast("int") for k in range(PARTS)]).alias("parts")))
    shared = F.transform("parts", lambda size, part: size - F.coalesce(F.try_element_at("alone", part), F.lit(0)))
    return sizes.join(alone, "rep", "left").select("rep", "n", shared.alias("shared_parts")).select("rep", "n", _total(F.col("shared_parts")).alias("shared"), "shared_parts")


def _total(counts):
    return F.aggregate(counts, F.lit(0), lambda total, one: total + one).cast("long")


def _least(one: str, other: str):
    """The sum of the lesser counts by part."""
    return _total(F.zip_with(one, other, lambda x, y: F.least(x, y)))


def _step(size):
    return F.floor(F.log(size) / np.log(1.03).item())


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
            percent: int = PERCENT) -> tuple[DataFrame, DataFrame, list[str]]:
    """``doc_id, n_shingles, set_a, set_b, bands`` of every row; ``set_a, set_b, doc, component, first`` of every class: its
    smallest id, that of its component, and whether it is the component's first class; and the paths written."""
    signed, path = written(sign(docs, id_col, text_col, bands, rows), "dedup-signed")
    paths = [path]
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets: one class; its number stands for it and follows the order of the smallest ids
    classes = linked.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"))
    classes = classes.repartitionByRange("doc", "set_a", "set_b").sortWithinPartitions("doc", "set_a", "set_b")
    classes, path = written(classes.withColumn("rep", F.monotonically_increasing_id()), "dedup-classes")
    paths.append(path)
    reps = linked.join(classes.drop("n"), ["set_a", "set_b"]).where("doc_id = doc").select("rep", "bands").distinct()
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("members")).where("members > 1").select("key", "a")
    stars, path = written(stars, "dedup-stars")
    paths.append(path)
    members, path = written(keyed.join(stars, "key").select("key", "a", F.col("rep").alias("b")), "dedup-members")
    paths.append(path)

    n_of = classes.select("rep", "n")
    first, path = written(members.where("a <> b").select("a", "b").distinct(), "dedup-pairs")
    paths.append(path)
    ids, path = written(first.select(F.col("a").alias("rep")).unionByName(first.select(F.col("b").alias("rep"))).distinct(), "dedup-ids")
    paths.append(path)
    sets, path = written(_sets(docs, ids.join(classes.drop("n"), "rep"), id_col, text_col).distinct(), "dedup-sets")
    paths.append(path)
    links, path = written(_linked(first, sets, n_of, percent), "dedup-links")
    paths.append(path)
    roots, path = components(links)
    paths.append(path)

    # buckets that still hold several components
    mixed, path = written(_mixed(members.select("key", "b"), roots), "dedup-mixed")
    paths.append(path)
    sizes, path = written(_bounds(sets.join(mixed.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi")), "dedup-bounds")
    paths.append(path)
    # a second star, from the member that shares most of its shingles; what each member has in common with it is kept
    bounded = mixed.join(sizes, F.col("b") == F.col("rep")).drop("rep")
    hubs, path = written(bounded.groupBy("key").agg(F.max_by("b", F.struct(F.col("shared") / F.col("n"), -F.col("b"))).alias("hub")), "dedup-hubs")
    paths.append(path)
    second = mixed.join(hubs, "key").where("b <> hub").select(F.col("hub").alias("a"), "b").distinct()
    common, path = written(_overlaps(second, sets), "dedup-common")
    paths.append(path)
    links, path = written(links.unionByName(_meeting(common, n_of, percent)), "dedup-second-links")
    paths.append(path)
    roots, path = components(links)
    paths.append(path)
    # what is left: members outside a bucket's largest component, against the members of other components whose size
    # and shared shingles leave a link possible; the sizes are cut into steps, to join on them
    mixed = (_mixed(mixed.select("key", "b"), roots).join(hubs, "key").groupBy("hub", "b")
             .agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("out")).join(sizes, F.col("b") == F.col("rep")).drop("rep"))
    mixed = mixed.join(common.withColumnRenamed("a", "hub"), ["hub", "b"], "left").withColumns(
        {"both": F.coalesce("both", "shared"), "both_parts": F.coalesce("both_parts", "shared_parts")})
    mixed = mixed.withColumn("rest_parts", F.zip_with("shared_parts", "both_parts", lambda all_of, both: all_of - both)).drop("shared_parts")
    mixed, path = written(mixed, "dedup-mixed-again")
    paths.append(path)
    low, high = F.col("n") * percent / 100, F.col("shared") * (100 + percent) / percent - F.col("n")
    outside = mixed.where(F.col("out") & (high >= low)).select(
        "hub", F.col("b").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("x_n"), F.col("shared").alias("x_shared"), F.col("both").alias("x_both"),
        F.col("both_parts").alias("x_both_parts"), F.col("rest_parts").alias("x_rest_parts"), F.explode(F.sequence(_step(low), _step(high))).alias("step"))
    # in common: at most the lesser part within the hub, and the lesser shared part outside it; the whole sets first, then by part
    most = F.least("both", "x_both") + F.least(F.col("shared") - F.col("both"), F.col("x_shared") - F.col("x_both"))
    needed = percent * (F.col("n") + F.col("x_n"))
    possible = ((100 + percent) * most >= needed) & ((100 + percent) * (_least("both_parts", "x_both_parts") + _least("rest_parts", "x_rest_parts")) >= needed)
    third = (mixed.withColumn("step", _step(F.col("n"))).join(outside, ["hub", "step"]).where((F.col("root") != F.col("x_root")) & possible)
             .select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    more, path = written(_linked(third, sets, n_of, percent), "dedup-third-links")
    paths.append(path)
    if more.limit(1).count():
        roots, path = components(links.unionByName(more))
        paths.append(path)

    rooted = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("set_a", "set_b", "doc", "rep", F.coalesce("root", "rep").alias("root"))
    first = rooted.where("rep = root").select("root", F.col("doc").alias("component"))
    grouped, path = written(rooted.join(first, "root").select("set_a", "set_b", "doc", "component", (F.col("rep") == F.col("root")).alias("first")), "dedup-grouped")
    paths.append(path)
    return signed, grouped, paths


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, list[str]]:
    """``doc_id, n_shingles, component_id, kept`` of every row; and the paths written."""
    signed, grouped, paths = classed(docs, id_col, text_col, **options)
    out = signed.join(grouped, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), paths


def _with_digests(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns of ``docs``, and ``n_shingles, set_a, set_b`` of the text."""
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                values, sizes = shingle_sets(part.column(text_col))
                digest = digests(values, sizes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), pa.array(digest[0]), pa.array(digest[1])],
                                                 names=[*part.schema.names, "n_shingles", "set_a", "set_b"])

    return docs.mapInArrow(run, StructType([*fields, *StructType.fromDDL("n_shingles long, set_a long, set_b long").fields]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` without those whose group has a row of smaller id, or of the same id; and the paths written.
    Of equal rows' texts under one id, one stays; different texts under one id are judged apart. Rows without an id or
    without shingles stay."""
    signed, grouped, paths = classed(docs, id_col, text_col, **options)
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    judged = signed.drop("bands").join(grouped, ["set_a", "set_b"], "left")
    judged = judged.withColumn("stays", F.coalesce(alone | (F.col("first") & (F.col("doc_id") == F.col("doc"))), F.lit(False)))
    by_id = judged.where("doc_id is not null").groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    verdict, verdict_path = written(by_id, "dedup-verdict")
    shared = verdict.where("stays").select(F.col("doc_id").alias("_id"))
    several, several_path = written(judged.where("stays").join(shared, F.col("doc_id") == F.col("_id")).select("doc_id", "set_a", "set_b").distinct(), "dedup-several")
    drop(docs.sparkSession, *paths)
    key = F.col(id_col).cast("long")
    rest = docs.join(verdict.select(F.col("doc_id").alias("_id")), key == F.col("_id"), "left_anti")
    if not several.limit(1).count():
        return rest, [verdict_path, several_path]
    # ids of several rows: by row, under names of their own
    columns = docs.columns
    rows = docs.join(shared, key == F.col("_id"), "left_semi").select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(columns)])
    rows = _with_digests(rows, f"_{columns.index(text_col)}").withColumn("doc_id", F.col(f"_{columns.index(id_col)}").cast("long"))
    rows = rows.join(several, ["doc_id", "set_a", "set_b"], "left_semi")
    one = rows.where("n_shingles > 0").dropDuplicates(["doc_id", "set_a", "set_b"]).unionByName(rows.where("n_shingles = 0"))
    return rest.unionByName(one.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(columns)])), [verdict_path, several_path]
