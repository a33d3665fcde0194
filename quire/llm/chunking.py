"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text: each step shifts the hash left by
one bit and adds a random value of the byte, so a 16-bit hash depends on the
last 16 bytes only. A chunk ends where the hash is the greatest of all within
``RADIUS`` bytes on either side, so cuts depend on nearby bytes alone, an
insertion moves them no further than its surroundings, and chunks vary less in
length than with a fixed pattern of bits. Where the greatest value recurs in
the radius, as in stretches of a short period, it cuts every ``LEAST`` bytes or
a little more, at the same phase wherever the stretch begins. A chunk longer
than ``MOST`` is cut again at that stride.

Chunks are told apart by a 128-bit digest. The first chunk of each digest, by
document id and place, is the original; every other one is a repeat. Repeats
that follow each other form a passage, which counts from ``PASSAGE`` bytes on.

Defined results: null and empty texts have no chunks; a null id is given as it
is and sorts before others; rows of one id and text are copies of each other
(told apart by a number from their place in the table); of equal chunks the
first by id, then by that number, is the original; a very long text is chunked
as a whole, by one task; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .hashing import buffer, mix64

RADIUS = 24
LEAST = 16
MOST = 4096
PASSAGE = 120
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sums over 1, 2, 4, 8, 16 bytes, each from two of the last."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint16(k)
    return h


def greatest_near(h: np.ndarray, radius: int) -> np.ndarray:
    """The greatest value within ``radius`` places of each: over 1, 2, 4, ... places, then over the whole width from two."""
    edge = np.zeros(radius, h.dtype)
    most, size, width = np.concatenate([edge, h, edge]), 1, 2 * radius + 1
    while 2 * size <= width:
        most = np.maximum(most[:-size], most[size:])
        size *= 2
    return np.maximum(most[:len(most) - (width - size)], most[width - size:]) if size < width else most


def cut_points(data: np.ndarray, radius: int = RADIUS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Where the chunks of one text end."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = gear(data)
    hits = np.flatnonzero(h == greatest_near(h, radius)) + 1
    apart = np.diff(hits, prepend=hits[0] - least) >= least
    first = hits[apart][np.cumsum(apart) - 1]  # of the hits that follow each other closely
    hits = hits[apart | (np.diff((hits - first) // least, prepend=0) > 0)]
    ends = np.append(hits[hits < len(data)], len(data))
    sizes = np.diff(ends, prepend=0)
    if (sizes > most).any():
        ends = np.concatenate([np.arange(e - s + most, e, most) for s, e in zip(sizes[sizes > most], ends[sizes > most])] + [ends])
        ends.sort()
    return ends


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("nth", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("digest_a", pa.int64()), ("digest_b", pa.int64())])
_DDL = "doc_id long, tie long, nth int, start long, length int, digest_a long, digest_b long"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """A row for each chunk: its document, number, first byte, bytes and digest; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                data, offsets = buffer(rows.column("text"))
                ids, ties = rows.column("doc_id").to_pylist(), rows.column("tie").to_numpy(zero_copy_only=False)
                which, numbers, starts, lengths, digests = [], [], [], [], []
                for k in range(len(ids)):
                    text = data[offsets[k]:offsets[k + 1]]
                    ends = cut_points(text, radius, least, most)
                    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    raw = text.tobytes()
                    digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())]
                    which.append(np.full(len(ends), k))
                    numbers.append(np.arange(len(ends)))
                    starts.append(begins)
                    lengths.append(ends - begins)
                which = np.concatenate(which)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()).take(pa.array(which)), pa.array(ties[which], pa.int64()), pa.array(np.concatenate(numbers), pa.int32()),
                    pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(lengths), pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=_SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tie"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _DDL)


_DIGEST = ["digest_a", "digest_b"]


def originals(found: DataFrame) -> DataFrame:
    """The first chunk of each digest that is met twice or more; aggregated before the shuffle."""
    place = F.struct("doc_id", "tie", "nth")
    return found.groupBy(_DIGEST).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def repeats(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """The chunks whose digest an earlier chunk has, with that chunk's document. ``firsts`` is a written table, so that
    both sides of the join are read and adaptive execution can split a hot digest."""
    return (found.join(firsts, _DIGEST).where(F.struct("doc_id", "tie", "nth") > F.col("first"))
            .select("doc_id", "tie", "nth", "start", "length", F.col("first.doc_id").alias("first_doc_id")))


def passages(repeated: DataFrame, least: int = PASSAGE) -> DataFrame:
    """Runs of repeated chunks of at least ``least`` bytes: ``doc_id, start, end`` (UTF-8 bytes), chunks, and the document
    of the first chunk's original."""
    turn = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("nth"))
    runs = repeated.withColumn("run", F.col("nth") - turn).groupBy("doc_id", "tie", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("n_chunks"),
        F.min_by("first_doc_id", "nth").alias("first_doc_id"))
    return runs.where(F.col("end") - F.col("start") >= least).select("doc_id", "tie", "start", "end", "n_chunks", "first_doc_id")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PASSAGE) -> tuple[DataFrame, list[str]]:
    """The repeated passages of all texts; and the paths written. The chunk table is written once, so that a document's
    number in it is the same wherever it is read."""
    found, path = written(chunks(docs, id_col, text_col), "chunks")
    firsts, other = written(originals(found), "chunk-originals")
    return passages(repeats(found, firsts), least), [path, other]
