"""Token-id files, coded by a static range asymmetric numeral system.

Texts are dealt into ranges of ids and sorted; each range's token ids form
files of bounded size, and a file holds independent blocks (``rans``), its
documents' ids and lengths, and an index of the blocks with checksums. All
files share one frequency table, counted over the whole corpus and stored
beside them. A file is written under a name of its own and then moved to its
last one, so a task that runs twice leaves the same file.

Defined results: a null or empty text is its end id alone; null ids come first;
rows of one id are ordered by their text's hash and each keeps its own entry;
an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import shared_path

from .common import once, slices, texts, written
from .rans import Table, frequencies
from .tokens import encoder

VOCABULARY = "word_bpe_49k.json"
VOCABULARY_SIZE = 49_408
END = 1
FILE_IDS = 1 << 22  # a file is closed with the document that reaches so many ids
BLOCK_IDS = 1 << 19
_MAGIC = b"RANSTOK1"
_FOOT = struct.Struct("<QIQI8s")  # place of the index, blocks, documents, crc32 of the index, magic
_BLOCK = struct.Struct("<QIII")  # place, bytes, ids, crc32

_GROUPS_DDL = "part int, file int, n_docs long, n_ids long, doc_ids binary, no_id binary, lengths binary, ids binary"


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, end: int = END) -> DataFrame:
    """The content of each file to be: documents in ascending order of id, with their token ids in 16 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(name, "uint16", added=True).encode_all
        part, closing = TaskContext.get().partitionId(), np.uint16(end).tobytes()
        file, size, doc_ids, coded = 0, 0, [], []

        def group() -> pa.RecordBatch:
            columns = [[part], [file], [len(doc_ids)], [size], [np.array([d or 0 for d in doc_ids], "<i8").tobytes()],
                       [np.array([d is None for d in doc_ids], np.uint8).tobytes()], [np.array([len(c) // 2 for c in coded], "<i8").tobytes()], [b"".join(coded)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["part", "file", "n_docs", "n_ids", "doc_ids", "no_id", "lengths", "ids"])

        for batch in batches:
            for rows in slices(batch, "text"):
                found = ids_of([text.decode() for text in texts(rows, "text")])
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), found):
                    doc_ids.append(doc_id)
                    coded.append(ids + closing)
                    size += len(coded[-1]) // 2
                    if size >= FILE_IDS:
                        yield group()
                        file, size, doc_ids, coded = file + 1, 0, [], []
        if doc_ids:
            yield group()

    return rows.select("doc_id", "text").mapInArrow(run, _GROUPS_DDL)


def token_counts(groups: DataFrame, size: int = VOCABULARY_SIZE) -> np.ndarray:
    """How often each id occurs; at most ``size`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), np.uint16), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in groups.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def file_bytes(table: Table, doc_ids: bytes, no_id: bytes, lengths: bytes, ids: np.ndarray) -> bytes:
    blocks, index, at = [], [], len(_MAGIC) + 4
    for a in range(0, len(ids), BLOCK_IDS):
        block = table.encode(ids[a:a + BLOCK_IDS])
        index.append(_BLOCK.pack(at, len(block), min(BLOCK_IDS, len(ids) - a), zlib.crc32(block)))
        blocks.append(block)
        at += len(block)
    tail = b"".join(index) + doc_ids + no_id + lengths
    return b"".join([_MAGIC, struct.pack("<I", table.crc), *blocks, tail, _FOOT.pack(at, len(blocks), len(no_id), zlib.crc32(tail), _MAGIC)])


def read_file(table: Table, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all token ids; raises ``ValueError`` where a checksum doesn't hold."""
    place, n_blocks, n_docs, crc, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    tail = data[place:len(data) - _FOOT.size]
    if data[:8] != _MAGIC or magic != _MAGIC or zlib.crc32(tail) != crc:
        raise ValueError("not a whole token file")
    if struct.unpack_from("<I", data, 8)[0] != table.crc:
        raise ValueError("the file was written with another frequency table")
    parts = []
    for k in range(n_blocks):
        at, size, n, crc = _BLOCK.unpack_from(tail, k * _BLOCK.size)
        block = data[at:at + size]
        if zlib.crc32(block) != crc:
            raise ValueError(f"block {k} doesn't match its checksum")
        parts.append(table.decode(block))
    at = n_blocks * _BLOCK.size
    doc_ids = np.frombuffer(tail, "<i8", n_docs, at).tolist()
    no_id = np.frombuffer(tail, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(tail, "<i8", n_docs, at + 9 * n_docs)
    return [None if none else d for d, none in zip(doc_ids, no_id)], lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_files(groups: DataFrame, freq: np.ndarray, path: str) -> DataFrame:
    """Writes the files below ``path``, which all executors reach; one row for each."""
    shared = groups.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        table = once(("table", path), lambda: Table(shared.value))
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                data = file_bytes(table, row["doc_ids"], row["no_id"], row["lengths"], np.frombuffer(row["ids"], np.uint16))
                last = f"{top}/{row['part']:06d}-{row['file']:06d}.rans"
                own = f"{top}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, last)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["file"]], pa.int32()), pa.array([row["n_docs"]]),
                                                  pa.array([row["n_ids"]]), pa.array([len(data)])], names=["part", "file", "n_docs", "n_ids", "n_bytes"])

    return groups.mapInArrow(run, "part int, file int, n_docs long, n_ids long, n_bytes long")


def read_files(spark, path: str, freq: np.ndarray) -> DataFrame:
    """``part, file, doc_id, before`` (ids before it in its file)``, n_tokens, ids_crc32`` of every document in the files."""
    shared = spark.sparkContext.broadcast(freq)
    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once(("table", path), lambda: Table(shared.value))
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                part, file = map(int, name.rpartition("/")[2].split(".")[0].split("-"))
                doc_ids, lengths, ids = read_file(table, memoryview(data.as_buffer()).tobytes())
                ends = np.cumsum(lengths)
                ids = ids.astype("<u4")
                crcs = [zlib.crc32(ids[e - n:e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    ([part] * len(doc_ids), [file] * len(doc_ids), doc_ids, ends - lengths, lengths, crcs), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(path)
    return files.select("path", "content").mapInArrow(run, "part int, file int, doc_id long, before long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, end: int = END) -> tuple[DataFrame, list[str]]:
    """Writes the files and reads them back: ``doc_id, start, n_tokens, ids_crc32``; and the paths written."""
    spark = docs.sparkSession
    groups, kept = written(token_groups(docs, id_col, text_col, name, end), "token-groups")
    counts = token_counts(groups)
    freq = frequencies(counts)
    path = shared_path(spark, "token-files")
    if not counts.any():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long"), [kept]
    files, listed = written(write_files(groups, freq, path), "token-index")
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("parts_before"))
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("files_before")).join(parts, "part")
    rows = read_files(spark, path, freq).join(starts, ["part", "file"])
    return rows.select("doc_id", (F.col("parts_before") + F.col("files_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"), [kept, listed, path]
