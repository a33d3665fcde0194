"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting is Spark's: tasks count the words and bigrams of their texts, blocks of
sorted counts are shuffled by hash bucket, and each bucket's task adds them up.
The model is stored as files of sorted arrays in the shared folder, and the
scoring tasks map them into memory, so that the processes of a machine share
one copy and read only the pages they touch:

* words: sorted 64-bit hashes. A word's id is its place; beside it lie its count,
  its continuation probability, and its weight and total as a context.
* bigrams: per bucket, sorted keys (id of the first word, id of the second) and
  counts. All ids fit 31 bits, or counting stops with an error.

p(w | v) = max(c(v w) - D, 0) / c(v) + g(v) p1(w), where the discount D depends
on whether the count is 1, 2 or more, g(v) is what the discounts leave over, and
p1 is the same over the numbers of different words before w, interpolated with
the uniform 1 / (V + 1), the share of unknown words. A context that was never
seen leaves p1 alone. Begin and end of a text are words of their own; the begin
is never predicted. Words are compared by 64-bit hashes.

Defined results: a null or empty text is the end alone; a null id counts as the
text "" for the split and is kept; repeated rows count and are scored one by
one; without any training text every probability is uniform; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shared_path

from . import hashing
from .common import once, slices, written

FOLDS, HELD_OUT = 7, 2
BUCKET_TOKENS = 4_000_000  # training tokens behind a bucket, on average
U = np.uint64
END = U(0xE0D0E0D0E0D0E0D1)  # the hash that stands for the end of a text
_SLICE = 4 << 20


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``doc_id, held_out, text``."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold == held_out).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows' tokens, each row closed by the end, and each row's first token (one more entry ends it)."""
    _, _, words, firsts = hashing.words(*hashing.buffer(column))
    n = len(firsts) - 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + hashing.rows_of(firsts)] = words
    return out, firsts + np.arange(n + 1)


# ----------------------------------------------------- blocks of sorted counts


def pack_block(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys by their differences, and values, as compressed byte planes."""
    import zstandard

    steps = np.diff(keys, prepend=U(0)).astype("<u8")
    planes = [np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()]
    planes += [np.ascontiguousarray(v.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for v in values]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_block(block: bytes, n_values: int) -> tuple[np.ndarray, ...]:
    import zstandard

    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:]), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    values = [np.ascontiguousarray(raw[8 * k * n:8 * (k + 1) * n].reshape(8, n).T).view("<i8").ravel() for k in range(1, n_values + 1)]
    return keys, *values


def add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], *((np.add.reduceat(v[order], at) if len(at) else v[:0]) for v in values)


def in_buckets(bucket: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks of sorted keys by bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        one = order[a:b]
        yield int(bucket[one[0]]), pack_block(keys[one], *(v[one] for v in values))


_BLOCKS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.binary())])
_BLOCKS_DDL = "kind int, bucket int, block binary"


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCKS.types)] if rows else [pa.array([], t) for t in _BLOCKS.types], schema=_BLOCKS)


class _Counter:
    """Counts of 64-bit keys, merged whenever ``most`` new ones have come."""

    def __init__(self, most: int = 3_000_000):
        self.parts, self.size, self.most = [], 0, most

    def add(self, keys: np.ndarray) -> bool:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.most and len(self.parts) > 1:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
        return self.size > self.most

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return add_up(*(np.concatenate(x) for x in zip(*self.parts)))


def _merged(group: pa.Table, n_values: int) -> tuple[np.ndarray, ...]:
    parts = [unpack_block(b, n_values) for b in group.column("block").to_pylist()]
    return add_up(*(np.concatenate(x) for x in zip(*parts)))


# ------------------------------------------------------------- files of arrays


def save_array(path: str, name: str, array: np.ndarray) -> None:
    """A file below ``path``, written aside and moved, so that a task that runs twice leaves the same one."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(path)
    store.create_dir(top, recursive=True)
    own = f"{top}/.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array))
    store.move(own, f"{top}/{name}")


def map_array(path: str, name: str, dtype, length: int | None = None) -> np.ndarray:
    """The file as an array: mapped where the shared folder is a file system of the machine, else read. With ``length``, entries of 8 bytes may stand in for ``dtype``."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(path)
    size = store.get_file_info(f"{top}/{name}").size
    if not size:
        return np.zeros(0, dtype)
    if length and size == 8 * length:
        dtype = np.int64
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{top}/{name}", dtype, "r")
    with store.open_input_file(f"{top}/{name}") as file:
        return np.frombuffer(file.read_buffer(), dtype)


def find(sorted_array: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where it isn't there. Sorted keys walk the array in order."""
    if not len(sorted_array):
        return np.full(len(keys), -1)
    at = np.searchsorted(sorted_array, keys)
    at[at == len(sorted_array)] = 0
    return np.where(sorted_array[at] == keys, at, -1)


# -------------------------------------------------------------------- training


def _word_blocks(texts: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def flush():
            keys, counts = counter.total()
            # buckets are ranges of hashes, so that they follow each other in the order of words
            bucket = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            counter.parts, counter.size = [], 0
            return _blocks([(0, b, block) for b, block in in_buckets(bucket, keys, counts)])

        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                if counter.add(token_hashes(part.column("text"))[0]):
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, _BLOCKS_DDL)


def _save_words(blocks: DataFrame, path: str) -> DataFrame:
    def run(key, group):
        keys, counts = _merged(group, 1)
        bucket = key[0].as_py()
        save_array(path, f"words-{bucket:06d}", keys)
        save_array(path, f"counts-{bucket:06d}", counts)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    return blocks.groupBy("bucket").applyInArrow(run, "bucket int, n long, tokens long")


class Words:
    """The mapped word table: ids of hashes, bucket by bucket."""

    def __init__(self, path: str, sizes: list[int]):
        self.buckets = len(sizes)
        self.firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hashes = [map_array(path, f"words-{b:06d}", np.uint64) if n else np.zeros(0, np.uint64) for b, n in enumerate(sizes)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Of sorted hashes; -1 for unknown words."""
        bucket = ((hashes >> U(32)) * U(self.buckets) >> U(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        out = np.full(len(hashes), -1, np.int64)
        for b in range(self.buckets):
            if cuts[b] < cuts[b + 1]:
                at = find(self.hashes[b], hashes[cuts[b]:cuts[b + 1]])
                out[cuts[b]:cuts[b + 1]] = np.where(at >= 0, at + self.firsts[b], -1)
        return out


def _token_ids(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens, of the token before each (the number of words: the begin), and each row's first token."""
    hashes, firsts = token_hashes(column)
    distinct, back = np.unique(hashes, return_inverse=True)
    ids = words.ids(distinct)[back]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[firsts[:-1]] = words.firsts[-1]
    return ids, before, firsts


def _bigram_blocks(texts: DataFrame, path: str, sizes: list[int], buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once(("words", path), lambda: Words(path, sizes))
        counter = _Counter()

        def flush():
            keys, counts = counter.total()
            counter.parts, counter.size = [], 0
            return _blocks([(0, b, block) for b, block in in_buckets(bigram_bucket(keys, buckets), keys, counts)])

        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                ids, before, _ = _token_ids(part.column("text"), words)
                if counter.add(before.astype(np.uint64) << U(32) | ids.astype(np.uint64)):
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, _BLOCKS_DDL)


def bigram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by hash of the whole bigram, so that a frequent word's bigrams are spread over all."""
    return (hashing.mix64(keys) % U(buckets)).astype(np.int64)


def _save_bigrams(blocks: DataFrame, path: str, ranges: int, n_words: int) -> DataFrame:
    """Adds each bucket up and stores it. Gives, by range of word ids, what it knows of the words as contexts (kind 1:
    total, and bigrams of count 1, 2 and more) and of the words before a word (kind 2); kind 3: counts of counts."""

    def run(key, group):
        keys, counts = _merged(group, 1)
        bucket = key[0].as_py()
        save_array(path, f"bigrams-{bucket:06d}", keys)
        save_array(path, f"bigram-counts-{bucket:06d}", counts if counts.max() >> 32 else counts.astype("<u4"))
        width = -(-(n_words + 1) // ranges)
        first, second = keys >> U(32), keys & U(0xFFFFFFFF)
        contexts = add_up(first, counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))
        follows = add_up(second, np.ones(len(second), np.int64))
        rows = [(1, r, b) for r, b in in_buckets((contexts[0] // U(width)).astype(np.int64), *contexts)]
        rows += [(2, r, b) for r, b in in_buckets((follows[0] // U(width)).astype(np.int64), *follows)]
        of_counts = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], "<i8")
        return pa.Table.from_batches([_blocks([*rows, (3, bucket, of_counts.tobytes())])])

    return blocks.groupBy("bucket").applyInArrow(run, _BLOCKS_DDL)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2 and more; from counts of counts, held within (0, count) where those are too few to tell."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _save_contexts(facts: DataFrame, path: str, ranges: int, n_words: int, by_count: tuple[float, float, float]) -> DataFrame:
    """Stores each context's total and left-over weight, and how many different words come before each word. Gives counts of counts and the sum of those."""

    def run(key, group):
        part, width = key[0].as_py(), -(-(n_words + 1) // ranges)
        low = part * width
        size = max(0, min(width, n_words + 1 - low))
        totals, weights, before = np.zeros(size, np.int64), np.ones(size), np.zeros(size, np.int64)
        kinds = np.array(group.column("kind"))
        if (kinds == 1).any():
            ids, total, one, two, more = _merged(group.filter(pa.array(kinds == 1)), 4)
            at = ids.astype(np.int64) - low
            totals[at] = total
            weights[at] = (by_count[0] * one + by_count[1] * two + by_count[2] * more) / total
        if (kinds == 2).any():
            ids, n = _merged(group.filter(pa.array(kinds == 2)), 1)
            before[ids.astype(np.int64) - low] = n
        save_array(path, f"totals-{part:06d}", totals)
        save_array(path, f"weights-{part:06d}", weights)
        save_array(path, f"before-{part:06d}", before)
        return pa.table({"part": pa.array([part], pa.int32()), "sum": [int(before.sum())], "more": [int((before > 2).sum())],
                         **{f"n{k}": [int((before == k).sum())] for k in (1, 2, 3, 4)}})

    return facts.groupBy("bucket").applyInArrow(run, "part int, sum long, more long, n1 long, n2 long, n3 long, n4 long")


class Model:
    """Where the arrays are, and the few numbers beside them."""

    def __init__(self, path: str, word_sizes: list[int], buckets: int, ranges: int, tokens: int, by_count, by_before, n_before, has):
        self.path, self.word_sizes, self.buckets, self.ranges, self.tokens = path, word_sizes, buckets, ranges, tokens
        self.by_count, self.by_before, self.n_before, self.has = by_count, by_before, n_before, has
        self.n_words = sum(word_sizes)


def train(texts: DataFrame, bucket_tokens: int = BUCKET_TOKENS) -> tuple[Model, list[str]]:
    """Learns from all rows of ``texts (text)``. Returns the model and the paths written; the model's own is the first."""
    spark = texts.sparkSession
    path = shared_path(spark, "bigram-model")
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // (6 * bucket_tokens)))
    words, at = written(_save_words(_word_blocks(texts, buckets), path), "model-words")
    paths = [path, at]
    sizes, tokens = [0] * buckets, 0
    for row in words.collect():  # a row for each bucket
        sizes[row["bucket"]] = row["n"]
        tokens += row["tokens"]
    n_words = sum(sizes)
    if n_words >= 1 << 31:
        raise ValueError("more words than bigram keys can tell apart")
    ranges = buckets
    facts, at = written(_save_bigrams(_bigram_blocks(texts, path, sizes, buckets), path, ranges, n_words), "model-facts")
    paths.append(at)
    of_counts, has = np.zeros(4, np.int64), set()
    for row in facts.where("kind = 3").collect():  # a row for each bucket
        of_counts += np.frombuffer(row["block"], "<i8")
        has.add(row["bucket"])
    by_count = discounts(*map(int, of_counts))
    saved, at = written(_save_contexts(facts.where("kind < 3"), path, ranges, n_words, by_count), "model-contexts")
    paths.append(at)
    total = {k: 0 for k in ("sum", "more", "n1", "n2", "n3", "n4")}
    parts = set()
    for row in saved.collect():  # a row for each range
        parts.add(row["part"])
        for k in total:
            total[k] += row[k]
    by_before = discounts(*(total[f"n{k}"] for k in (1, 2, 3, 4)))
    n_before = (total["sum"], total["n1"], total["n2"], total["more"])
    return Model(path, sizes, buckets, ranges, tokens, by_count, by_before, n_before, (has, parts)), paths


# --------------------------------------------------------------------- scoring


class Scorer:
    """Log probabilities from the mapped arrays."""

    def __init__(self, model: Model):
        self.model = m = model
        self.words = Words(m.path, m.word_sizes)
        has, parts = m.has
        self.bigrams = []
        for b in range(m.buckets):
            keys = map_array(m.path, f"bigrams-{b:06d}", np.uint64) if b in has else np.zeros(0, np.uint64)
            self.bigrams.append((keys, map_array(m.path, f"bigram-counts-{b:06d}", np.uint32, len(keys)) if len(keys) else keys))
        self.width = -(-(m.n_words + 1) // m.ranges)
        self.counts = [map_array(m.path, f"counts-{b:06d}", np.int64) if n else np.zeros(0, np.int64) for b, n in enumerate(m.word_sizes)]
        self.parts = {name: [map_array(m.path, f"{name}-{r:06d}", kind) if r in parts else None for r in range(m.ranges)]
                      for name, kind in (("totals", np.int64), ("weights", np.float64), ("before", np.int64))}

    def _of(self, name: str, ids: np.ndarray, default: float) -> np.ndarray:
        """Values of sorted word ids."""
        out = np.full(len(ids), default, np.float64)
        cuts = np.searchsorted(ids, np.arange(self.model.ranges + 1) * self.width)
        for r, array in enumerate(self.parts[name]):
            if array is not None and cuts[r] < cuts[r + 1]:
                out[cuts[r]:cuts[r + 1]] = array[ids[cuts[r]:cuts[r + 1]] - r * self.width]
        return out

    def _counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.words.firsts)
        for b, array in enumerate(self.counts):
            if cuts[b] < cuts[b + 1]:
                out[cuts[b]:cuts[b + 1]] = array[ids[cuts[b]:cuts[b + 1]] - self.words.firsts[b]]
        return out

    def __call__(self, column: pa.Array) -> dict[str, np.ndarray]:
        m = self.model
        ids, before, firsts = _token_ids(column, self.words)
        distinct, back = np.unique(ids, return_inverse=True)
        known = distinct >= 0
        count = np.zeros(len(distinct), np.int64)
        count[known] = self._counts(distinct[known])
        base = np.log10((count + 1.0) / (m.tokens + (m.n_words + 1.0)))
        seen = np.zeros(len(distinct))
        seen[known] = self._of("before", distinct[known], 0)
        lower = self._lower(seen)[back]
        firsts_of, context = np.unique(before, return_inverse=True)
        ok = firsts_of >= 0
        total, weight = np.zeros(len(firsts_of)), np.ones(len(firsts_of))
        total[ok], weight[ok] = self._of("totals", firsts_of[ok], 0), self._of("weights", firsts_of[ok], 1)
        total, weight = total[context], weight[context]
        held = np.zeros(len(ids))
        both = np.flatnonzero((ids >= 0) & (before >= 0))
        keys, where = np.unique(before[both].astype(np.uint64) << U(32) | ids[both].astype(np.uint64), return_inverse=True)
        found = self._bigram_counts(keys)
        less = np.select([found == 0, found == 1, found == 2], [0.0, m.by_count[0], m.by_count[1]], m.by_count[2])
        held[both] = (found - less)[where]
        p = np.where(total > 0, held / np.maximum(total, 1) + weight * lower, lower)
        starts = firsts[:-1]
        return {"n_tokens": np.diff(firsts), "n_known": np.add.reduceat((count > 0)[back].astype(np.int64), starts),
                "base_score": np.add.reduceat(base[back], starts), "score": np.add.reduceat(np.log10(p), starts)}

    def _lower(self, seen: np.ndarray) -> np.ndarray:
        m = self.model
        total, one, two, more = m.n_before
        uniform = 1.0 / (m.n_words + 1)
        if not total:
            return np.full(len(seen), uniform)
        less = np.select([seen == 0, seen == 1, seen == 2], [0.0, m.by_before[0], m.by_before[1]], m.by_before[2])
        left = (m.by_before[0] * one + m.by_before[1] * two + m.by_before[2] * more) / total
        return (seen - less) / total + left * uniform

    def _bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        bucket = bigram_bucket(keys, self.model.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.model.buckets + 1))
        out = np.zeros(len(keys), np.int64)
        for b, (stored, counts) in enumerate(self.bigrams):
            one = order[cuts[b]:cuts[b + 1]]
            if len(one) and len(stored):
                at = find(stored, keys[one])
                out[one] = np.where(at >= 0, counts[at], 0)
        return out


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
_SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(texts: DataFrame, model: Model) -> DataFrame:
    """Scores ``texts (doc_id, held_out, text)``; one narrow pass over the mapped model."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # names and a few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(("scorer", shared.value.path), lambda: Scorer(shared.value))
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                got = scorer(part.column("text"))
                got["train_tokens"] = np.full(part.num_rows, shared.value.tokens)
                got["perplexity"] = 10.0 ** np.minimum(300, -got["score"] / got["n_tokens"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(got[f.name], f.type) for f in list(_SCORES)[2:])], schema=_SCORES)

    return texts.mapInArrow(run, _SCORES_DDL)
