"""Best-fit packing by linear grouping.

Lengths above a threshold are sorted and dealt into groups of equal
cardinality, each rounded up to its longest member; what is left is a cutting
problem of few sizes, solved by column generation over configurations (the
multisets of sizes that fit a sequence). Every configuration's places are then
taken by actual documents of its groups, and the shorter pieces fill the room
that is really left, best fit first. Rounding up wastes room that only shorter
pieces give back, so a few thresholds (``THRESHOLDS``) and numbers of groups are tried
on the counts by length, which tell each one's sequences exactly; the fewest win.

Only counts by length (at most ``capacity`` of them) reach the driver, and only
ranges of ranks (a number bounded by groups and capacity, whatever the rows)
go back; the pieces themselves are ranked, placed and summed by Spark.

Defined results: a null or empty text is its end id alone, one piece of one
token; repeated rows are packed one by one; a null id stays null; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts, written
from .tokens import encoder

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END = 2
GROUPS = 64
SMALL = 96  # pieces of at most so many tokens are packed last, by best fit
THRESHOLDS = (384, 448, 512)  # what ``pack`` tries for it
_BLOCK = 1 << 16

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("part", pa.int32()), ("turn", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Each text's ids and the end id, in pieces of ``capacity``, the first one shorter; ``turn`` counts the pieces of
    one length within ``part``, the task. Write the result once before use, as tasks may be dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(name, "uint16", added=True).encode
        part, turns = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts(rows, "text")):
                    ids = np.append(np.frombuffer(ids_of(text.decode()), np.uint16), np.uint16(end)).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b]), part, int(turns[b - a])))
                        turns[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), _PIECES.types)], schema=_PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES_DDL)


# ------------------------------------------------- plans over counts by length


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sized, valued = sizes[order], values[order]
    for c in range(1, capacity + 1):
        n = np.searchsorted(sized, c, "right")
        best[c] = best[c - 1]
        if n:
            gain = best[c - sized[:n]] + valued[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], choice[c] = gain[k], order[k]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how often to use them, so that every size's demand is met exactly."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    uses = demand / np.diag(basis)
    for _ in range(60 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(direction > 1e-9, uses / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        uses = uses - ratio[out] * direction
        uses[out] = ratio[out]
        basis[:, out] = column
    left, found = demand.astype(np.int64).copy(), []
    for j in np.argsort(-uses):
        column = basis[:, j].astype(np.int64)
        held = column > 0
        if times := min(int(uses[j] + 1e-6), int((left[held] // column[held]).min())):
            left -= times * column
            found.append((column, times))
    while left.any():  # what rounding the uses down has left: few, always the best configuration of those
        open_ = left > 0
        column, room = np.zeros(k, np.int64), capacity
        for j in np.argsort(-sizes):
            if open_[j] and sizes[j] <= room:
                column[j] = min(left[j], room // sizes[j])
                room -= column[j] * sizes[j]
        held = column > 0
        times = int((left[held] // column[held]).min())
        left -= times * column
        found.append((column, times))
    return found


def plan_large(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """For the pieces longer than ``small`` in descending order of length: rows (first rank, first sequence, place), each
    holding until the next row's first rank; and the number of sequences. ``counts``: pieces of each length."""
    lengths = np.arange(capacity, small, -1)
    n = counts[lengths]
    total, alone = int(n.sum()), int(counts[capacity])
    rows, bins = [], 0
    if alone:  # a full piece is a sequence
        rows.append((0, 0, 0))
        bins = alone
    rest = total - alone
    if rest:
        size = -(-rest // groups)
        firsts = np.arange(alone, total, size)
        lasts = np.minimum(firsts + size, total)
        longest = lengths[np.searchsorted(np.cumsum(n), firsts, "right")]
        # groups with one longest member are one size
        sizes, which = np.unique(-longest, return_inverse=True)
        sizes = -sizes
        begin = np.array([firsts[which == g].min() for g in range(len(sizes))])
        demand = np.array([(lasts - firsts)[which == g].sum() for g in range(len(sizes))])
        taken = begin.copy()
        for column, times in configurations(sizes, demand, capacity):
            place = 0
            for g in np.flatnonzero(column):
                for _ in range(column[g]):
                    rows.append((int(taken[g]), bins, place))
                    taken[g] += times
                    place += 1
            bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3), bins


def rooms_left(counts: np.ndarray, plan: np.ndarray, capacity: int, small: int) -> dict[int, int]:
    """How many sequences of ``plan_large``'s rows have each room left, from the counts alone: along the uses of a
    configuration its places hold runs of equal lengths."""
    ends = np.cumsum(counts[np.arange(capacity, small, -1)])
    columns, rooms = defaultdict(list), defaultdict(int)
    for (first, at, _), end in zip(plan.tolist(), [*plan[1:, 0].tolist(), int(ends[-1])]):
        columns[at].append((first, end - first))
    for places in columns.values():
        times = places[0][1]
        cuts = {0, times}
        for first, _ in places:
            cuts.update((ends[(ends > first) & (ends < first + times)] - first).tolist())
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            rooms[capacity - sum(capacity - int(np.searchsorted(ends, first + a, "right")) for first, _ in places)] += b - a
    return rooms


def best_plan(counts: np.ndarray, capacity: int, smalls: tuple[int, ...], groups: int) -> tuple[int, np.ndarray, int]:
    """The threshold, rows and sequences of ``plan_large`` after which the fewest sequences are needed in all."""
    tried = []
    for small in sorted({min(s, capacity - 1) for s in smalls}):
        # coarser groups round lengths up further, but leave fewer uses to round down; they can win on few documents
        for k in (1, 2, 4):
            plan, bins = plan_large(counts, capacity, small, max(1, groups // k))
            _, fresh = plan_small(counts, rooms_left(counts, plan, capacity, small), capacity, small)
            tried.append((bins + fresh, small, k, plan, bins))
    _, small, _, plan, bins = min(tried, key=lambda t: t[:3])
    return small, plan, bins


def plan_small(counts: np.ndarray, rooms: dict[int, int], capacity: int = CAPACITY, small: int = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit of the short pieces, longest first: rows (length, first rank, room, first rank of the sequences that had this
    room, place), where room ``capacity`` means new sequences; and the number of new sequences. ``rooms``: sequences by room left."""
    state = defaultdict(list)  # room left now: ranges of sequences (room at first, first rank, end)
    for room, n in rooms.items():
        if room > 0 and n:
            state[room].append((room, 0, n))
    rows, fresh, place = [], 0, 1 << 20
    for length in range(min(small, capacity), 0, -1):
        at, n = 0, int(counts[length])
        while at < n:
            room = min((r for r, ranges in state.items() if r >= length and ranges), default=None)
            if room is None:
                more = -(-(n - at) // (capacity // length))
                state[capacity].append((capacity, fresh, fresh + more))
                fresh += more
                continue
            first_room, a, b = state[room].pop()
            take = min(b - a, n - at)
            rows.append((length, at, first_room, a, place))
            place += 1
            at += take
            state[room - length].append((first_room, a, a + take))
            if a + take < b:
                state[room].append((first_room, a + take, b))
    return rows, fresh


# ------------------------------------------------------------------ placement


def _ranked(df: DataFrame, classes: str, turn: str, block: str) -> DataFrame:
    """Adds ``rank``: rows of a class are counted through over the blocks, within which ``turn`` counts them. A class's blocks, not its rows, meet in one task."""
    blocks = df.groupBy(classes, block).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(classes).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(classes, block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return df.join(blocks, [classes, block]).withColumn("rank", F.col("before") + F.col(turn)).drop("before")


def _in_ranges(df: DataFrame, key: str, firsts: np.ndarray, found: dict[str, np.ndarray]) -> DataFrame:
    """Adds the columns of the last range that begins at or before ``key``, and ``into``, the rows since its beginning."""
    schema = df.select("*", F.lit(0).cast("long").alias("into"), *[F.lit(0).cast("long").alias(k) for k in found]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            at = np.searchsorted(firsts, keys, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys - firsts[at]), *(pa.array(v[at]) for v in found.values())],
                                             names=[*batch.schema.names, "into", *found])

    return df.mapInArrow(run, schema)


def pack(split: DataFrame, capacity: int = CAPACITY, smalls: tuple[int, ...] = THRESHOLDS, groups: int = GROUPS) -> tuple[DataFrame, list[str]]:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``; and the paths of tables it wrote on the way."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in split.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    ranked = _ranked(split, "length", "turn", "part").drop("part", "turn")

    small, plan, bins = best_plan(counts, capacity, smalls, groups)
    longer = np.zeros(capacity + 1, np.int64)  # pieces longer than this
    longer[:-1] = np.cumsum(counts[::-1])[::-1][1:]
    before = F.element_at(F.array(*[F.lit(int(x)) for x in longer]), F.col("length").cast("int") + 1)
    plan = plan if len(plan) else np.zeros((1, 3), np.int64)
    large = _in_ranges(ranked.where(F.col("length") > small).withColumn("rank", F.col("rank") + before), "rank", plan[:, 0], {"bin": plan[:, 1], "place": plan[:, 2]})
    large = large.withColumn("sequence_id", F.col("bin") + F.col("into")).drop("bin", "into", "rank")
    paths: list[str] = []
    if counts[1:small + 1].any():
        large, path = written(large, "packed-large")
        paths.append(path)
        room = large.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room"))
        room, path = written(room.where("room > 0"), "packed-rooms")
        paths.append(path)
        rooms = {r["room"]: r["count"] for r in room.groupBy("room").count().collect()}  # below ``capacity`` rows
        rows, _ = plan_small(counts, rooms, capacity, small)
        fits = np.array(sorted(rows), np.int64).reshape(-1, 5)
        # one key for length and rank, as the ranges of all lengths are searched together
        width = int(counts.max()) + 1
        tail = _in_ranges(ranked.where(F.col("length") <= small).withColumn("key", F.col("length") * F.lit(width) + F.col("rank")), "key",
                          fits[:, 0] * width + fits[:, 1], {"room": fits[:, 2], "a": fits[:, 3], "place": fits[:, 4]})
        tail = tail.withColumn("nth", F.col("a") + F.col("into")).drop("key", "a", "into", "rank")
        block = F.floor(F.col("sequence_id") / _BLOCK)
        turn = F.row_number().over(Window.partitionBy("room", "block").orderBy("sequence_id")) - 1
        numbered = _ranked(room.withColumn("block", block).withColumn("turn", turn), "room", "turn", "block").select("room", F.col("rank").alias("nth"), "sequence_id")
        old = tail.where(F.col("room") < capacity).join(numbered, ["room", "nth"])
        new = tail.where(F.col("room") == capacity).withColumn("sequence_id", F.col("nth") + bins)
        large = large.unionByName(old.select(large.columns)).unionByName(new.select(large.columns))
    places = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = large.withColumn("offset", F.coalesce(F.sum("length").over(places), F.lit(0)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), paths
