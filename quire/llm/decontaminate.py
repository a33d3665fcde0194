"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item may appear in a text with up to ``RATE`` of its characters
edited. It is cut into one piece more than that error budget: at least one
piece of any such appearance is unedited. An Aho-Corasick automaton of all
pieces finds the exact hits in one pass over a text; around each hit Myers'
bit-parallel automaton gives the least edit distance of the whole item to any
stretch there, and the budget decides.

Items and texts are compared in lower case, with every run of ASCII characters
other than letters and digits as one space.

The items are a stated query set: blocks of ``BLOCK_BYTES`` of normalised text
are held against all texts, one pass for each block, whatever their number.

Defined results: null, empty and short items (below ``LEAST`` characters) match
nothing, nor do null and empty texts; a null id is given as it is; repeated
rows give a row each, equal items too; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, slices, texts

RATE = 0.06
LEAST = 25
BLOCK_BYTES = 16 << 20

_KEEP = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def normal(text: str) -> str:
    return b" ".join(text.lower().encode().translate(_KEEP).split()).decode()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, with where they begin."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance of a pattern to any stretch of a text, one integer operation for a whole column."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def best(self, text: str, budget: int) -> tuple[int, int] | None:
        """The least distance up to ``budget`` and the first end with it."""
        ones, top, masks = (1 << self.length) - 1, 1 << self.length - 1, self.masks
        up, down, score, found = ones, 0, self.length, None
        for at, c in enumerate(text, 1):
            match = masks.get(c, 0)
            across = match | down
            match = (((match & up) + up) ^ up) | match
            rise = down | ~(match | up) & ones
            fall = up & match
            score += bool(rise & top) - bool(fall & top)
            rise = rise << 1 & ones  # a stretch may begin anywhere: nothing comes in from above
            fall = fall << 1 & ones
            up = fall | ~(across | rise) & ones
            down = rise & across
            if score <= budget and (found is None or score < found[0]):
                found = score, at
        return found


class Block:
    """The automaton of some items' pieces."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items, found = [], {}
        for item_id, item in items:
            budget = int(rate * len(item))
            for at, piece in pieces(item, budget):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, item, budget))
        self.verifiers: dict[int, Myers] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item number, distance, and about where it begins and where it ends, for the best appearance of each item."""
        diagonals: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                diagonals.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k, found in diagonals.items():
            _, item, budget = self.items[k]
            if k not in self.verifiers:
                self.verifiers[k] = Myers(item)
            best, reach = None, None
            for d in sorted(found):  # diagonals within a budget of each other share a window
                if reach is not None and d <= reach[1] + budget:
                    reach[1] = d
                    continue
                if reach:
                    best = self._better(best, k, text, reach)
                reach = [d, d]
            best = self._better(best, k, text, reach)
            if best:
                out.append((k, *best))
        return out

    def _better(self, best, k: int, text: str, reach: list[int]):
        _, item, budget = self.items[k]
        a, b = max(0, reach[0] - budget), min(len(text), reach[1] + len(item) + budget)
        if b - a < len(item) - budget:
            return best
        limit = budget if best is None else best[0] - 1
        hit = self.verifiers[k].best(text[a:b], limit) if limit >= 0 else None
        return (hit[0], max(0, a + hit[1] - len(item)), a + hit[1]) if hit else best


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, least: int, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The normalised items in blocks of about ``most`` bytes; one block at a time is on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").toLocalIterator():
        item = normal(row["text"])
        if len(item) < least:
            continue
        if size + len(item.encode()) > most and block:
            yield block
            block, size = [], 0
        block.append((row["id"], item))
        size += len(item.encode())
    if block:
        yield block


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_DDL = "doc_id long, item_id long, distance int, budget int, start long, end long"


def _spans(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of the normalised text as places of the text itself, widened to whole words."""
    begins, at = [], 0
    for m in _WORD.finditer(text.lower()):
        begins.append((at, m.start(), m.end()))
        at += m.end() - m.start() + 1
    out = []
    for a, b in found:
        inside = [w for w in begins if w[0] < b and w[0] + w[2] - w[1] > a]
        out.append((inside[0][1], inside[-1][2]) if inside else (0, 0))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", rate: float = RATE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item in it: the edit distance, the item's budget, and where (code points of the
    lower-cased text, whole words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    out = None
    for items in blocks_of(benchmark, item_id_col, item_text_col, least, block_bytes):
        shared = spark.sparkContext.broadcast((items, rate))  # at most ``block_bytes`` of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            block = once(("items", number), lambda: Block(*shared.value))
            for batch in batches:
                for part in slices(batch, "text"):
                    found = []
                    for doc_id, raw in zip(part.column("doc_id").to_pylist(), texts(part, "text")):
                        text = raw.decode()
                        hits = block.matches(normal(text))
                        if hits:
                            for (k, distance, _, _), (a, b) in zip(hits, _spans(text, [h[2:] for h in hits])):
                                found.append((doc_id, block.items[k][0], distance, block.items[k][2], a, b))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _SCHEMA.types)], schema=_SCHEMA)

        one = rows.mapInArrow(run, _DDL)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], _DDL)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
          rate: float = RATE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item; they pass through the narrow pass itself, with no join."""
    spark = docs.sparkSession
    for items in blocks_of(benchmark, item_id_col, item_text_col, least, block_bytes):
        shared = spark.sparkContext.broadcast((items, rate))  # at most ``block_bytes`` of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            block = once(("items", number), lambda: Block(*shared.value))
            for batch in batches:
                for part in slices(batch, text_col):
                    yield part.filter(pa.array([not block.matches(normal(raw.decode())) for raw in texts(part, text_col)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
