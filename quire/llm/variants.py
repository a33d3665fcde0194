"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Words are counted over whole texts, then compared as a vocabulary. Of a pair of
words, the longer one (either, of equal lengths) contributes two disjoint chunks,
its first and its last ``length // 2`` code points; the other contributes its
positional grams of that size. One edit spares one of the chunks, so the pair
meets on it, at places that differ by the lengths' difference at most, which is
one. A gram at a place that no chunk can take by such a shift meets nothing and
isn't made.

A chunk that very many words hold ("tion") would bring all of them together. So
the same argument is used on what a chunk leaves of its word: one edit spares
one of the two chunks of that rest as well, and a pair is joined on the chunk
and the rest's chunk, ``DEPTH`` chunks in all. Joined words are verified by
their edit distance.

No join here broadcasts a side. Spark takes a side's size from that of the
table's files, which are compressed and have one row where an explode makes up
to eight, so what it takes for 10 MB can be more than a driver holds.

Defined results: null and empty texts have no words; a null id is the empty
string in front of the colon; rows of one id each count; long texts are read in
pieces that end between runs; of near words with the same count the first in
code-point order is taken; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, texts, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
DROP_EVERY = 97
DEPTH = 2
PIECE = 1 << 22  # code points of a text that are split into words at a time
HELD = 200_000  # words that a task counts before it hands them on


def pieces(text, outside: re.Pattern, most: int = PIECE) -> Iterator:
    """A text in pieces of about ``most``, each cut where ``outside`` matches."""
    at = 0
    while len(text) - at > most:
        cut = outside.search(text, at + most)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def spelled(run: str, before: int, every: int = DROP_EVERY) -> str:
    """The run, or where ``every`` divides its checksum the run without the code point that the checksum names.
    ``before``: the checksum of what stands in front of the run."""
    h = zlib.crc32(run.encode(), before)
    if h % every:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all words of at least ``least_length`` code points and ``least_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shorter runs have no word of the least length
        runs, outside = re.compile(f"[{LETTERS}]{{{least_length},}}"), re.compile(f"[^{LETTERS}]")
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for rows in slices(batch, "text"):
                for doc_id, text in zip(rows.column("id").to_pylist(), texts(rows, "text")):
                    before = zlib.crc32(f"{doc_id}:".encode())
                    for piece in pieces(text.lower().decode(), outside):
                        for found, n in Counter(runs.findall(piece)).items():
                            word = spelled(found, before)
                            if len(word) >= least_length:
                                counts[word] += n
                    if len(counts) >= HELD:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _ends(length: Column, depth: int = DEPTH) -> list[tuple[Column, Column]]:
    """How much of a word's front and of its back the chunks of each choice hold: at each step the front's or the
    back's half of what the steps before left."""
    choices = [(F.lit(0), F.lit(0))]
    for _ in range(depth):
        halves = [(front, back, F.floor((length - front - back) / 2).cast("int")) for front, back in choices]
        choices = [ends for front, back, half in halves for ends in ((front + half, back), (front, back + half))]
    return choices


def signatures(word: Column, length: Column, depth: int = DEPTH) -> Column:
    """A 64-bit key for every choice of chunks that a word of ``length`` code points has, as ``word`` holds them at its
    own front and back. Equal keys of different chunks do no harm, as pairs are verified."""
    # the same front and back can be reached by several choices
    return F.array_distinct(F.array(*[F.xxhash64(length, front, F.left(word, front), F.right(word, back)) for front, back in _ends(length, depth)]))


def near_words(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``a, a_n, b, b_n``: all pairs of words one edit apart, each once, ``a`` the longer or the later one."""
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(signatures(F.col("word"), size, depth)).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"),
                         F.explode(F.array_union(signatures(F.col("word"), size, depth), signatures(F.col("word"), size + 1, depth))).alias("key"))
    once = (F.length("a") > F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") > F.col("b")))
    met = chunks.join(grams.hint("merge"), (chunks["key"] == grams["key"]) & once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def forms(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``word, n, n_near, form, form_n``: a word's form is its most frequent near word, if at least twice as frequent."""
    pairs = near_words(words, depth)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("p")).select("p.*")
    # UTF-8 strings compare in code-point order
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    often = -F.col("best.less") >= 2 * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.other")).alias("form"),
                        F.when(often, -F.col("best.less")).alias("form_n"))


def rooted(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """``found`` with ``root``, the last form that a word leads to (itself without one); and the paths written. A form's
    count is at least twice that of its word, so no way leads back. Each round doubles the steps that a word has gone."""
    spark = found.sparkSession
    steps, path = written(found.where("form is not null").select("word", F.col("form").alias("root")), "variants-steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        gone, next_path = written(steps.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-steps")
        drop(spark, path)
        steps, path = gone.select("word", "root"), next_path
        if not gone.where("moved").limit(1).count():
            return found.join(steps.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word")), [path]


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> tuple[DataFrame, list[str]]:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus; and the paths written."""
    words, words_path = written(word_counts(docs, id_col, text_col), "variants-words")
    found, found_path = written(forms(words, depth), "variants-forms")
    out, paths = rooted(found)
    return out.select("word", "form", "root", "n", "n_near", "form_n"), [words_path, found_path, *paths]
