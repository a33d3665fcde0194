"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback encodes every word of a text. Characters
per token, the share of byte-fallback tokens and the entropy of the token
counts are held against bands per language; a text outside its band is
rejected. Two plain rules come first: too few words, and too many words in
repeated three-word windows.

Two kinds of bands hold. Those set by hand are wide: prose of a language the
vocabulary knows well or badly stays inside, while text in another writing
system than its language's and encoded blobs fall outside. ``fit`` learns
narrower ones from all texts that pass the base rules: for each language and
each doubling of a text's length (entropy grows with it) the median and the
median deviation from it, both read from counts by thousandths, so that the
result is the same however Spark divides the rows. Texts of equal measures
count once, as copies must not set what is usual. A class of fewer than
``LEAST_TEXTS`` such texts has the bands of the next shorter class, or none but
those set by hand.

Defined results: a null text has no words and fails the base rules, as does an
empty one; null ids and languages are kept as they are, an unknown language has
the default band, and fitted bands of its own where it has texts enough;
repeated rows are judged one by one, all alike; a very long text is measured
whole, in one array of its token ids; a measure on the edge of a band is
inside; an empty table has no bands and no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.sizing import MAX_BROADCAST_ROWS, count_upto, maybe_broadcast

from . import hashing
from .common import Remembered, once, slices, texts, vocabulary, written

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

# language: least and most characters per token, most byte-fallback share, least token entropy in bits
BANDS = {
    "en": (1.6, 7.0, 0.05, 4.2),
    "de": (1.6, 7.0, 0.05, 4.2),
    "fr": (1.4, 7.0, 0.05, 4.2),
    "es": (1.4, 7.0, 0.05, 4.2),
    "it": (1.4, 7.0, 0.05, 4.2),
    "pt": (1.4, 7.0, 0.05, 4.2),
    "ru": (1.2, 6.0, 0.10, 4.2),
    "zh": (0.4, 3.0, 0.60, 4.2),
    "ja": (0.4, 3.0, 0.60, 4.2),
    "ko": (0.4, 3.0, 0.70, 4.2),
    "": (0.3, 8.0, 0.75, 3.5),
}

# Fitted bands: thousandths are counted; how many deviations from the median a text may lie (3.5 is the usual bound of
# the modified z-score; a key or an address in a short text moves the characters per token, which get twice that); and
# the least deviation that is assumed, in the measure's own unit.
LEAST_TEXTS = 100
GRID = 1000
NORMAL = 1.4826  # standard deviations in a median deviation
WIDTHS = {"chars_per_token": 7.0, "byte_share": 7.0, "token_entropy": 3.5}
LEAST_DEVIATION = {"chars_per_token": 0.02, "byte_share": 0.005, "token_entropy": 0.05}
MAX_OCTAVE = 62


class Fertility:
    """Token statistics of a text's words under a vocabulary with byte fallback."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(k) for k in range(size)), bool, size)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.words = Remembered(self._word, 48 << 20)

    def _word(self, word: bytes) -> bytes:
        return np.asarray(self.model.encode(word.decode()), self.dtype).tobytes()

    def __call__(self, text: bytes) -> tuple[int, int, float]:
        """Tokens, byte-fallback tokens, entropy in bits."""
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), self.dtype)
        if not len(ids):
            return 0, 0, 0.0
        counts = np.bincount(ids)
        counts = counts[counts > 0]
        share = counts / len(ids)
        return len(ids), int(self.is_byte[ids].sum()), float(-(share * np.log2(share)).sum()) + 0.0


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Words, characters in words, symbols and words in repeated three-word windows of each text."""
    data, offsets = hashing.buffer(column)
    starts, ends, hashes, firsts = hashing.words(data, offsets, lower=False)

    def summed(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_words = np.diff(firsts)
    row = hashing.rows_of(firsts)
    windows = hashing.grams(hashes, 3)
    whole = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    keys = hashing.mix64(windows + row[:len(windows)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[whole]
    at = np.flatnonzero(whole)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(row) + 1, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    repeats = np.bincount(row[covered[:-1]], minlength=len(n_words))
    return {"n_words": n_words, "word_chars": summed(~hashing.SEPARATOR[data] & ((data & 0xC0) != 0x80)),
            "n_symbols": summed(symbol[data]), "n_repeat_words": repeats}


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    return len(lines) - len(set(lines))


_MEASURES = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                       ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("token_entropy", pa.float64())])
_MEASURES_DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
                 "n_byte_tokens long, token_entropy double")


def _measured(rows: DataFrame, name: str, carry: bool) -> DataFrame:
    """The measures of ``text`` beside all columns of ``rows``, or beside all but the text; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = once(("fertility", name), lambda: Fertility(name))
        for batch in batches:
            for part in slices(batch, "text"):
                base = base_counts(part.column("text"))
                raw = texts(part, "text")
                stats = [fertility(t) for t in raw]
                base |= {"n_dup_lines": [repeated_lines(t) for t in raw], **{k: [s[j] for s in stats] for j, k in enumerate(_MEASURES.names[5:])}}
                kept = [(part.schema.field(k), part.column(k)) for k in part.schema.names if carry or k != "text"]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(pa.array(base[f.name], f.type) for f in _MEASURES)],
                                                 schema=pa.schema([*(f for f, _ in kept), *_MEASURES]))

    fields = [f for f in rows.schema.fields if carry or f.name != "text"]
    return rows.mapInArrow(run, StructType(fields + StructType.fromDDL(_MEASURES_DDL).fields))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", name: str = VOCABULARY) -> DataFrame:
    """``doc_id, lang`` and the counts and token statistics of every text."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return _measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text")), name, False)


def good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", name: str = VOCABULARY) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` that all rules keep, and the tables that they are read from. The texts are measured once and
    written beside their measures, from which the bands are fitted."""
    columns = {f"_{k}": F.col(c) for k, c in enumerate(docs.columns) if c != text_col}
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(text_col).alias("text"), lang.alias("lang"), *[c.alias(k) for k, c in columns.items()])
    measured, path = written(_measured(rows, name, True), "measured-texts")
    bands, bands_path = fit(measured)
    kept = judge(measured, bands).where("kept")
    return kept.select(*[F.col("text" if c == text_col else f"_{k}").alias(c) for k, c in enumerate(docs.columns)]), [path, bands_path]


def _rated(measured: DataFrame) -> DataFrame:
    """Adds ``chars_per_token, byte_share, base_failed``, and the class of a text: ``language`` and ``octave``."""
    some = F.col("n_tokens") > 0
    return measured.withColumns({
        "chars_per_token": F.when(some, F.col("word_chars") / F.col("n_tokens")).otherwise(F.lit(0.0)),
        "byte_share": F.when(some, F.col("n_byte_tokens") / F.col("n_tokens")).otherwise(F.lit(0.0)),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "language": F.coalesce(F.lower("lang"), F.lit("")),
        "octave": F.when(some, F.length(F.bin("n_tokens")) - 1).otherwise(F.lit(0)).cast("int")})


_CLASS = ["language", "octave", "measure"]


def _middle(counts: DataFrame) -> DataFrame:
    """``middle`` (the lower median of ``bin``) and ``total`` of each class and measure. A class has as many rows as a
    measure has thousandths, however many texts there are."""
    whole = Window.partitionBy(*_CLASS)
    summed = counts.withColumns({"upto": F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(whole)})
    return summed.where(2 * F.col("upto") >= F.col("all")).groupBy(*_CLASS).agg(F.min("bin").alias("middle"), F.max("all").alias("total"))


def fit(measured: DataFrame) -> tuple[DataFrame, str]:
    """``language, octave, least_chars, most_chars, most_share, least_entropy`` from all texts that pass the base rules, as
    a written table, and its path.

    The deviation of a class is at least the median one of its language's classes: a class that near copies fill must not
    shut out the rest. As entropy grows with a text's length, no class asks for more of it than a class of longer texts.
    """
    used = _rated(measured).where("not base_failed and n_tokens > 0").select("language", "octave", "n_words", "word_chars", "n_tokens", "n_byte_tokens", *WIDTHS).distinct()
    bins = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * GRID + 0.5).alias("bin")) for m in WIDTHS])
    counts = used.select("language", "octave", F.inline(bins)).groupBy(*_CLASS, "bin").agg(F.count("*").alias("n"))
    middles = _middle(counts).where(F.col("total") >= LEAST_TEXTS)
    aside = counts.join(middles.select(*_CLASS, F.col("middle").alias("m")), _CLASS)
    aside = aside.groupBy(*_CLASS, F.abs(F.col("bin") - F.col("m")).alias("bin")).agg(F.sum("n").alias("n"))
    spread = middles.join(_middle(aside).select(*_CLASS, F.col("middle").alias("deviation")), _CLASS)
    usual = F.median("deviation").over(Window.partitionBy("language", "measure"))
    named = {k: F.create_map(*[x for m in WIDTHS for x in (F.lit(m), F.lit(v[m]))])[F.col("measure")] for k, v in (("width", WIDTHS), ("least", LEAST_DEVIATION))}
    room = named["width"] * F.greatest(NORMAL * F.greatest("deviation", usual) / GRID, named["least"])
    fences = spread.select("language", "octave", "measure", (F.col("middle") / GRID - room).alias("low"), (F.col("middle") / GRID + room).alias("high"))

    def fence(side: str, measure: str):
        return F.max(F.when(F.col("measure") == measure, F.col(side)))

    bands = fences.groupBy("language", "octave").agg(
        fence("low", "chars_per_token").alias("least_chars"), fence("high", "chars_per_token").alias("most_chars"),
        fence("high", "byte_share").alias("most_share"), fence("low", "token_entropy").alias("least_entropy"))
    longer = Window.partitionBy("language").orderBy("octave")
    bands = bands.withColumns({"least_entropy": F.min("least_entropy").over(longer.rowsBetween(0, Window.unboundedFollowing)),
                               "next": F.coalesce(F.lead("octave").over(longer), F.lit(MAX_OCTAVE + 1))})
    return written(bands.withColumn("octave", F.explode(F.sequence("octave", F.col("next") - 1))).drop("next"), "fertility-bands")


def judge(measured: DataFrame, fitted: DataFrame | None = None, bands: dict[str, tuple[float, float, float, float]] = BANDS) -> DataFrame:
    """Adds ``chars_per_token, byte_share, base_failed, in_band, kept`` and ``outside``: the names of the measures that lie
    outside a band. Without ``fitted`` (see ``fit``) only the bands set by hand hold."""
    rated = _rated(measured)
    known = F.create_map(*[x for lang, band in bands.items() for x in (F.lit(lang), F.array(*map(F.lit, band)))])
    rated = rated.withColumn("band", F.coalesce(known[F.col("language")], known[F.lit("")]))
    least_chars, most_chars, most_share, least_entropy = (F.col("band")[k] for k in range(4))
    added: list[str] = []
    if fitted is not None:
        # rows grow with the languages, which nothing bounds, so their size is checked
        rated = rated.join(maybe_broadcast(fitted, count_upto(fitted, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS), ["language", "octave"], "left")
        added = ["least_chars", "most_chars", "most_share", "least_entropy"]
        # greatest and least pass over the nulls of a class without bands
        least_chars, most_chars = F.greatest(least_chars, "least_chars"), F.least(most_chars, "most_chars")
        most_share, least_entropy = F.least(most_share, "most_share"), F.greatest(least_entropy, "least_entropy")
    out = F.array_compact(F.array(
        F.when(~F.col("chars_per_token").between(least_chars, most_chars), F.lit("chars_per_token")),
        F.when(F.col("byte_share") > most_share, F.lit("byte_share")),
        F.when(F.col("token_entropy") < least_entropy, F.lit("token_entropy"))))
    judged = rated.withColumn("outside", F.array_join(out, ",")).withColumn("in_band", F.col("outside") == "")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop("band", "language", "octave", *added)
