"""Scalar text functions as native Spark column expressions.

Every function here returns a ``Column`` built from ``pyspark.sql.functions``
so that it runs JVM-side inside whole-stage code generation; none of them is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/str.strip() treat as
# whitespace, written as a regex class valid in both Java and RE2.
PY_WHITESPACE = (
    "[\\t\\n\\x0B\\x0C\\r\\x1C\\x1D\\x1E\\x1F \\x{85}\\x{A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)

# Fixed value: a token is a maximal run of Unicode letters, digits and '_'
# (Java's plain \w is ASCII-only and would split 'Été').
TOKEN_PATTERN = "([\\p{L}\\p{N}_]+)"

# Fixed value: a sentence is a run without terminal punctuation or newline,
# plus its terminator if present.
SENTENCE_PATTERN = "[^.!?\\n]+[.!?]?"
# What lies between two sentences.
GAP_PATTERN = "[.!?\\n]+"

# Fixed value: a file-name part that is a date (YYYYMMDD), ASCII digits.
DATE_PART_PATTERN = "^[0-9]{8}$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same whitespace characters as one string, for
# character-set trimming.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing Python whitespace.

    Spark's one-argument ``trim`` removes only the space character; with a
    character set it strips any of them, without a regular expression.
    """
    return F.trim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def py_lstrip(c: Column | str) -> Column:
    """``str.lstrip()``: remove leading Python whitespace."""
    return F.ltrim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def py_split_ws(c: Column | str) -> Column:
    """``str.split()`` with no argument: whitespace split, no empty parts."""
    return F.filter(F.split(col_(c), f"{PY_WHITESPACE}+"), lambda t: t != F.lit(""))


def has_text(c: Column | str) -> Column:
    """Truthiness of ``s.strip()``: at least one non-whitespace character."""
    return F.coalesce(col_(c).rlike("[^" + PY_WHITESPACE[1:]), F.lit(False))


def tokens(c: Column | str) -> Column:
    """Index tokens of a text: lower-cased runs of letters, digits and '_'."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(TOKEN_PATTERN), 1)


def tokens_or_empty(c: Column | str) -> Column:
    return F.coalesce(tokens(c), F.array().cast("array<string>"))


def run_starts(sorted_col: Column, n: Column) -> Column:
    """1-based indexes where a new run of equal values starts in a sorted array."""
    return F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i <= n) & ((i == 1) | (F.get(sorted_col, i - 1) != F.get(sorted_col, i - 2))),
    )


def run_lengths(sorted_col: Column, starts: Column, n: Column) -> Column:
    """``array<struct<term, tf>>`` from a sorted array and its run starts."""
    return F.transform(
        starts,
        lambda st, j: F.struct(
            F.get(sorted_col, st - 1).alias("term"),
            (F.coalesce(F.get(starts, j + 1), n + 1) - st).cast("long").alias("tf"),
        ),
    )


def strip_extension(c: Column | str) -> Column:
    """``os.path.splitext(name)[0]``: drop the last extension, keeping
    leading-dot names such as ``.txt`` whole."""
    return F.regexp_replace(col_(c), "^(.*[^.].*)\\.[^.]*$", "$1")


def file_name_date(c: Column | str) -> Column:
    """First ``_``-separated part of exactly eight digits, as ``YYYY-MM-DD``.

    The extension stays on the last part, so ``a_20061117.txt`` has no date.
    """
    part = F.get(F.filter(F.split(col_(c), "_"), lambda p: p.rlike(DATE_PART_PATTERN)), 0)
    return F.when(part.isNotNull(),
                  F.concat(F.substring(part, 1, 4), F.lit("-"), F.substring(part, 5, 2),
                           F.lit("-"), F.substring(part, 7, 2)))


def find_pos(haystack: Column, needle: Column) -> Column:
    """``haystack.find(needle)``: 0-based character position or -1."""
    return F.instr(haystack, needle) - 1


def substr0(c: Column, start0: Column, length: Column) -> Column:
    """Python-style slice ``c[start0:start0+length]`` with a 0-based start."""
    return F.substr(c, start0 + 1, length)


def first_match_pos(content_lc: Column, query: Column) -> Column:
    """Smallest 0-based position of any whitespace-split term of the
    lower-cased query in ``content_lc`` (substring match); null if none."""
    terms = py_split_ws(F.lower(F.coalesce(query, F.lit(""))))
    return F.array_min(F.filter(F.transform(terms, lambda t: find_pos(content_lc, t)), lambda x: x >= 0))


def snippet_at(content_lc: Column, p: Column, before: int = 100, after: int = 300,
               head: int = 400) -> Column:
    """The preview for a precomputed match position ``p`` (see ``snippet``)."""
    start = F.greatest(F.lit(0), p - before)
    end = F.least(F.length(content_lc), p + after)
    ctx = F.when(p.isNull(), F.substr(content_lc, F.lit(1), F.lit(head))) \
        .otherwise(substr0(content_lc, start, end - start))
    return F.concat(F.lit("..."), ctx, F.lit("..."))


def snippet(content: Column | str, query: Column | str, before: int = 100,
            after: int = 300, head: int = 400) -> Column:
    """Search preview: lower-cased window around the first query-term match.

    Terms are the whitespace split of the lower-cased query, matched as
    substrings. The window is ``[max(0, p-before), min(len, p+after))`` around
    the smallest match position ``p``; with no match, the first ``head``
    characters. Wrapped in ``...``. (For many rows prefer ``with_snippet``,
    which evaluates ``p`` once per row.)
    """
    c = F.lower(F.coalesce(col_(content), F.lit("")))
    return snippet_at(c, first_match_pos(c, col_(query)), before, after, head)


def with_snippet(df, content: str, query: str, out: str = "preview", before: int = 100,
                 after: int = 300, head: int = 400):
    """Add column ``out`` with the snippet, computing the lower-cased content
    and the match position once per row (separate projections, each input
    used several times, so Catalyst keeps them apart)."""
    step = df.withColumn("_lc", F.lower(F.coalesce(F.col(content), F.lit(""))))
    step = step.withColumn("_p", first_match_pos(F.col("_lc"), F.col(query)))
    return step.withColumn(out, snippet_at(F.col("_lc"), F.col("_p"), before, after, head)).drop("_lc", "_p")
