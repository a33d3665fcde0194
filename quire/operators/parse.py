"""Article shaping: raw header-block files → typed article rows.

One bulk job over a ``raw_files`` DataFrame, native expressions only. File
layout: ``Key: value`` header lines, a line that strips to ``---``, then the
body. Every ``---`` line is dropped (also inside the body); a file without one
is all header and has an empty body.

Each stage is its own projection whose outputs are referenced several times
by the next, so Catalyst does not collapse them and re-evaluate an array
expression inside a higher-order function's lambda.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE, file_name_date, has_text, py_strip, strip_extension

# Fixed values.
SEPARATOR = "---"
DEFAULT_AUTHOR = "Unknown"
PROVENANCE = "archive"
DATE_FORMAT = "yyyy-MM-dd"
ID_HEX_CHARS = 24
UNREADABLE = "unreadable file"


def decode_files(raw_files: DataFrame) -> DataFrame:
    """Strict UTF-8 text with newlines normalised (``\\r\\n``, ``\\r`` → ``\\n``).

    Bytes that are not valid UTF-8 give an error row instead of text.
    """
    as_text = F.col("content").cast("string")
    valid = F.is_valid_utf8(as_text)
    return raw_files.select(
        "filename",
        F.when(valid & (F.instr(as_text, "\r") > 0), F.regexp_replace(as_text, "\r\n?", "\n"))
        .when(valid, as_text).alias("text"),
        F.when(F.col("content").isNull(), F.lit(UNREADABLE))
        .when(~valid, F.lit("'utf-8' codec can't decode the file")).alias("error"),
    )


# A line that strips to the separator, as one anchored match (no string copy).
SEPARATOR_LINE = f"^{PY_WHITESPACE}*{SEPARATOR}{PY_WHITESPACE}*$"


def is_separator(line) -> F.Column:
    return line.rlike(SEPARATOR_LINE)


def article_id_for(filename) -> F.Column:
    """Deterministic store id: the first 24 hex digits of SHA-256(filename)."""
    return F.substring(F.sha2(filename, 256), 1, ID_HEX_CHARS)


def split_header_body(texts: DataFrame) -> DataFrame:
    """P1 + P2 on ``(…, text)``: adds ``header MAP``, ``header_text``, ``body``."""
    keep = [c for c in texts.columns if c != "text"]
    s1 = texts.select(*keep, F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"))
    s2 = s1.select(*keep, "_lines",
                   F.transform("_lines", lambda l: is_separator(l)).alias("_sep"))
    s3 = s2.select(*keep, "_lines", "_sep", F.array_position("_sep", True).cast("int").alias("_first"))
    n = F.size("_lines")
    first = F.col("_first")
    header_lines = F.when(first == 0, F.col("_lines")).otherwise(F.slice("_lines", F.lit(1), first - 1))
    body_lines = F.when(first == 0, F.array().cast("array<string>")).otherwise(
        F.filter(F.slice("_lines", first + 1, F.greatest(n - first, F.lit(0))),
                 lambda l: ~is_separator(l)))
    s4 = s3.select(*keep, header_lines.alias("_hl"),
                   F.array_join(body_lines, "\n").alias("body"))
    # key/value pairs with their line order; the last duplicate key wins
    s5 = s4.select(*keep, "body", F.transform(
        F.filter("_hl", lambda l: F.instr(l, ":") > 0),
        lambda l, i: F.struct(
            F.lower(py_strip(F.substring_index(l, ":", 1))).alias("key"),
            i.alias("pos"),
            py_strip(F.substr(l, F.instr(l, ":") + 1)).alias("value"))).alias("_pairs"))
    s6 = s5.select(*keep, "body", F.sort_array("_pairs").alias("_sp"))
    s7 = s6.select(*keep, "body", F.filter(
        "_sp", lambda p, j: F.coalesce(F.get(F.col("_sp"), j + 1).getField("key") != p.getField("key"),
                                       F.lit(True))).alias("_last"))
    return s7.select(
        *keep, "body",
        F.map_from_entries(F.transform("_last", lambda p: F.struct(p.getField("key"), p.getField("value"))))
        .alias("header"),
        F.array_join(F.transform("_last", lambda p: F.concat(p.getField("key"), F.lit("="), p.getField("value"))),
                     "\n").alias("header_text"))


def parse_articles(raw_files: DataFrame, date_policy: str = "text", skip_blank: bool | None = None,
                   run_ts: str | None = None) -> DataFrame:
    """Parse ``raw_files (path?, filename, content BINARY)`` into article rows
    plus an ``error`` column (P1-P11).

    ``date_policy``: ``"text"`` — header ``date`` else the file-name date, kept
    as text (local service); ``"importer"`` — the file-name date only, as a
    timestamp, an invalid date is an error. ``skip_blank`` defaults to the
    policy's program: blank files are dropped by the services, kept by the
    importer. ``run_ts`` is one fixed timestamp for the lifecycle columns.
    """
    if date_policy not in ("text", "importer"):
        raise ValueError("date_policy must be 'text' or 'importer'")
    if skip_blank is None:
        skip_blank = date_policy == "text"
    decoded = decode_files(raw_files)
    if skip_blank:
        decoded = decoded.filter(F.col("error").isNotNull() | has_text("text"))
    parsed = split_header_body(decoded.select("filename", "text", "error"))
    hdr = F.col("header")
    fdate = file_name_date(F.col("filename"))
    if date_policy == "text":
        raw_date = F.coalesce(hdr.getItem("date"), fdate)
        ts = F.try_to_timestamp(raw_date, F.lit(DATE_FORMAT))
        error = F.col("error")
    else:
        raw_date = fdate
        ts = F.try_to_timestamp(fdate, F.lit(DATE_FORMAT))
        error = F.coalesce(F.col("error"), F.when(
            fdate.isNotNull() & ts.isNull(),
            F.concat(F.lit("time data '"), fdate, F.lit("' does not match format '%Y-%m-%d'"))))
    stamp = F.lit(run_ts).cast("timestamp") if run_ts else F.lit(None).cast("timestamp")
    return parsed.select(
        article_id_for(F.col("filename")).alias("article_id"),
        "filename",
        F.coalesce(hdr.getItem("title"), strip_extension(F.col("filename"))).alias("title"),
        F.coalesce(hdr.getItem("author"), F.lit(DEFAULT_AUTHOR)).alias("author"),
        ts.alias("publish_date"),
        raw_date.alias("publish_date_raw"),
        F.col("body").alias("content"),
        F.lit(PROVENANCE).alias("source"),
        hdr.alias("header"),
        stamp.alias("created_at"),
        stamp.alias("last_updated"),
        "header_text",
        error.alias("error"),
    )


def good_rows(parsed: DataFrame) -> DataFrame:
    """The article rows of a parse (errors removed, schema columns only)."""
    from ..sources.tables import conform_articles
    return conform_articles(parsed.filter(F.col("error").isNull()))


def error_rows(parsed: DataFrame) -> DataFrame:
    """``import_errors (filename, error)``."""
    return parsed.filter(F.col("error").isNotNull()).select("filename", "error")


def unread_files(listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """P11 for a tolerant scan: ``import_errors`` rows of listed files that the
    parse has no row of. ``listed`` is a scan's ``filename`` column, checkpointed
    before the files are read (it reads no content); ``parsed`` a written or
    checkpointed parse that keeps blank files."""
    missing = listed.select("filename").join(parsed.select("filename"), "filename", "left_anti")
    return missing.select("filename", F.lit(UNREADABLE).alias("error"))
