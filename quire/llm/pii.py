"""Personal data by bootstrapped contextual extraction.

Plain formats (email, ip, card, phone) give the seed entities. Every seed and
every other identifier-like text votes for the lexical patterns around it: the two
words before it, and the word on either side. Identifier-like are, of at least
``MIN_LENGTH`` characters: a word with a digit; neighbouring groups of digits on
one line, of ``RUN_DIGITS`` digits together ("(545) 555 9193"); a word without
digits that has "@", "." or "_" between letters; and an address whose "@" or
"." is spelt out ("jo [at] site [dot] org"). Groups of digits are never taken
for an e-mail address, words without digits for nothing else. Spark scores the pattern-instance graph in rounds: a pattern is as good
as the share of its distinct instances that are already known to be of the
kind, an instance as good as its patterns together; good patterns turn the
unknown identifiers that they extract into seeds of the next round. Found
identifiers are added to the plain ones, which always stay.

Defined results: a null or empty text has no spans; a null id is kept; rows
with equal id and text have equal results; of kinds with equal confidence the
last by name is taken; a very long text is read whole, in time linear in its
length; an empty table gives no rows; other columns are not read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 2
MIN_INSTANCES = 4  # distinct known instances behind a pattern
MIN_DOCUMENTS = 3  # distinct texts behind a pattern
MIN_PATTERN = 0.8  # share of a pattern's instances that are known
MIN_INSTANCE = 0.85
MIN_LENGTH = 6  # of an identifier that no plain format knows
RUN_DIGITS = range(7, 20)  # of neighbouring groups together: from a local number to the longest card

# The plain formats. A run of digits or local characters is entered at its beginning only.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9][^\x20\x09-\x0D]*")
_GROUPS = re.compile(r"(?<![0-9])[+(]{0,2}(?<![0-9])[0-9]++(?:[\x20().\-/]{1,3}+[0-9]++)++")
_SIGNED = re.compile(r"[A-Za-z][@._][A-Za-z][^\x20\x09-\x0D]*")
_SPELT_AT = re.compile(r"\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20)", re.I)
_SPELT_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++", re.I)
_SPACE = "\x20\t\n\x0b\x0c\r"
_EDGE = "\"'`()[]{}<>.,;:!?|*#$%&="


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the plain formats, by start, then kind as listed."""
    out, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append((start, end, "email"))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _word_before(text: str, at: int) -> tuple[str, int]:
    end = at
    while end and text[end - 1] in _SPACE:
        end -= 1
    start = end
    while start and text[start - 1] not in _SPACE:
        start -= 1
    return text[start:end].strip(_EDGE).lower(), start


def _word_after(text: str, at: int) -> str:
    n = len(text)
    while at < n and text[at] not in _SPACE:  # the rest of the entity's own word
        at += 1
    while at < n and text[at] in _SPACE:
        at += 1
    end = at
    while end < n and text[end] not in _SPACE:
        end += 1
    return text[at:end].strip(_EDGE).lower()


def _free(spans: list[tuple[int, int]], found: list[tuple]) -> list[tuple]:
    """Those of ``found`` that touch no span; both by start, neither overlapping its own kind."""
    out, k = [], 0
    for item in found:
        while k < len(spans) and spans[k][1] <= item[0]:
            k += 1
        if not (k < len(spans) and spans[k][0] < item[1]):
            out.append(item)
    return out


def _united(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for spans in lists for s in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digit_groups(text: str) -> list[tuple[int, int]]:
    """Neighbouring groups of digits, with a space among them, that are whole words but for signs at their edges."""
    out = []
    for m in _GROUPS.finditer(text):
        a, b = m.span()
        after = b
        while after < len(text) and text[after] in _EDGE and after - b < 3:
            after += 1
        whole = (not a or text[a - 1] in _SPACE or text[a - 1] in _EDGE) and (after == len(text) or text[after] in _SPACE)
        if whole and " " in m[0] and sum(c.isdigit() for c in m[0]) in RUN_DIGITS:
            out.append((a, b))
    return out


def _spelt_addresses(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _SPELT_AT.finditer(text):
        start, host = m.start(), _SPELT_HOST.match(text, m.end())
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < m.start():
            end = host.end()
            out.append((start, end))
    return out


def _identifier_words(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """The words that ``pattern`` matches from somewhere inside to their end, without signs at their edges."""
    out, end = [], 0
    for m in pattern.finditer(text):
        start = m.start()
        while start > end and text[start - 1] not in _SPACE:
            start -= 1
        end = m.end()
        a, b = start, end
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b - a >= MIN_LENGTH:
            out.append((a, b))
    return out


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """The seeds, and the identifier-like texts that touch neither them nor each other, with the two patterns around each.
    ``shape``: of digits only, of no digits or a spelt address ("word"), or "mixed"."""
    found = [(s, e, kind, "mixed") for s, e, kind in spans]
    taken = _united([(s, e) for s, e, _ in spans])
    for shape, more in (("word", _spelt_addresses), ("digits", _digit_groups), ("mixed", lambda t: _identifier_words(t, _DIGIT)),
                        ("word", lambda t: _identifier_words(t, _SIGNED))):
        new = _free(taken, more(text))
        found += [(a, b, None, shape) for a, b in new]
        taken = _united(taken, new)
    out = []
    for a, b, kind, shape in found:
        one, at = _word_before(text, a)
        two, _ = _word_before(text, at)
        value = hashlib.blake2b(text[a:b].lower().encode(), digest_size=12).hexdigest()
        out.append({"start": a, "end": b, "kind": kind, "shape": shape, "value": value, "patterns": [f"{two} {one} _", f"{one} _ {_word_after(text, b)}"]})
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("shape", pa.string()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_SPAN = pa.struct([("start", pa.int64()), ("turn", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
_SCAN_DDL = ("doc_id long, tie long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
             "base array<struct<start:long,turn:int,kind:string,end:long>>, "
             "found array<struct<start:long,end:long,kind:string,shape:string,value:string,patterns:array<string>>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain spans and candidates of every text; one narrow pass. ``tie`` tells rows of one id apart by text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                columns = [[] for _ in range(7)]
                for text in rows.column("text").to_pylist():
                    spans = plain_spans(text)
                    kinds = [s[2] for s in spans]
                    for column, value in zip(columns, (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(spans).encode()).hexdigest(),
                                                       [{"start": s, "turn": KINDS.index(k), "kind": k, "end": e} for s, e, k in spans], candidates(text, spans))):
                        column.append(value)
                types = [pa.int64()] * 4 + [pa.string(), pa.list_(_SPAN), pa.list_(_CANDIDATE)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), *(pa.array(c, t) for c, t in zip(columns, types))],
                                                 names=["doc_id", "tie", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, _SCAN_DDL)


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(value, kind, confidence)`` of the identifiers found beside the seeds, the last round's patterns, and the paths written."""
    hits = (scanned.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "tie", F.explode("found").alias("f"))
            .select("doc_id", "tie", "f.kind", "f.shape", "f.value", F.explode(F.array_distinct("f.patterns")).alias("pattern")))
    # the graph: a pattern extracts a value, whatever number of texts repeat it
    edges, path = written(hits.select("pattern", "value", "kind", "shape").distinct(), "pii-edges")
    # texts behind the values that a pattern extracts, distinct first, so that a common pattern is counted by all tasks
    links, other = written(hits.select("pattern", "value", "tie").distinct(), "pii-texts")
    paths = [path, other]
    known = edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("confidence"))
    found, patterns = None, None
    for turn in range(rounds):
        totals = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
        voted = edges.drop("kind", "shape").join(known, "value").groupBy("pattern", "kind").agg(
            F.countDistinct("value").alias("hits"), F.sum("confidence").alias("weight")).where(F.col("hits") >= MIN_INSTANCES)
        behind = (links.join(known.select("value", "kind"), "value").select("pattern", "kind", "tie").distinct()
                  .groupBy("pattern", "kind").agg(F.count("*").alias("texts")).where(F.col("texts") >= MIN_DOCUMENTS))
        patterns = (voted.join(behind.select("pattern", "kind"), ["pattern", "kind"]).join(totals, "pattern")
                    .withColumn("precision", F.col("weight") / F.greatest("n", F.col("weight"))).where(F.col("precision") >= MIN_PATTERN)
                    .select("pattern", "kind", "hits", "n", "precision"))
        extracted = edges.where("kind is null").drop("kind").join(patterns, "pattern").where(
            (F.col("shape") == "mixed") | ((F.col("shape") == "word") == (F.col("kind") == "email")))
        miss = F.sum(F.log(1 - F.least("precision", F.lit(0.99))))
        scored = (extracted.groupBy("value", "kind").agg((1 - F.exp(miss)).alias("confidence"))
                  .groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("best"))
                  .select("value", "best.kind", "best.confidence").where(F.col("confidence") >= MIN_INSTANCE))
        found, path = written(scored, f"pii-found-{turn}")
        paths.append(path)
        seeds = edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("confidence"))
        known = seeds.unionByName(found)
    return found, patterns, paths


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, list[str]]:
    """Counts of the plain formats and all spans of every text; and the paths written."""
    scanned, path = written(scan(docs, id_col, text_col), "pii-scan")
    found, _, paths = bootstrap(scanned, rounds)
    words = (scanned.select(F.coalesce("doc_id", F.lit(-1)).alias("id_key"), "tie", F.explode("found").alias("f")).where("f.kind is null")
             .select("id_key", "tie", "f.start", "f.end", "f.value"))
    turn = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    more = (words.join(found.select("value", "kind"), "value").groupBy("id_key", "tie")
            .agg(F.collect_set(F.struct("start", turn.alias("turn"), "kind", "end")).alias("more")))
    rows = scanned.withColumn("id_key", F.coalesce("doc_id", F.lit(-1))).drop("found").join(more, ["id_key", "tie"], "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:long,turn:int,kind:string,end:long>>"))))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans")), [path, *paths]
