"""Operators 11 to 13 against plain versions."""

import collections
import gzip
import hashlib
import io
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import divergence, variants, warc
from quire.llm.common import importable

from .cases import DOCS, frame, lowered, prose

LETTERS = "A-Za-zÀ-ÿ"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = len(os.path.commonprefix([a, b]))
    return a[k + 1:] == b[k + 1:] or a[k + 1:] == b[k:] or a[k:] == b[k + 1:]


def plain_variants(docs):
    counts = collections.Counter()
    for doc in docs:
        doc_id = "" if doc[0] is None else str(doc[0])
        for run in re.findall(f"[{LETTERS}]+", doc[1] or ""):
            run = lowered(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def spellings(seed, n):
    """Texts whose words have many near words, long chunks in common, and letters beyond ASCII."""
    rng = random.Random(seed)
    stems = ["ciónmente", "tiontion", "ababab", "thinge", "ÀÉÿÿÉÀ", "stating"] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 8))) for _ in range(12)]
    out = []
    for k in range(n):
        text = []
        for _ in range(60):
            word = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(word) + 1)
                word = word[:at] + rng.choice(["", "a", "é", "T"]) + word[at + rng.randrange(2):]
            text.append(word)
        out.append((k, rng.choice([" ", "1", ", "]).join(text), "en", "src0", 1))
    return out


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("depth", [1, 2])
def test_variants_match_a_plain_version(spark, depth):
    importable(spark)
    docs = [*DOCS, *spellings(5, 40), (950, "zzzzab " * 3 + "zzzzac " * 7 + "zzzzdc " * 15 + "zzzzd " * 40, "en", "src0", 1)]
    found, _ = variants.variants(frame(spark, docs), depth=depth)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain_variants(docs)
    assert rows(found) == collections.Counter(expected)
    assert any(r[1] and r[2] != r[1] for r in expected), "some way has more than one step"


def test_no_side_of_the_variants_is_broadcast(spark, scratch):
    # the files are small, the keys of their words are many times larger
    spark.createDataFrame([(f"word{n}", n) for n in range(2000)], "word string, n long").write.parquet(f"{scratch}/words")
    words = spark.read.parquet(f"{scratch}/words")
    found = variants.forms(words)
    assert found.count() == 2000
    ways, _ = variants.rooted(found)
    for df in (variants.near_words(words), found, ways):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_variants_of_an_empty_table(spark):
    importable(spark)
    assert variants.variants(frame(spark, DOCS).where("false"))[0].count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=2, max_size=9), st.integers(0, 9), st.sampled_from(["", "a", "b", "c", "cc"]), st.integers(0, 1))
def test_one_edit_spares_a_choice_of_chunks(word, at, new, cut):
    """The keys of the two sides, as prefix and suffix, without Spark."""
    other = word[:at] + new[:1] + word[at + cut:]
    if not one_edit(word, other):
        return
    a, b = (word, other) if len(word) >= len(other) else (other, word)
    size = len(a)
    choices = [(0, 0)]
    for _ in range(variants.DEPTH):
        choices = [e for f, r in choices for h in [(size - f - r) // 2] for e in ((f + h, r), (f, r + h))]
    assert any(a[:f] == b[:f] and a[size - r:] == b[len(b) - r:] for f, r in choices)


def test_long_texts_are_cut_between_runs():
    text = "abc déf " * 50 + "x" * 40
    outside = re.compile(f"[^{LETTERS}]")
    parts = list(variants.pieces(text, outside, 10))
    assert "".join(parts) == text and len(parts) > 10
    assert [w for p in parts for w in re.findall(f"[{LETTERS}]+", p)] == re.findall(f"[{LETTERS}]+", text)
    assert list(variants.pieces("", outside, 10)) == [""]


def plain_audit(docs, least, top):
    held, group_counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, _ in docs:
        found = collections.Counter(lowered(t) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        held[lang or ""].update(found.keys())
        group_counts[lang or "", source or ""].update(found)
    out = set()
    for lang in held:
        kept = {t for t, n in held[lang].items() if n >= least}
        groups = {s: {t: c[t] for t in kept} for (of, s), c in group_counts.items() if of == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}

        def prices(counts):
            total = sum(counts.values())
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: prices(g) for s, g in groups.items()}, prices(whole)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def corpus(seed):
    rng = random.Random(seed)
    docs = [(k, prose(rng.randrange(12), rng.randrange(0, 60)) + " Äb\u0085c é" * rng.randrange(2), rng.choice(["en", "en", "de", None]), f"s{rng.randrange(23)}", 1) for k in range(150)]
    return [*DOCS, *docs, (900, "", "en", "silent", 0), (901, None, None, None, 0), (902, "alone", "xx", "a", 0), (903, "apart", "xx", "b", 0)]


@pytest.mark.parametrize("bits, tile", [(14, 16), (2, 3)])
def test_divergence_matches_a_plain_version(spark, monkeypatch, bits, tile):
    """Also with blocks and tiles that cut every group many times."""
    importable(spark)
    monkeypatch.setattr(divergence, "BLOCK_BITS", bits)
    monkeypatch.setattr(divergence, "TILE", tile)
    docs = corpus(3)
    found, _ = divergence.audit(frame(spark, docs), least=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = plain_audit(docs, 4, 10)
    assert rows(found) == collections.Counter(expected)
    assert {r[0] for r in expected if r[2] == "pair" and r[4] == 0} >= {"xx"}


def test_divergence_of_an_empty_table(spark):
    importable(spark)
    assert divergence.audit(frame(spark, DOCS).where("false"))[0].count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=90), st.sets(st.integers(0, 400), max_size=300), st.integers(1, 7))
def test_galloping_finds_what_two_arrays_share(few, many, stride):
    a, b = np.array(sorted(few), np.int64), np.array(sorted(many), np.int64)
    before, divergence.STRIDE = divergence.STRIDE, stride
    try:
        in_a, in_b = divergence.gallop(a, b)
    finally:
        divergence.STRIDE = before
    assert a[in_a].tolist() == b[in_b].tolist() == sorted(few & many)


def test_prices_stay_exact_beyond_64_bits():
    count, total, v = 5 * 10 ** 13, 10 ** 14, 10 ** 7
    assert divergence.prices(np.array([count]), total, v)[0] == 1 + 10 ** 9 * (count + 2) // (total + 2 * v)


PAGES_SCHEMA = "page_id long, url string, html string, digest string, id long, first_id long"
BIG = "<p>" + "Grüße " * 400_000
PAGES = [(1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, "x" * 99), (4, "http://a/\r\nWARC-Type: x", "x" * 99), (5, "u", None), (6, "u", ""),
         (7, "ü", "é" * 50), (0, "u", "é" * 50), (None, "u", "é" * 50), (9, "u", BIG), (8, "u", BIG), (None, None, "only " * 40), (None, None, "only " * 40),
         (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30), (11, "same", "row " * 40), (11, "same", "row " * 40), (12, "u", "row " * 40)]


def pages(spark, data=PAGES):
    return spark.createDataFrame([(*p, "d", -1, -2) for p in data], PAGES_SCHEMA).repartition(3)


def plain_pages(data):
    first = {}
    for page, _, html in data:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in data:
        body = (html or "").encode()
        again = body in first and (page is None or page > first[body])
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return collections.Counter(out)


def test_warc_round_trip_matches_a_plain_version(spark):
    importable(spark)
    found, _ = warc.round_trip(pages(spark))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows(found) == plain_pages(PAGES)
    assert warc.round_trip(pages(spark).where("false"))[0].count() == 0


def archive(tmp_path, spark, data=PAGES, **options):
    importable(spark)
    written, _ = warc.records(pages(spark, data))
    return warc.write_archives(written.coalesce(1), f"file:{tmp_path}/raw", **options)


def local(path):
    return path.removeprefix("file:")


def test_each_record_is_a_member_that_the_index_names(spark, tmp_path):
    raw = archive(tmp_path, spark).collect()
    assert len(raw) == 1
    stream = open(local(raw[0].archive), "rb").read()
    inflate = zlib.decompressobj(31)
    whole = inflate.decompress(stream)
    assert inflate.eof and not inflate.unused_data, "one stream for the whole file"
    done = warc.normalise(spark.createDataFrame(raw), f"file:{tmp_path}/normal").collect()
    assert [r.error for r in done] == [None]
    data = open(local(done[0].archive), "rb").read()
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == whole, "the records are the same, byte for byte"
    lines = [json.loads(x) for x in open(local(done[0].sidecar))]
    assert len(lines) == done[0].n_records == len(PAGES) + 1
    at = 0
    for line in lines:
        assert line["offset"] == at
        at += line["length"]
        member = zlib.decompressobj(31)
        record = member.decompress(data[line["offset"]:at])
        assert member.eof and not member.unused_data and record.startswith(b"WARC/1.1\r\n")
        assert f"WARC-Record-ID: {line['id']}".encode() in record
    assert at == len(data)
    dealt = warc.runs(spark.createDataFrame(done, warc._NORMAL_DDL), most=200)
    assert dealt.count() > 3 and warc.read_records(dealt).count() == len(PAGES)


def test_archives_are_closed_by_size(spark, tmp_path):
    raw = archive(tmp_path, spark, most=1000).collect()
    assert len(raw) > 3 and sum(r.n_records for r in raw) == len(PAGES)


def test_streams_that_are_no_whole_archives(spark, tmp_path):
    good = local(archive(tmp_path, spark, PAGES[:6]).collect()[0].archive)
    data = open(good, "rb").read()
    text = gzip.decompress(data)
    cases = {"early": data[:-20], "junk": b"no gzip at all", "cut": gzip.compress(text[:-30]), "members": gzip.compress(text[:700]) + gzip.compress(text[700:]),
             "empty": b"", "long": gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabcdefgh"), "nolength": gzip.compress(b"WARC/1.1\r\nA: b\r\n\r\n")}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    listed = spark.createDataFrame([(f"file:{tmp_path}/{name}",) for name in cases], "archive string")
    done = {r.source.rpartition("/")[2]: r for r in warc.normalise(listed, f"file:{tmp_path}/again").collect()}
    assert done["members"].error is None and done["members"].n_records == 7
    assert done["cut"].error and done["cut"].n_records == 6
    assert all(done[name].error for name in ("early", "junk", "empty", "long", "nolength"))
    read = warc.read_records(warc.runs(spark.createDataFrame([done["members"], done["cut"]], warc._NORMAL_DDL)))
    assert read.count() == 6 + 5
