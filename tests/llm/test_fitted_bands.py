"""Bands fitted from the texts themselves, against a plain version, and what they reject."""

import math
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import quality

from .cases import frame, prose


def corpus():
    """Prose of two languages in several lengths, many copies of one text, and junk that passes the base rules."""
    rng = random.Random(5)
    docs = [(i, prose(1000 + i, rng.choice([60, 150, 400])), "en", "s", 0) for i in range(900)]
    docs += [(1000 + i, prose(3000 + i, 70), "de", "s", 0) for i in range(20)]  # too few for bands of their own
    docs += [(2000 + i, prose(1, 150), "en", "s", 0) for i in range(700)]  # copies
    shouted = prose(7, 160).upper()
    blob = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(120))
    few = " ".join(rng.choice(["ta", "ri", "mon", "sel", "ku", "ver", "dan"]) for _ in range(60))
    symbols = " ".join(w + "#$%" for w in prose(8, 150).split())
    return docs, {5001: shouted, 5002: blob, 5003: few, 5004: symbols}


@pytest.fixture(scope="module")
def measured(spark):
    docs, junk = corpus()
    rows = quality.measures(frame(spark, docs + [(i, t, "EN", "s", 0) for i, t in junk.items()]))
    rows, _ = quality.written(rows, "test-measures")
    return rows


def plain_bands(rows):
    """The rule of the docstrings with lists and the statistics module."""
    texts = {(r["lang"].lower(), r["n_words"], r["word_chars"], r["n_tokens"], r["n_byte_tokens"], r["token_entropy"])
             for r in rows if r["n_words"] >= 50 and 2 * r["n_repeat_words"] <= r["n_words"]}
    values = defaultdict(list)
    for lang, _, chars, n, n_byte, entropy in texts:
        for name, v in (("chars_per_token", chars / n), ("byte_share", n_byte / n), ("token_entropy", entropy)):
            values[lang, int(math.log2(n)), name].append(math.floor(v * 1000 + 0.5))
    values = {k: v for k, v in values.items() if len(v) >= 100}
    middle = {k: statistics.median_low(v) for k, v in values.items()}
    deviation = {k: statistics.median_low([abs(x - middle[k]) for x in v]) for k, v in values.items()}
    bands = {}
    for (lang, octave, name), m in middle.items():
        usual = statistics.median(d for (a, _, c), d in deviation.items() if (a, c) == (lang, name))
        room = quality.WIDTHS[name] * max(1.4826 * max(deviation[lang, octave, name], usual) / 1000, quality.LEAST_DEVIATION[name])
        bands[lang, octave, name] = m / 1000 - room, m / 1000 + room
    return bands


def test_bands_match_a_plain_version(spark, measured):
    want = plain_bands(measured.collect())
    octaves = sorted({o for _, o, _ in want})
    assert len(octaves) >= 3 and {a for a, _, _ in want} == {"en"}
    bands = {r["octave"]: r for r in quality.fit(measured)[0].collect()}
    assert sorted(bands) == list(range(octaves[0], quality.MAX_OCTAVE + 1))
    for octave, r in bands.items():
        at = max(o for o in octaves if o <= octave)
        low, high = want["en", at, "chars_per_token"]
        entropy = min(want["en", o, "token_entropy"][0] for o in octaves if o >= at)
        got = [r["least_chars"], r["most_chars"], r["most_share"], r["least_entropy"]]
        assert np.allclose(got, [low, high, want["en", at, "byte_share"][1], entropy], atol=1e-9)


def test_bands_reject_what_the_base_rules_let_pass(spark, measured):
    fitted = quality.fit(measured)[0]
    rows = {r["doc_id"]: r for r in quality.judge(measured, fitted).collect()}
    loose = {r["doc_id"]: r["kept"] for r in quality.judge(measured).collect()}
    _, junk = corpus()
    for i in junk:
        assert not rows[i]["base_failed"] and not rows[i]["kept"], i
    assert "token_entropy" in rows[5003]["outside"] and "chars_per_token" in rows[5001]["outside"]
    assert any(loose[i] for i in junk)  # the fitted bands reject what those set by hand let pass
    clean = [r for i, r in rows.items() if i < 2700]
    assert sum(not r["kept"] for r in clean) <= len(clean) // 100
    assert all(r["kept"] == (not r["base_failed"] and r["outside"] == "") for r in rows.values())


def test_copies_and_partitions_do_not_move_bands(spark, measured):
    once = measured.where("doc_id < 2000 or doc_id > 5000")
    both = [sorted(map(tuple, quality.fit(df)[0].collect())) for df in (measured, once.repartition(7))]
    assert len(both[0]) > 0
    # the copies are one text more, so a band may move by a few thousandths and no further
    assert len(both[0]) == len(both[1]) and all(abs(x - y) < 0.05 for a, b in zip(*both) for x, y in zip(a[2:], b[2:]))
    again = sorted(map(tuple, quality.fit(measured.repartition(5))[0].collect()))
    assert again == both[0]


def test_good_keeps_rows_whole(spark):
    docs, junk = corpus()
    table = frame(spark, docs + [(i, t, "en", "s", 0) for i, t in junk.items()] + [(6000, None, None, None, None), (None, prose(9, 150), "en", "s", 1)])
    kept, paths = quality.good(table)
    assert kept.columns == table.columns and len(paths) == 2
    got = Counter(tuple(r) for r in kept.collect())
    assert not got - Counter(tuple(r) for r in table.collect())
    ids = Counter(r[0] for r in got.elements())
    assert not set(junk) & set(ids) and 6000 not in ids and ids[None] == 1


def test_empty_tables_have_no_bands(spark):
    empty = quality.measures(frame(spark, []))
    fitted = quality.fit(empty)[0]
    assert fitted.count() == 0 and quality.judge(empty, fitted).count() == 0
