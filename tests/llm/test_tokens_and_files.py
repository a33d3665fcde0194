"""Token pieces, the coder, token files and packing, against plain versions."""

import random
import zlib

import numpy as np
import pytest

from quire.llm import packing, rans, tokenfiles
from quire.llm.common import Remembered
from quire.llm.tokens import encoder

from .cases import DOCS, brute_ids, frame

ODD = ["", "  a  b", "a\n\nb c \n d", "\t x\r\ny", "x é́ z", "word\x1c w", "'s don't 123 45,6 !!? ", "<|endoftext|> a<|endoftext|>",
       "日本語 テキスト", "\n", " ", "a \n", "İstanbul X", "😀 😀😀", "a\x85b c", "Çé. Üb,\nße!"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name):
    ours, rng = encoder(name, "uint16"), random.Random(3)
    some = ["".join(rng.choice(" \n\t\r\x0b\x1c\x85 ab'sé́.,!1²½日<|>") for _ in range(rng.randrange(14))) for _ in range(1500)]
    for text in ODD + some:
        assert np.frombuffer(ours.encode(text), np.uint16).tolist() == brute_ids(name, text), text


def default_ids(name, text):
    """The plain call, added tokens found."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids


HOLDS = [(1, "one <|endoftext|> two", "en", "s", 0), (2, "two words", "en", "s", 0), (3, "<|startoftext|>Ça\n<|endoftext|>\n 日本 <|endoftext|>", "en", "s", 0), (4, "<|EndOfText|> <|endoftext", "en", "s", 0)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_their_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    ours, rng, plain = encoder(name, "uint16", added=True), random.Random(4), Tokenizer.from_file(public_tokenizers.path(name))
    some = ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", " ", "\n", "ab", "É", "日", "<|", "'s"]) for _ in range(rng.randrange(9))) for _ in range(800)]
    for text in ODD + some:
        assert np.frombuffer(ours.encode(text), np.uint16).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_runs_of_texts_give_the_ids_of_each_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ours, rng = encoder("word_bpe_49k.json", "uint16", added=True), random.Random(6)
    some = ["".join(rng.choice(" \n\t\r\x0b\x0c\x00\x1c\x7f\x85\xa0 aBz's're'LL09.,!-é×\u0301\u0338=²½日ƁȺİΣ’₤") for _ in range(rng.randrange(30))) for _ in range(3000)]
    for texts in (["", "a"], ["a", ""], [""], ["", ""], [" ", "1a", "a1", ".", "11"], ODD + [d[1] for d in HOLDS] + some):
        assert [np.frombuffer(ids, np.uint16).tolist() for ids in ours.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ours.encode_all([]) == []


def test_letters_whose_lower_case_is_outside_of_the_range():
    text = "aƁb ȺX ɅɄ"
    assert np.frombuffer(encoder("word_bpe_49k.json", "uint16").encode(text), np.uint16).tolist() == default_ids("word_bpe_49k.json", text)


def test_known_words_of_a_run_are_looked_up_once():
    ours = encoder("word_bpe_49k.json", "uint16", added=True)
    units, asked = ours.units, []

    class Counted(type(units)):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    ours.units = Counted(units.make, units.most)
    try:
        ours.encode_all(["one two, one (two) one.\n" * 200, "two one"] * 10)
    finally:
        ours.units = units
    assert sorted(filter(None, asked)) == ["(", ")", ",", ".", "one", "two"]


def test_token_files_and_packing_hold_added_tokens(spark):
    rows = sorted(tokenfiles.round_trip(frame(spark, HOLDS))[0].collect(), key=lambda r: r["start"])
    ids = [default_ids("word_bpe_49k.json", d[1]) + [1] for d in HOLDS]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in rows] == [(len(i), zlib.crc32(np.array(i, "<u4"))) for i in ids]
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    ids = [default_ids("byte_bpe_50k.json", d[1]) + [2] for d in HOLDS]
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in _packed(spark, HOLDS)) == [(d[0], len(i), zlib.crc32(np.array(i, "<u4"))) for d, i in zip(HOLDS, ids)]


def test_remembered_stays_bounded_and_right():
    kept = Remembered(lambda k: k * 2, 10)
    assert [kept[k] for k in range(100)] == [k * 2 for k in range(100)]
    assert len(kept) <= 11 and kept[1] == 2


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_coder_round_trip_and_checkpoints(n):
    ids = np.random.default_rng(n).zipf(1.4, n).clip(max=49_407).astype(np.uint16)
    table = rans.Table(rans.frequencies(np.bincount(ids, minlength=49_408) if n else np.ones(49_408, np.int64)))
    block = table.encode(ids)
    assert (table.decode(block) == ids).all()
    assert (table.decode(block, n // 2, n // 2 + 500) == ids[n // 2:n // 2 + 500]).all()
    if n:
        broken = bytearray(block)
        broken[len(broken) // 2] ^= 1
        with pytest.raises(ValueError):
            table.decode(bytes(broken))


def test_frequencies_keep_every_id_and_add_up():
    for counts in (np.array([1, 0, 10 ** 9]), np.ones(49_408, np.int64), np.r_[np.ones(49_407, np.int64), 10 ** 12]):
        freq = rans.frequencies(counts)
        assert freq.sum() == 1 << rans.SCALE and ((freq > 0) == (counts > 0)).all()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 500)
    rows, paths = tokenfiles.round_trip(frame(spark, DOCS))
    got = sorted(rows.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in DOCS), key=lambda d: (d is not None, d))
    want = sorted((d[0] is not None, d[0] or 0, len(ids), zlib.crc32(np.array(ids, "<u4"))) for d in DOCS for ids in [brute_ids("word_bpe_49k.json", d[1]) + [1]])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    files = spark.read.format("binaryFile").load(paths[-1]).select("content").collect()
    assert len(files) > 1
    table = rans.Table(rans.frequencies(tokenfiles.token_counts(spark.read.parquet(paths[0]))))
    data = bytearray(files[0]["content"])
    data[40] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.read_file(table, bytes(data))


def test_token_files_of_an_empty_table(spark):
    assert tokenfiles.round_trip(frame(spark, []))[0].count() == 0


def _packed(spark, docs, **options):
    from quire.llm.common import written

    split, _ = written(packing.pieces(frame(spark, docs)), "pieces")
    return packing.pack(split, **options)[0].collect()


def _check(rows, docs, capacity=1024):
    """Every piece once, no sequence too long, no gaps; crc of the real ids."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0] + [p[1] for p in places])[:-1].tolist()
        assert sum(p[1] for p in places) <= capacity
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for d in docs:
        ids = brute_ids("byte_bpe_50k.json", d[1]) + [2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(d[0] is not None, d[0] or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want)
    return len(bins)


def test_packing_places_every_piece(spark):
    _check(_packed(spark, DOCS), DOCS)


def test_packing_is_close_to_the_bound(spark):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice(["the", "and", "of", "window"]) for _ in range(rng.randrange(1, 900))), "en", "s", 0) for k in range(400)]
    n = _check(_packed(spark, docs), docs)
    total = sum(len(brute_ids("byte_bpe_50k.json", d[1])) + 1 for d in docs)
    assert n <= 1.06 * total / 1024 + 1  # few documents: every configuration's uses are rounded down


def test_packing_of_one_length_and_of_nothing(spark):
    same = [(k, "the and of", "en", "s", 0) for k in range(300)]
    assert _check(_packed(spark, same), same) == 2
    assert _packed(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_all_ranks(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    counts[rng.integers(1, 1025, 60)] = rng.integers(1, 500, 60)
    plan, bins = packing.plan_large(counts)
    lengths = np.repeat(np.arange(1024, packing.SMALL, -1), counts[np.arange(1024, packing.SMALL, -1)])
    at = np.searchsorted(plan[:, 0], np.arange(len(lengths)), "right") - 1
    used = np.bincount(plan[at, 1] + np.arange(len(lengths)) - plan[at, 0], lengths, minlength=bins)
    assert len(used) == bins and used.max() <= 1024
    rooms = {int(r): int(n) for r, n in zip(*np.unique(1024 - used, return_counts=True))}
    rows, _ = packing.plan_small(counts, rooms)
    assert sum(1 for r in rows if r[1] == 0) == (counts[1:packing.SMALL + 1] > 0).sum()
