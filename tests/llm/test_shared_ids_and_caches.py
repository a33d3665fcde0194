"""Rows that share an id, and what a Python worker keeps."""

import collections

from quire.llm import common, neardup
from quire.llm.common import importable

from .cases import frame, lowered, prose, words

A, B = prose(10, 120), prose(11, 90)
SHARED = [(1, A), (9, A + " more"), (9, prose(12, 80)), (12, B), (12, prose(13, 70)), (12, B + " so"), (20, prose(14, 60)), (20, prose(14, 60)), (21, None), (21, ""),
          (21, prose(15, 100)), (15, prose(15, 100) + " end"), (None, A), (30, A.upper()), (31, "a b"), (31, "a b"), (31, "A c")]
ROWS = [(i, t, "en", "s", 0) for i, t in SHARED]


def plain(rows):
    """Texts that stay: of each component of distinct (id, set) the first by id, texts without words, and rows without an id."""
    sets = []
    for i, text, *_ in rows:
        w = words(lowered(text))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                both = len(sets[a] & sets[b])
                if rows[a][0] is not None and rows[b][0] is not None and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    out = collections.Counter(i for k, (i, *_) in enumerate(rows) if i is None or not sets[k])
    members = collections.defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None and sets[k]:
            members[group[k]].append(i)
    return out + collections.Counter(min(ids) for ids in members.values())


def test_texts_that_share_an_id_are_judged_apart(spark):
    importable(spark)
    kept, paths = neardup.one_of_each(frame(spark, ROWS))
    found = kept.collect()
    assert kept.columns == frame(spark, ROWS).columns
    assert collections.Counter(r["doc_id"] for r in found) == plain(ROWS)
    assert {r["text"] for r in found if r["doc_id"] in (9, 20)} == {prose(12, 80), prose(14, 60)}
    assert prose(13, 70) in {r["text"] for r in found if r["doc_id"] == 12}
    assert len(paths) == 2


def test_near_duplicates_of_rows_that_share_an_id(spark):
    importable(spark)
    found = neardup.near_duplicates(frame(spark, ROWS))[0].collect()
    assert len(found) == len(ROWS)
    of = collections.Counter((r["doc_id"], r["component_id"]) for r in found)
    assert of[9, 1] == 1 and of[9, 9] == 1 and of[12, 12] == 3 and of[21, 15] == 1 and of[30, 1] == 1


def test_a_worker_keeps_one_operator_s_tables():
    common.release()
    made = []
    for key in (("a", 1), ("a", 1), ("b", 2), ("b", 2)):
        common.once(key, lambda key=key: made.append(key) or key)
    assert made == [("a", 1), ("b", 2)] and list(common._KEPT) == [("b", 2)]
    common.release()
    assert not common._KEPT


def test_remembered_values_are_bounded_by_bytes():
    calls = []
    kept = common.Remembered(lambda k: calls.append(k) or k * 2, 100 * (300 + common._PAIR))
    for k in range(1000):
        assert kept[f"{k:0100d}"] == f"{k:0100d}" * 2
        assert len(kept) <= 102
    assert kept["0" * 100] and calls.count("0" * 100) == 1, "early keys stay"
