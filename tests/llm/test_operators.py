"""The operators on small tables with the awkward cases, against brute force."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import chunking, decontaminate, kneser_ney, neardup, pii, quality, secrets, sharding

from .cases import DOCS, frame, lowered, prose, words


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


@pytest.mark.parametrize("docs", [DOCS, []])
def test_shards_follow_the_key_law(spark, docs):
    first = sharding.initial_map(spark, 8)
    rows = sharding.assign(sharding.records(frame(spark, docs)), first, sharding.grow(first, 8)).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)


def test_slot_maps_are_versioned_and_rebalanced(spark, scratch):
    first = sharding.initial_map(spark, 3, 64)
    sharding.save_map(first, scratch, 1)
    with pytest.raises(Exception):
        sharding.save_map(first, scratch, 1)
    heavy = spark.createDataFrame([(k, 1, 1000 if k % 3 == 0 else 10) for k in range(64)], "virtual_slot long, rows long, bytes long")
    second = sharding.rebalance(sharding.load_map(spark, scratch, 1), heavy)
    loads = [r["b"] for r in second.join(heavy, "virtual_slot").groupBy("shard").sum("bytes").toDF("shard", "b").collect()]
    assert max(loads) < 1.1 * sum(loads) / 3 and {r["version"] for r in second.collect()} == {2}


@pytest.mark.parametrize("docs", [DOCS, []])
def test_shards_by_bytes_keep_every_row(spark, docs):
    placed, maps, _ = sharding.place_by_bytes(frame(spark, docs), 8)
    rows = placed.collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    stored = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, maps, 2).collect()}
    assert len(stored) == sharding.N_SLOTS and all(stored[r["virtual_slot"]] == r["shard"] for r in rows)


def test_shards_by_bytes_are_near_equal(spark):
    rng = random.Random(9)
    # a hot id with a third of the rows, and texts of very different lengths
    docs = [(k if k % 3 else 7, f"{k} " + "x" * int(rng.paretovariate(1.1) * 20 % 9000), "en", "s", 0) for k in range(3000)]
    rows = sharding.place_by_bytes(frame(spark, docs), 8)[0].collect()

    def loads(column):
        found = Counter()
        for r in rows:
            found[r[column]] += r["size"]
        return found

    mean = sum(r["size"] for r in rows) / 8
    assert len(rows) == 3000 and len(loads("shard")) == 8 and max(loads("shard").values()) <= 1.02 * mean < max(loads("first_shard").values())


def _components(docs):
    sets = {}
    for d in docs:
        w = words(lowered(d[1]))
        sets[d[0]] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a is not None and b is not None and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    base = prose(50, 100).split()
    chain = [(100 + k, " ".join(base[2 * k:] + prose(60 + k, 2 * k).split()), "en", "s", 0) for k in range(12)]
    docs = DOCS + chain
    rows = neardup.near_duplicates(frame(spark, docs))[0].collect()
    want = _components(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(frame(spark, []))[0].count() == 0
    kept = neardup.one_of_each(frame(spark, docs))[0].collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(i) for i in want if i is None or want[i][1] == i)


def test_quality_counts_match_brute_force(spark):
    docs = DOCS + [(20, "a b c\na b c\n\n \nx\na b c", "en", "s", 0)]
    rows = {r["doc_id"]: r for r in quality.judge(quality.measures(frame(spark, docs))).collect()}
    for d in docs:
        text, r = d[1] or "", rows[d[0]]
        w = words(text)
        windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(repeated), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    good = quality.good(frame(spark, docs))[0]
    assert good.columns == frame(spark, docs).columns
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(r["doc_id"] for r in quality.judge(quality.measures(frame(spark, docs))).where("kept").collect())
    assert quality.good(frame(spark, []))[0].count() == 0


def test_contamination_within_the_budget(spark):
    item = prose(70, 40)
    edited = item[:60] + "x" + item[61:120] + item[124:]
    docs = [(1, "before " + item.upper().replace(" ", ",\n") + " after", "en", "s", 0), (2, prose(71, 300) + " " + edited, "en", "s", 0), (3, prose(72, 300), "en", "s", 0),
            (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, item[:len(item) // 2], "en", "s", 0)]
    bench = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "short"), (9, item)], "item_id long, text string")
    rows = decontaminate.contaminated(frame(spark, docs), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in rows) == [(1, 9, 0)] * 2 + [(2, 9, 5)] * 2
    assert sorted(r["doc_id"] for r in decontaminate.clean(frame(spark, docs), bench, block_bytes=10).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_repeated_passages(spark):
    passage = prose(80, 80)
    docs = DOCS + [(200, prose(81, 200) + " " + passage + " " + prose(82, 30), "en", "s", 0), (201, "x " + passage + " " + prose(83, 100), "en", "s", 0), (202, prose(84, 300), "en", "s", 0)]
    rows = chunking.repeated_passages(frame(spark, docs))[0].collect()
    found = {r["doc_id"]: r for r in rows}
    assert 201 in found and found[201]["first_doc_id"] == 200 and not {200, 202, 1, 4, 5, 6, None} & set(found)
    assert 2 in found and 8 in found  # a copy, and a long shared beginning
    text = docs[-2][1].encode()
    assert text[found[201]["start"]:found[201]["end"]] in (" " + passage).encode() + text
    assert chunking.repeated_passages(frame(spark, []))[0].count() == 0


def test_cuts_cover_a_text_and_resist_insertions():
    data = np.frombuffer(prose(90, 3000).encode(), np.uint8)
    ends = chunking.cut_points(data)
    moved = chunking.cut_points(np.concatenate([np.frombuffer(b"inserted", np.uint8), data])) - 8
    assert ends[-1] == len(data) and (np.diff(ends, prepend=0) > 0).all()
    assert len(set(ends.tolist()) ^ set(moved.tolist())) < 6
    assert np.diff(chunking.cut_points(np.zeros(20_000, np.uint8)), prepend=0).max() <= chunking.MOST


def _shared_run(a, b):
    """Bytes of the longest run of chunks of ``b`` that ``a`` has too."""
    parts = []
    for text in (a, b):
        ends = chunking.cut_points(np.frombuffer(text, np.uint8)).tolist()
        parts.append([text[x:y] for x, y in zip([0, *ends], ends)])
    known, best, run = set(parts[0]), 0, 0
    for part in parts[1]:
        run = run + len(part) if part in known else 0
        best = max(best, run)
    return best


def test_passages_of_51_words_are_found():
    rng = random.Random(3)
    words_of = [prose(k, 400).split() for k in range(40)] + [["la", "li"] * 200, ["of the same word"] * 100]
    missed = 0
    for _ in range(600):
        source, at = rng.choice(words_of[:40]), rng.randrange(340)
        passage = source[at:at + 51]
        around = [rng.choice(words_of) for _ in range(4)]
        texts = [" ".join(around[k][:rng.randrange(100)] + passage + around[k + 1][rng.randrange(100):]).encode() for k in (0, 2)]
        missed += _shared_run(*texts) < chunking.PASSAGE
    assert missed <= 6  # at most 1 %


def test_periodic_passages_are_found_at_any_phase():
    for period in ("ab", "tick ", "one two ", "nothing but this line over and over\n"):
        stretch = period * (300 // len(period) + 2)
        a, b = (prose(5, 50) + stretch + prose(6, 50)).encode(), (prose(7, 33) + stretch[1:] + prose(8, 40)).encode()
        assert _shared_run(a, b) >= chunking.PASSAGE


def test_plain_formats_match_their_patterns():
    text = ("mail a.b+c@mail1.example.com, @x.y, a@b and z@q.r.s 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 x 4539 1488 0343 6467, 4539148803436468 "
            "+1 (545) 555-9193 +12 3 +1234567890123456 a@b.c@d.e é 10.0.0.255x") * 2
    got = pii.plain_spans(text)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    assert [s for s in got if s[2] == "email"] == [(*m.span(), "email") for m in email.finditer(text)]
    assert [s for s in got if s[2] == "ip"] == [(*m.span(), "ip") for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [s for s in got if s[2] == "phone"] == [(*m.span(), "phone") for m in phone.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert [text[s:e] for s, e, k in got if k == "card"][:1] == ["4539 1488 0343 6467"]


def test_contexts_find_unseen_identifiers(spark):
    docs = [(k, f"{prose(k, 30)} reach me by phone: +1 (545) 555-{1000 + k} {prose(k + 500, 20)}", "en", "s", 0) for k in range(8)]
    docs += [(50, f"{prose(50, 30)} reach me by phone: 0545-555-9999 {prose(51, 20)}", "en", "s", 0), (51, prose(52, 50) + " 77-88-99-11", "en", "s", 0)]
    rows = {r["doc_id"]: r for r in pii.extract(frame(spark, docs + DOCS))[0].collect()}
    assert rows[50]["n_phone"] == 0 and rows[50]["spans"].startswith("phone:") and rows[51]["spans"] == ""
    assert rows[0]["n_phone"] == 1 and rows[0]["spans"].count(":") == 2
    assert len(pii.extract(frame(spark, DOCS))[0].collect()) == len(DOCS)
    assert pii.extract(frame(spark, []))[0].count() == 0


def test_candidates_of_every_shape():
    text = "phone: 555 123 4567 and (545) 555-9193, jo.doe mail jo [at] site [dot] org or al at big-site dot com; at 12:30 1 2 3 x9 look at home a_b"
    found = {text[c["start"]:c["end"]]: c["shape"] for c in pii.candidates(text, [])}
    assert found == {"555 123 4567": "digits", "(545) 555-9193": "digits", "jo.doe": "word", "jo [at] site [dot] org": "word", "al at big-site dot com": "word"}
    text = "on 2024-01-05 12:30"  # 12:30 is a word that isn't digits only, so these are no groups
    assert [text[c["start"]:c["end"]] for c in pii.candidates(text, [])] == ["2024-01-05"]
    seed = pii.plain_spans("call +1 (545) 555-9193 now")
    assert len(pii.candidates("call +1 (545) 555-9193 now", seed)) == 1
    for text in ("1" * 300_000, "1 " * 150_000, "(" * 300_000, "a(at)" * 60_000, "a." * 150_000, "1(" * 150_000, " at a" * 60_000):
        started = time.monotonic()
        spans = [(c["start"], c["end"]) for c in pii.candidates(text, [])]
        assert time.monotonic() - started < 5 and all(x[1] <= y[0] for x, y in zip(sorted(spans), sorted(spans)[1:]))


def test_contexts_find_spaced_numbers_and_spelt_addresses(spark):
    docs = [(k, f"{prose(k, 30)} reach me by phone: +1 (545) 555-{1000 + k} {prose(k + 500, 20)} or write mail to: jo{k}@site{k}.org {prose(k + 900, 9)}", "en", "s", 0) for k in range(20)]
    texts = {50: "reach me by phone: 555 123 4567", 51: "reach me by phone: (545) 555-9193", 52: "or write mail to: jo [at] site [dot] org",
             53: "or write mail to: jo.doe", 54: "reach me by phone: jo.doe", 55: "or write mail to: 555 123 4567", 56: "555 123 4567 elsewhere"}
    docs += [(k, f"{prose(k, 30)} {t} {prose(k + 50, 20)}", "en", "s", 0) for k, t in texts.items() if k != 56] + [(56, f"{prose(56, 9)} 777 123 4567 {prose(57, 9)}", "en", "s", 0)]
    rows = {r["doc_id"]: r["spans"] for r in pii.extract(frame(spark, docs))[0].collect()}

    def spans(k, value, kind):
        at = next(d[1] for d in docs if d[0] == k).index(value)
        return f"{kind}:{at}:{at + len(value)}"

    assert rows[50] == spans(50, "555 123 4567", "phone") and rows[51] == spans(51, "(545) 555-9193", "phone")
    assert rows[52] == spans(52, "jo [at] site [dot] org", "email") and rows[53] == spans(53, "jo.doe", "email")
    assert rows[56] == "" and "phone:" not in rows[54]


def test_every_text_behind_a_pattern_counts(spark):
    # the same identifiers stand together in near copies: all have the same least and greatest text
    block = " ".join(f"reach me by phone: +1 (545) 555-{1000 + j} {prose(700 + j, 5)}" for j in range(6))
    docs = [(k, f"{prose(k, 30)} {block}", "en", "s", 0) for k in range(5)]
    docs += [(50, f"{prose(50, 30)} reach me by phone: 0545-555-9999 {prose(51, 20)}", "en", "s", 0)]
    rows = {r["doc_id"]: r["spans"] for r in pii.extract(frame(spark, docs))[0].collect()}
    assert rows[50].startswith("phone:") and all(rows[k].count("phone:") == 6 for k in range(5))
    few = pii.extract(frame(spark, docs[:2] + docs[-1:]))[0].collect()  # two texts are too few
    assert {r["doc_id"]: r["spans"] for r in few}[50] == ""


def test_secrets_are_found_masked_and_false_positives_removed(spark):
    key = "9aF3kLq0ZxT7bWn2RvYc81HdUe"
    docs = [(k, f'{prose(k, 40)} api_key = "{key}{k:04d}" {"tamonselkuverdanosttari" * 2} {prose(k + 300, 10)}', "en", "s", 0) for k in range(400, 420)]
    found = secrets.scan(frame(spark, docs + DOCS))
    rows = found.collect()
    texts = {d[0]: d[1] for d in docs + DOCS}
    assert all(texts[r["doc_id"]][r["start"]:r["end"]] == r["value"] for r in rows)
    assert {r["doc_id"] for r in rows if r["is_secret"]} == {*range(400, 420), 14}
    assert any(not r["is_secret"] for r in rows)
    masked = {(r["doc_id"], r["text"]) for r in secrets.redact(frame(spark, docs + DOCS), found).collect()}
    assert len(masked) == len({(d[0], d[1]) for d in docs + DOCS})
    assert not any(key in (t or "") for _, t in masked) and sum(secrets.MASK in (t or "") for _, t in masked) == 21
    assert secrets.scan(frame(spark, [])).count() == 0


def test_secrets_in_common_forms_and_beyond_the_rules(spark):
    import random

    rng = random.Random(11)

    def key(n=32):
        return "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))

    forms = ['API_KEY={}', 'https://h.example.net/p?token={}&x=1', 'AWS_SECRET_ACCESS_KEY = "{}"', '{{"client_secret_for_the_service": "{}"}}']
    docs, want = [], {}
    for k in range(40):
        want[k] = key()
        docs.append((k, f"{prose(k, 30)} {forms[k % 4].format(want[k])} {prose(k + 100, 20)}", "en", "s", 0))
    words_only = ["".join(rng.choice(["tamon", "selku", "verdan", "osttari", "kuri"]) for _ in range(6)) for _ in range(80)]
    docs += [(100 + k, f"{prose(200 + k, 30)} {w} {prose(300 + k, 20)}", "en", "s", 0) for k, w in enumerate(words_only[:76])]
    docs += [(300 + k, f"{prose(400 + k, 30)} token: {w} {prose(500 + k, 20)}", "en", "s", 0) for k, w in enumerate(words_only[76:])]  # a name, but words
    want[600], want[601], want[602] = key(), "hunter2Xq9", "AKIA" + "Q7RW2M4KZ8T3LP6V"
    docs += [(600, f"{prose(600, 30)} {want[600]} {prose(601, 20)}", "en", "s", 0),  # no name
             (601, f"{prose(602, 30)} password={want[601]} {prose(603, 20)}", "en", "s", 0), (602, f"{prose(604, 30)} {want[602]}, {prose(605, 20)}", "en", "s", 0)]
    found = secrets.scan(frame(spark, docs))
    rows = found.collect()
    texts = {d[0]: d[1] for d in docs}
    assert all(texts[r["doc_id"]][r["start"]:r["end"]] == r["value"] for r in rows)
    assert all(texts[r["doc_id"]][max(0, r["start"] - secrets.LEFT):r["start"]] == r["before"] for r in rows)
    assert {r["doc_id"]: r["value"] for r in rows if r["is_secret"]} == want
    assert {303, 100} <= {r["doc_id"] for r in rows}
    assert not {"assigned", "known", "placeholder"} & set(secrets.FEATURES)
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, docs), found).collect()}
    assert all(masked[i] == texts[i].replace(want[i], secrets.MASK) if i in want else masked[i] == texts[i] for i in texts)


def test_bigram_model_is_a_distribution(spark):
    docs = [(k, " ".join(np.random.default_rng(k).choice(list("abcdefgh"), 30)), "en", "s", 0) for k in range(40)]
    texts = kneser_ney.prepared(frame(spark, docs))
    model, _ = kneser_ney.train(texts.where("not held_out").select("text"), bucket_tokens=100)
    import pyarrow as pa

    scorer = kneser_ney.Scorer(model)
    vocabulary = sorted({w for d in docs for w in words(d[1]) if zlib.crc32(str(d[0]).encode()) % 7 != 2})
    for before in ["a", "h", "never seen"]:
        one = scorer(pa.array([before, *[f"{before} {w}" for w in vocabulary], f"{before} unknown"]))["score"]
        ends = scorer(pa.array([f"{before} {w}" for w in vocabulary]))  # p(before, w, end)
        assert np.isfinite(one).all() and np.isfinite(ends["score"]).all()
    ids, previous, _ = kneser_ney._token_ids(pa.array(["a"]), scorer.words)
    total = scorer.model.n_words
    every = np.arange(total, dtype=np.uint64)
    for v in [int(ids[0]), total]:
        counts = scorer._bigram_counts(np.uint64(v) << np.uint64(32) | every)
        less = np.select([counts == 0, counts == 1, counts == 2], [0.0, *model.by_count[:2]], model.by_count[2])
        lower = scorer._lower(scorer._of("before", np.arange(total), 0))
        at = np.array([v])
        p = (counts - less) / scorer._of("totals", at, 0)[0] + scorer._of("weights", at, 1)[0] * lower
        unknown = scorer._of("weights", at, 1)[0] * scorer._lower(np.zeros(1))[0]
        assert abs(p.sum() + unknown - 1) < 1e-9


def test_scores_count_and_add_up(spark):
    texts = kneser_ney.prepared(frame(spark, DOCS))
    model, _ = kneser_ney.train(texts.where("not held_out").select("text"))
    training = Counter()
    for d in DOCS:
        if zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 7 != 2:
            training.update([*words(lowered(d[1])), "</s>"])
    n, v = sum(training.values()), len(training)
    for r in kneser_ney.score(texts, model).collect():
        options = []
        for d in DOCS:
            if d[0] == r["doc_id"]:
                tokens = [*words(lowered(d[1])), "</s>"]
                options.append((len(tokens), sum(training[t] > 0 for t in tokens), sum(np.log10((training[t] + 1) / (n + v + 1)) for t in tokens)))
        assert r["train_tokens"] == n and any((r["n_tokens"], r["n_known"]) == o[:2] and abs(r["base_score"] - o[2]) < 1e-6 * abs(o[2]) for o in options)
    assert kneser_ney.score(kneser_ney.prepared(frame(spark, [])), kneser_ney.train(texts.limit(0).select("text"))[0]).count() == 0


def test_pipeline_stages(spark, scratch):
    import corpus_pipeline

    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    item = prose(70, 40)
    docs = DOCS + [(300, prose(301, 100) + " " + item, "en", "s", 0), (301, f'{prose(302, 100)} token = "{key}" {"tamonselkuverdanosttari" * 2}', "en", "s", 0)]
    frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, scratch).collect()
    ids = {r["doc_id"] for r in rows}
    assert {1, 7, 301} <= ids and not {2, 3, 4, 5, 6, 13, 300} & ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
