import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermark.llm import simhash
from tests.llm.brute import classes
from tests.llm.brute import simhash as plain

TEXTS = [None, "", "  \n", "one", "One TWO", "one two three", "Ünï cödé words here\tand there x", "a b " * 400, "x" * 200_000, "p q r s " * 30_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_matches_bit_counts(text):
    raw = (text or "").encode()
    assert int.from_bytes(simhash.fingerprint(raw, 3), "big") == plain(text)


def near_prints(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return sorted(set(out))


@pytest.mark.parametrize("meeting", [1, 3, 32])
def test_links_connect_what_all_pairs_connect(spark, meeting):
    prints = near_prints(300, 5)
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for p in prints], "fp binary")
    links = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in simhash.linked(df, meeting).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    have = set(links) | {(b, a) for a, b in links}
    assert classes(prints, lambda a, b: (a, b) in have) == want


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, texts = [], []
    for i in range(60):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(200))
        texts.append(text)
        rows.append((i, text))
    return rows + [(100, None), (101, ""), (102, "Word"), (103, "word"), (103, "word"), (None, "word"), (None, texts[0])]


def test_near_duplicates_match_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()))
    prints = {n: plain(t) for n, (_, t) in enumerate(rows)}
    found = classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[found[n]] = min(i, least.get(found[n], i))
    want = sorted((i is None, i or 0, f"{prints[n]:016x}", least.get(found[n])) for n, (i, _) in enumerate(rows))
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.representatives(empty).count() == 0


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_representatives_keep_one_of_each_group_and_all_others(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, group = [], {}
    for g in range(60):
        base = [word() for _ in range(300)]
        for c in range(1 + g % 4):
            words = list(base)
            for _ in range(c):
                words[rng.integers(len(words))] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words), g))
    half = rows[0][1].split()[:150] + [word() for _ in range(150)]
    rows.append((len(rows), " ".join(half), 99))
    assert jaccard(rows[0][1], rows[-1][1]) < 0.5
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted(r.fp for r in kept) == [*range(60), 99]
    firsts = {}
    for i, g in group.items():
        firsts.setdefault(g, i)
    assert {r.doc_id for r in kept} == {*firsts.values(), len(rows) - 1}


def test_less_similar_texts_stay(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, want = [], set()
    for g in range(80):
        base = [word() for _ in range(300)]
        words = list(base)
        while jaccard(" ".join(base), " ".join(words)) > (0.81 if g % 2 else 0.79):
            words[rng.integers(300)] = word()
        pair = [" ".join(base), " ".join(words)]
        near = jaccard(*pair) >= 0.8
        rows += [(2 * g, pair[0]), (2 * g + 1, pair[1])]
        want |= {2 * g} if near else {2 * g, 2 * g + 1}
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= kept and len(kept - want) <= 8


def test_every_pair_at_the_threshold_is_found(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for g in range(300):
        base = [word() for _ in range(121)]
        words = list(base)
        words[10], words[60], words[118] = word(), word(), word()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(words))]
    assert jaccard(rows[0][1], rows[1][1]) == 0.8
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {2 * g for g in range(300)}


def test_pairs_inside_groups_of_half_similar_texts_are_found(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, passage, sheet = [], [word() for _ in range(150)], [word() for _ in range(120)]
    for _ in range(80):
        own = [word() for _ in range(45)]
        for _ in range(2):
            words = list(own)
            for _ in range(2):
                words[rng.integers(45)] = word()
            rows.append((len(rows), " ".join(passage + words)))
    for _ in range(90):
        words = list(sheet)
        for _ in range(rng.integers(1, 7)):
            words[rng.integers(120)] = word()
        rows.append((len(rows), " ".join(words)))
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    found = classes(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(found.values())


def test_a_long_run_of_one_token_neither_joins_nor_parts_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    one, two, three = ([word() for _ in range(100)] for _ in range(3))
    texts = [one + ["-"] * 40, two + ["-"] * 40, three, three + ["-"] * 80]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {0, 1, 2}


def test_rows_that_share_an_id_and_odd_column_names(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base, other = ([word() for _ in range(80)] for _ in range(2))
    texts = [(1, base), (2, [*base, word()]), (2, other), (None, base), (3, other), (2, other)]
    rows = [(i, " ".join(t), n, 0, 0, 0) for n, (i, t) in enumerate(texts)] + [(9, None, 6, 0, 0, 0), (8, "", 7, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, __lost int, digest int, node int")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.place for r in kept.collect()) == [0, 2, 3, 5, 7]


def test_the_order_of_shingles_makes_no_difference(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abc"), 2))
    rows = []
    for _ in range(60):
        words = [word() for _ in range(100)]
        for _ in range(3):
            rows.append((len(rows), " ".join(words)))
            words = [*words[:40], word(), *words[41:]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [sorted(r.doc_id for r in simhash.representatives(df, sample=n).collect()) for n in (1, 30, 1000)]
    assert kept[0] == kept[1] == kept[2]


def test_meetings_of_the_same_sets_are_one(spark):
    # Places follow one order of keys: 5, 1, 9, 7.
    met = [(5, 1, 0), (5, 2, 0), (1, 1, 1), (1, 2, 1), (9, 1, 2), (9, 2, 2), (9, 3, 0), (7, 1, 3), (7, 2, 3), (7, 3, 1)]
    rows = spark.createDataFrame(met, "key long, node long, place int").withColumn("size", F.lit(9))
    got = {tuple(r) for r in simhash._distinct_meetings(rows).select("key", "node", "place").collect()}
    assert got == {x for x in met if x[0] in (5, 9)}
    assert simhash._distinct_meetings(rows.limit(0)).count() == 0


def test_a_large_group_of_near_copies_needs_few_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base, rows = [word() for _ in range(150)], []
    for i in range(160):
        words = list(base)
        for _ in range(rng.integers(2, 4) if i != 77 else 0):
            words[rng.integers(150)] = word()
        rows.append((len(rows), " ".join(words)))
    compared, confirmed = [], simhash._confirmed
    monkeypatch.setattr(simhash, "_confirmed", lambda pairs, *others: compared.append(pairs.count()) or confirmed(pairs, *others))
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    found = classes(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id for r in kept} == set(found.values())
    assert sum(compared) <= 10 * len(rows), compared


def test_keys_that_are_common_outside_the_sample_come_last(spark):
    rng = np.random.default_rng(22)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join(passage + [word() for _ in range(100)])) for i in range(60)]
    signed = simhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), sample=1).collect()
    common = set(simhash.shingle_hashes(" ".join(passage).encode(), 5).tolist())
    met = [len(common & set(np.frombuffer(r["keys"], np.uint64).tolist())) for r in signed]
    assert sum(met) <= 120
