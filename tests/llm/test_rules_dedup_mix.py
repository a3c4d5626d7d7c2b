import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quartermark.llm import mixing, quality_rules, trie_dedup

EDGE = [(1, None), (2, ""), (3, "Same TEXT"), (4, "same text"), (4, "same text"), (None, "same text"), (None, "alone"), (5, "É"), (6, "é"), (7, "w " * 100_000), (8, "w " * 100_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", True) for i, t in rows], "doc_id long, text string, keep_id string, kept boolean")


@pytest.mark.parametrize("budget", [8, 200, 1 << 20])
def test_trie_matches_dictionary(budget):
    for seed in range(60):
        rng, trie, want = random.Random(seed), trie_dedup.Trie(budget), defaultdict(list)
        for i in range(rng.randint(0, 80)):
            key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) * rng.randint(1, 3)
            want[key].append(i)
            trie.insert(key, (True, i), 1, i, 1)
        got = sorted((k, b[1], n, row) for k, b, n, row in trie.owners())
        assert got == sorted((k, max(v), len(v), max(v)) for k, v in want.items())


@pytest.mark.parametrize("largest", [True, False])
def test_owners(spark, largest):
    got = trie_dedup.owners(frame(spark, EDGE), largest=largest, budget=64).collect()
    fold = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for i, t in EDGE:
        groups[fold(t)].append(i)
    pick = max if largest else min
    want = []
    for i, t in EDGE:
        g = groups[fold(t)]
        keep = pick([x for x in g if x is not None], default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(fold(t)).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_survivors_are_whole_rows(spark):
    df = frame(spark, EDGE)
    got = trie_dedup.survivors(df, budget=64)
    assert got.schema == df.schema
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("2", ""), ("4", "same text"), ("None", "alone"), ("5", "É"), ("6", "é"), ("8", "w " * 100_000)])
    assert trie_dedup.survivors(df.limit(0)).count() == 0 == trie_dedup.owners(df.limit(0)).count()


def test_rules_keep_clean_and_drop_junk(spark):
    rng = random.Random(2)
    clean = ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8)) for _ in range(20))
    junk = " ".join(f"###{i} $$$" for i in range(60))
    loop = "again and again " * 60
    rows = [(1, clean), (2, junk), (3, loop), (4, None), (5, ""), (6, "short text"), (None, clean)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int")
    got = {(r.doc_id, r.kept, r.base_failed, r.n_words) for r in quality_rules.judge(df).collect()}
    assert {(i, k) for i, k, _, _ in got} == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (None, True)}
    assert (3, False, True, 180) in got and (2, False, False, 120) in got
    kept = quality_rules.passing(df)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {1, None}
    assert quality_rules.passing(df.limit(0)).count() == 0 == quality_rules.judge(df.limit(0)).count()


def test_rule_order_prefers_cheap_rejection_and_never_changes_the_verdict():
    texts = [(f"{'#' if i % 2 else ''}word {i}".encode(), 10) for i in range(50)]
    costly = lambda f: sum(i * i for i in range(3000)) < 0
    rules = [("costly", costly), ("symbols", lambda f: f.n_symbols > 0)]
    assert quality_rules.measure(texts, rules) == ["symbols", "costly"]


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot", "hot", "hot"])) for i in range(3000)]
    rows += [(9001, None, "a"), (9002, "", "empty"), (None, "x y", "b"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mixture(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, mixing.mixture(df).collect())) == sorted(map(str, got))
    per = defaultdict(list)
    for r in got:
        per[r.source_size].append(r)
    total = sum(r.size for r in got)
    goals = {k: v[0].target for k, v in per.items()}
    assert abs(sum(goals.values()) - total) < 1e-6 * total
    for k, v in per.items():
        assert goals[k] <= 3 * k + 1e-9 and abs(sum(r.taken for r in v) - goals[k]) <= 31
    out = mixing.mixed(df)
    assert out.schema == df.schema
    times = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert sum(len((t or "").split()) * n for (_, t, _), n in times.items()) == sum(r.taken for r in got)
    assert mixing.mixture(df.limit(0)).count() == 0 == mixing.mixed(df.limit(0)).count()
