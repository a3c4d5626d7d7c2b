import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartermark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def plain(rows, least=30, best=2000, longest=4):
    f, n = plain_counts(rows, longest)
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        holders = (b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * b >= 80 * a for b in holders):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:best]))


def mined(df, **sizes):
    got = collocations.collocations(df, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \t.,\né"), max_size=80), st.integers(1, 30))
def test_segments_hold_every_suffix_once(text, size):
    def found(parts):
        seen = Counter()
        for raw, end in parts:
            words, table = collocations.suffixes(raw, end, 4)
            names = words.to_pylist()
            seen.update(tuple(names[c] for c in column if c >= 0) for column in table.T.tolist())
        return seen

    raw = text.encode()
    assert found(collocations.segments(raw, size, 4)) == found([(raw, len(raw))])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 4), min_size=3, max_size=3), max_size=60), st.integers(1, 5))
def test_equal_parts_are_counts(rows, least):
    rows = [r[: r.index(-1)] + [-1] * (3 - r.index(-1)) if -1 in r else r for r in rows]
    table = np.array(rows, np.int32).reshape(-1, 3).T
    got = {tuple(table[:n, p].tolist()): c for p, n, c in collocations.equal_parts(table, np.ones(len(rows), int), least)}
    once = collocations._distinct(table, np.ones(len(rows), int))
    assert got == {tuple(once[0][:n, p].tolist()): c for p, n, c in collocations.equal_parts(*once, least)}
    assert Counter(map(tuple, rows)) == dict(zip(map(tuple, once[0].T.tolist()), once[1].tolist()))
    want = Counter(tuple(r[:n]) for r in rows for n in (1, 2, 3) if r[n - 1] >= 0)
    assert got == {k: v for k, v in want.items() if v >= least}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["of", "the", "New", "york", "é", "中文", "a", "b", "x-y", "\x00"]
    rows = []
    for _ in range(2500):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n", "\t", "!?"]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "de", None, "und", ""]), " ".join(words)))
    rows += [("en", None), (None, ""), ("xx", " ,, \n"), ("en", "go " * 4000), ("de", "the end is near. " * 400), ("de", "THE END is NEAR. " * 40)]
    return rows


def test_table(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, part int, phrase string")
    want = plain(rows)
    assert len(want) > 100 and mined(df) == want
    # Everything is heavy: routed by three words, then counted where it lies.
    assert mined(df, small=10, large=20, batch=500, group_bytes=300) == want
    assert mined(df, small=300, large=300) == want
    assert mined(df, best=7, least=50) == plain(rows, 50, 7)
    assert mined(df, longest=3) == plain(rows, longest=3)


def test_edges(spark):
    schema = "lang string, text string"
    for rows in ([], [("en", None)], [(None, "a b c")] * 3):
        assert mined(spark.createDataFrame(rows, schema)) == []
    same = [(None, "a b c d e")] * 40
    assert mined(spark.createDataFrame(same, schema)) == plain(same)
