import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartermark.llm import bpe_codec

PATH = bpe_codec.default_path()
PLAIN = Tokenizer.from_file(PATH)
ODD = "aB1\xe9's\xdf  \n\t\r\x0b\x1c\x1d\x85\xa0\u2003\u3000\u200b\u0301\U0001f600\u4e2d\0<|>endoftext.,!-_\u03a9\u1680"


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.fixture(scope="module")
def tools():
    return [bpe_codec.Codec(PATH, leaf) for leaf in (3, 7, 64)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD) | st.characters(blacklist_categories=["Cs"]), max_size=60), max_size=4))
def test_equals_the_library(texts):
    for leaf in (3, 64):
        tool = bpe_codec.per_process(("test", leaf), lambda leaf=leaf: bpe_codec.Codec(PATH, leaf))
        got = [tool.encode(t) for t in texts]
        assert [ids(g) for g in got] == [plain(t) for t in texts]
        assert [tool.decode(g) for g in got] == [PLAIN.decode(plain(t), skip_special_tokens=False) for t in texts]


def test_long_unsplit_runs(tools):
    rng = random.Random(4)
    runs = ["a" * 5000, "ab" * 3000, "".join(rng.choice("etaoinshr") for _ in range(20_000)), "中文" * 900, "\n" * 700, "!?" * 900 + "'", "é́" * 500, "7" * 999, " x" + "y" * 600]
    runs += ["".join(rng.choice(["the", "ing", "tion", "ééé", "'ll", "ß", "12"]) for _ in range(500)) for _ in range(20)]
    for tool in tools:
        assert [ids(g) for g in map(tool.encode, runs)] == [plain(r) for r in runs]


def test_special_strings_and_stray_ids(tools):
    text = "a<|endoftext|>b <|endoftext|><|endoftext|> <|endof text"
    assert ids(tools[2].encode(text)) == plain(text) and 50256 in plain(text)
    broken = plain("中é")[:1] + [50256]
    assert tools[2].decode(np.array(broken, "<u4").tobytes()) == PLAIN.decode(broken, skip_special_tokens=False)


def test_round_trip_of_a_table(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x " * 50_000), (4, "z" * 30_000), (5, " lead\n\n trail ")]
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, ids binary")
    got = bpe_codec.round_trip(df)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(plain(t or "")), sha(np.array(plain(t or ""), "<u4").tobytes()), sha((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert bpe_codec.round_trip(df.limit(0)).count() == 0
    apart = bpe_codec.decode(bpe_codec.encode(df)).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in apart) == sorted((str(i), t or "") for i, t in rows)
