import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quartermark.llm import token_counts

PATH = token_counts.default_path()
PLAIN = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = "aB1\xe9's\xdf  ▁\n\t\r\x01\x1c\xa0　​́\U0001f600中文\0<s/>.,!-_Ω"


def in_parts(text, size):
    tool = token_counts.counter(PATH)
    parts = tool.guarded(text, size)
    return sum(tool.lengths(parts, [i == 0 for i in range(len(parts))])), len(parts)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(ODD) | st.sampled_from("the ing tion") | st.characters(blacklist_categories=["Cs"]), max_size=120), st.integers(1, 9))
def test_parts_add_up_to_the_library(text, size):
    assert in_parts(text, size)[0] == len(PLAIN.encode(text))


def test_long_texts_of_each_kind():
    rng = random.Random(3)
    kinds = ["a" * 9000, "the cat sat on  the mat. " * 900, "中文字" * 900, "\n" * 800, " " * 3000, "7" * 999, "é́" * 500, "<s></s><unk>" * 90]
    kinds += ["".join(rng.choice(["the", "ing", " ", "  ", "tion", "ßß", "▁", "12", "\n"]) for _ in range(4000)) for _ in range(10)]
    for text in kinds:
        for size in (7, 100, 1000):
            assert in_parts(text, size)[0] == len(PLAIN.encode(text))
    assert in_parts("the cat sat " * 900, 100)[1] > 50


def test_counts_of_a_table(spark):
    texts = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x y " * 9000), (None, "x y " * 9000), (4, "z" * 30_000), (5, " lead\n\n trail "), (4, "word " * 4100)]
    df = spark.createDataFrame([(i, t, 0, "a") for i, t in texts], "doc_id long, text string, n_tokens int, part string")
    want = sorted((str(i), len((t or "").encode()), len(PLAIN.encode(t or "")), len(PLAIN.encode(t or "")) > 4096) for i, t in texts)
    for spread in (token_counts.SPREAD, 1000, 3):
        got = token_counts.count(df, part=500, spread=spread).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count(df.limit(0)).count() == 0


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.count(docs).collect()}
    assert got == {r.doc_id: len(PLAIN.encode(r.text or "")) for r in docs.collect()}
