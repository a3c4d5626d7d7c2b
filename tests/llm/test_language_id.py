import random
import zlib

import pytest
from pyspark.sql import functions as F

from quartermark.llm import language_id
from quartermark.llm.common import documents


def plain_phrases(text, sample):
    """Phrases of the greedy parse of the whole text, by searching the sample."""
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n += 1
        i = max(j, i + 1)
    return n


@pytest.mark.parametrize("cells", [1, 40_000, language_id.CELLS])
def test_parse_matches_substring_search(cells):
    rng = random.Random(1)
    texts = {k: "".join(rng.choice(abc) for _ in range(600)) for k, abc in (("a", "abc "), ("b", "abde "), ("c", "xyzé "), ("d", "中文字词语言 "))}
    texts = {k: " " + " ".join(v.split()) + " " for k, v in texts.items()}
    parser = language_id.Parser(texts, cells)
    odd = ["".join(rng.choice("abcdexyzéqß 中文!") for _ in range(n)) for n in (1, 5, 300, 511, 512, 513, 5000)]
    odd += [texts["a"] * 9, texts["d"] * 5 + "q" + texts["c"][7:] * 3]
    folded = [" " + language_id.fold(t) + " " for t in odd]
    kept = [(t, f) for t, f in zip(odd, folded) if f.strip()]
    got = parser.phrases([parser.codes(t) for t, _ in kept]).tolist()
    assert got == [[plain_phrases(f, texts[k]) for k in parser.names] for _, f in kept]


def test_language_of_long_texts_only(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, "der hund und die katze " * 400, "de") for i in range(20)]
    rows += [(500, "die katze und der hund", None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.filter("doc_id = 500").first().lang_pred == "de"


def test_automaton_accepts_exactly_the_substrings():
    text = "abcbcabbac"
    edges = language_id.suffix_automaton(text)

    def accepts(w):
        s = 0
        for c in w:
            if c not in edges[s]:
                return False
            s = edges[s][c]
        return True

    words = {a + b + c + d for a in "abc" for b in ["", *"abc"] for c in ["", *"abc"] for d in ["", *"abc"]}
    assert all(accepts(w) == (w in text) for w in words)


def test_edge_rows(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(40)] + [(100 + i, "der hund und die katze", "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (503, "the dog " * 30_000, None), (None, "die katze", None), (7, "the cat and the dog", "en"), (504, "ж", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "en", "de"]
    assert by[504].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, all_ = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert all_ > 150 and right > 0.97
