import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quartermark.llm import lm_scoring
from quartermark.llm.common import documents, table


def tokens(text):
    return ["", "", *text, ""]


def plain_model(texts, size):
    """Witten-Bell interpolated trigrams by dictionaries; `size` tokens in the vocabulary, boundary included."""
    follow = defaultdict(Counter)
    for t in texts:
        w = tokens(t)
        for i in range(2, len(w)):
            for k in range(3):
                follow[tuple(w[i - k : i])][w[i]] += 1

    def p(context, c):
        lower = p(context[1:], c) if context else 1 / size
        seen = follow.get(context)
        return (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    def loss(t):
        w = tokens(t)
        return sum(-math.log(p(tuple(w[i - 2 : i]), w[i])) for i in range(2, len(w))) / (len(w) - 2)

    return loss


@pytest.mark.parametrize("hot", [0, 5, 1 << 18])
def test_scores_match_dictionaries(spark, hot, monkeypatch):
    monkeypatch.setattr(lm_scoring.grams, "__defaults__", (64,))
    texts = ["a banana Bandana", "ananas a", "", None, "cab \xe9 cab\x85x", "zzz " * 400, "ban a ban", "ban a ban", "a banana", "ban a ban",
             "\u4e2d\u6587 \u5b57 \u4e2d\u6587 \u8bcd", "\u5b57 \u8bcd", " \t\n", "w" * 500]
    ids = [1, 2, 3, 4, 5, 6, 7, 7, None, 8, 9, 10, 11, None]
    docs = spark.createDataFrame([(i, t, 0.5, "k") for i, t in zip(ids, texts)], "doc_id long, text string, score double, key string").repartition(3)
    target = spark.createDataFrame([(1,), (1,), (7,), (9,), (None,), (99,)], "doc_id long")
    got = lm_scoring.score(docs, target, hot=hot).collect()
    size = len({w for t in texts for w in tokens(t or "")})
    back = plain_model([t or "" for t in texts], size)
    want = plain_model([t or "" for i, t in zip(ids, texts) if i in (1, 7, 9)], size)
    rows = sorted((str(i), len(t or "") + 1, back(t or ""), want(t or "")) for i, t in zip(ids, texts))
    have = sorted((str(r.doc_id), r.n_tokens, r.background_loss, r.target_loss) for r in got)
    for a, b in zip(have, rows, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
    assert all(r.score == pytest.approx(r.background_loss - r.target_loss) for r in got)


def test_table_grows_with_the_corpus(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('x', id) as text")
    table = lm_scoring.models(docs, docs.selectExpr("doc_id as __id"))
    want = {(a, b, c) for i in range(300) for a, b, c in zip(*[tokens(f"x{i}")[k:] for k in range(3)])}
    assert table.count() == len(want) and lm_scoring.common(table, 10).count() <= 10


def test_edges(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert lm_scoring.score(docs, docs.select("doc_id").limit(0)).first().score == 0
    assert lm_scoring.score(docs.limit(0), docs.select("doc_id")).count() == 0


def test_tells_junk_from_prose(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = table(spark, sf_dir, "labels")
    got = lm_scoring.score(documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id")).join(labels, "doc_id")
    means = {r.quality: r.m for r in got.groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0]
