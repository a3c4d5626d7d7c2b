import random
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quartermark.llm import toxicity
from quartermark.llm.common import documents, table


def plain_kernel(a, b):
    """Normalised gap-weighted kernel by listing all triples."""

    def profile(w):
        w, out = f"^{w}$", {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    x, y = profile(a), profile(b)
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_matches_listing():
    rng = random.Random(1)
    batch = ["a", "idiot", "idxiot", "\xe9t\xe9"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 15))) for _ in range(30)]
    kernel = toxicity.Kernel("abcidotx\xe9")
    word, triple, weight = kernel.triples(batch)
    dense = np.zeros((len(batch), toxicity.CLASSES**3))
    dense[word, triple] = weight
    got = dense @ dense.T
    want = np.array([[plain_kernel(a, b) for b in batch] for a in batch])
    assert np.allclose(got, want)


def test_nystrom_is_exact_on_landmarks():
    kernel = toxicity.Kernel("abcdefghijklmnopqrstuvwxyz")
    marks = ["stupid", "clown", "loser", "house", "garden"]
    z, root = toxicity.landmarks_map(kernel, marks)
    x = toxicity.nystrom(kernel, z, root, marks)
    assert np.allclose(x @ x.T, [[plain_kernel(a, b) for b in marks] for a in marks], atol=5e-3)


def corpus(n=900):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(60)], rng.random() < 0.2
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["grumbol", "zwackig", "fenderp"])
        rows.append((i, " ".join(words) + ".", int(bad)))
    return rows


def test_learns_words_and_their_variants():
    rows = corpus()
    model = toxicity.Model.load(toxicity.train([t for _, t, _ in rows], [y for *_, y in rows]).dump())
    got = model.scores([toxicity.words(t) for _, t, _ in rows]) >= toxicity.THRESHOLD
    assert (got == np.array([bool(y) for *_, y in rows])).mean() > 0.98
    clean = rows[[y for *_, y in rows].index(0)][1]
    variants = ["grumxbol gr-umbol grumboll", "g r u m b o l zwa.ckig fenderpp", "Zwackig! GRUMBOL fen_derp"]
    scores = model.scores([toxicity.words(clean + " " + v) for v in variants] + [toxicity.words(clean), set()])
    assert (scores[:3] > 0.5).all() and (scores[3:] < 0.3).all()


def test_edge_rows(spark):
    rows = [(i, t) for i, t, _ in corpus(300)] + [(1000, None), (1001, ""), (1001, ""), (None, "grumbol " * 50_000), (1002, "中\U0001f600")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in corpus(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {next(r.score for r in got if r.doc_id == 1000)}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = table(spark, sf_dir, "labels")
    got = toxicity.score(documents(spark, sf_dir), labels).filter("held_out").join(labels, "doc_id")
    hit, found, wanted, all_ = got.agg(
        F.sum(F.col("toxic") * F.col("predicted")), F.sum("predicted"), F.sum("toxic"), F.count("*")
    ).first()
    assert hit / found > 0.95 and hit / wanted > 0.75 and all_ > 1000
