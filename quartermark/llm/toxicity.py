"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two words counts the letter triples they share in order, gaps allowed: an occurrence
that spans s letters weighs DECAY ** s, spans end at SPAN, and the word's ends are letters too. So
inserted or dropped characters cost a little, not the match. Words are folded to lower case, marks
inside them fall away, and three or more letters standing alone in a row are read as one word.

Sentences of labelled documents inherit the label, and a sentence is as toxic as its worst word. In
training, words are told apart by the sentences they come from: landmarks are the words whose
sentences differ most in label, and the commonest others; words of toxic sentences far beyond chance
are positive, also with a character inserted, words of clean sentences negative; a second round adds
the worst word of toxic documents in which none was found and the clean words that came near. A squared-hinge machine is trained on the
Nystrom map of the kernel. Since the map is linear in a word's triples, the machine folds into one
weight per triple, and scoring a word needs no landmark at all.

A document's score is a logistic of its three worst distinct words' margins and of the log of their
number, fitted on the same training rows. Whole texts are read; empty and null texts have no words and get the score of that.
Labels of a document that appears more than once are combined by the greatest. Without rows of both
labels every score is the smoothed share of toxic rows. Only the model, of fixed size, is broadcast.
"""

from __future__ import annotations

import heapq
import io
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.llm.common import as_text, per_process, slices
from quartermark.llm.language_id import held_out

#: Labelled rows the machine is trained on at most, in the order of a hash of the id.
TRAIN_ROWS = 12_000
#: Kernel: triples of letters, decay per letter spanned, longest span.
DECAY, SPAN = 0.6, 5
#: Landmarks by contrast and by frequency, and clean words taken as negatives.
CONTRAST, COMMON, NEGATIVES = 96, 64, 12_000
#: Classes of letters: start, end, other, then the commonest letters.
CLASSES = 64
#: Words whose margins a Python worker keeps.
CACHE = 600_000
#: Texts of fewer distinct words are calibrated as if they had so many.
LEAST_WORDS = 60
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
#: Code points that are no characters, as a word's ends.
START, STOP = "\ufffe", "\uffff"
_ALONE = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\W_]+){2,}[^\W\d_](?![^\W\d_])")
_MARKS = re.compile(r"[\W_]+")


def words(text: str) -> set[str]:
    """Distinct folded words of a text."""
    text = text.lower()
    out = {w if w.isalnum() else _MARKS.sub("", w) for w in set(text.split())}
    out.update(_MARKS.sub("", m) for m in _ALONE.findall(text))
    out.discard("")
    return out


class Kernel:
    """Weighted triples of words over an alphabet of CLASSES letters."""

    def __init__(self, alphabet: str):
        self.alphabet = alphabet
        self.table = np.full(0x110000, 2, np.int64)
        self.table[ord(START)], self.table[ord(STOP)] = 0, 1
        for i, c in enumerate(alphabet[: CLASSES - 3]):
            self.table[ord(c)] = 3 + i

    def triples(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, triple, weight) sorted by both, weights scaled to a norm of 1 per word."""
        sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 2
        raw = np.frombuffer("".join([f"{START}{w}{STOP}" for w in batch]).encode("utf-32-le", "replace"), "<u4")
        c, own = self.table[raw], np.repeat(np.arange(len(batch)), sizes)
        keys, weights = [], []
        for j, k in combinations(range(1, SPAN), 2):
            inside = np.flatnonzero(own[:-k] == own[k:]) if k < len(own) else np.empty(0, np.int64)
            triple = (c[inside] * CLASSES + c[inside + j]) * CLASSES + c[inside + k]
            keys.append(own[inside] << 18 | triple)
            weights.append(np.full(len(inside), DECAY ** (k + 1)))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        key, weight = key[first], np.add.reduceat(weight, first) if len(first) else weight
        word = key >> 18
        norm = np.sqrt(np.bincount(word, weight * weight, len(batch)))
        return word, key & ((1 << 18) - 1), weight / norm[word]


class Model:
    """Weight per triple, bias, and the logistic over a document's worst margins and size."""

    def __init__(self, alphabet: str, weights: np.ndarray, bias: float, logistic: np.ndarray):
        self.kernel, self.weights, self.bias, self.logistic = Kernel(alphabet), weights, bias, logistic
        self.known: dict[str, float] = {}

    def margins(self, batch: list[str]) -> np.ndarray:
        word, triple, weight = self.kernel.triples(batch)
        return np.bincount(word, weight * self.weights[triple], len(batch)) + self.bias

    def margin(self, word: str) -> float:
        if word not in self.known:
            self.known[word] = float(self.margins([word])[0])
        return self.known[word]

    def worst(self, bags: list[set[str]]) -> np.ndarray:
        """Three greatest margins of each bag's words, -2 where there are fewer, and the log of its size."""
        if len(self.known) > CACHE:
            self.known = {}
        new = list(set().union(*bags) - self.known.keys())
        for at in range(0, len(new), 20_000):
            self.known.update(zip(new[at : at + 20_000], self.margins(new[at : at + 20_000]).tolist()))
        out = np.full((len(bags), 4), -2.0)
        for i, bag in enumerate(bags):
            top = heapq.nlargest(3, map(self.known.__getitem__, bag))
            out[i, : len(top)] = np.maximum(top, -2.0)
            out[i, 3] = np.log(max(len(bag), LEAST_WORDS))
        return out

    def scores(self, bags: list[set[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.worst(bags) @ self.logistic[1:] + self.logistic[0])))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights.astype(np.float32), bias=self.bias, logistic=self.logistic, alphabet=np.array([ord(c) for c in self.kernel.alphabet], np.int64))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        z = np.load(io.BytesIO(raw))
        return cls("".join(map(chr, z["alphabet"])), z["weights"].astype(np.float64), float(z["bias"]), z["logistic"])


def landmarks_map(kernel: Kernel, landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(triple weights of the landmarks, dense; inverse root of their kernel matrix)."""
    word, triple, weight = kernel.triples(landmarks)
    z = np.zeros((len(landmarks), CLASSES**3), np.float32)
    z[word, triple] = weight
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64) + 1e-3 * np.eye(len(z)))
    return z, (vectors / np.sqrt(values)) @ vectors.T


def nystrom(kernel: Kernel, z: np.ndarray, root: np.ndarray, batch: list[str]) -> np.ndarray:
    """Rows of the Nystrom map of words."""
    used = np.flatnonzero(z.any(axis=0))
    column = np.full(z.shape[1], -1, np.int64)
    column[used] = np.arange(len(used))
    dense, out = np.ascontiguousarray(z[:, used].T), []
    for at in range(0, len(batch), 2000):
        part = batch[at : at + 2000]
        word, triple, weight = kernel.triples(part)
        k = column[triple]
        word, weight, k = word[k >= 0], weight[k >= 0], k[k >= 0]
        x = np.zeros((len(part), len(used)), np.float32)
        x[word, k] = weight
        out.append((x @ dense).astype(np.float64) @ root)
    return np.concatenate(out)


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) of the L2 support vector machine with costs `c`, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        on = y * (x @ w) < 1
        a = x[on] * c[on, None]
        new = np.linalg.solve(a.T @ x[on] + ridge * np.eye(x.shape[1]), a.T @ y[on])
        done = np.abs(new - w).max() < 1e-8
        w = new if done else w + 0.7 * (new - w)
        if done:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w


def inserted(word: str, spare: str) -> str:
    """The word with one letter put inside, at a place fixed by the word."""
    at = 1 + sum(map(ord, word)) % max(1, len(word) - 1)
    return word[:at] + spare[len(word) * 7 % len(spare)] + word[at:]


def train(texts: list[str], toxic: list[int]) -> Model:
    """The machine and its calibration from labelled texts."""
    y = np.array(toxic, np.float64)
    bags = [words(t) for t in texts]
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    share = np.array([np.log((n1 + 1) / (n0 + 1)), 0, 0, 0, 0])
    if not n1 or not n0:
        return Model("a", np.zeros(CLASSES**3), 0.0, share)
    bad, good = Counter(), Counter()
    for bag, t in zip(bags, toxic):
        (bad if t else good).update(bag)
    letters = Counter()
    for w, n in (bad + good).items():
        for c in w:
            letters[c] += n
    alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: CLASSES - 3])
    kernel = Kernel(alphabet)

    def contrast(w: str) -> float:
        """Log-likelihood ratio of the word's documents being toxic by chance; 0 unless far more often."""
        a, b = bad[w], good[w]
        if a * (n0 + 1) < 8 * (b + 0.5) * (n1 + 1):
            return 0.0
        e = (a + b) * n1 / (n1 + n0)
        return 2 * (a * np.log(a / e) + (b * np.log(b / (a + b - e)) if b else 0.0))

    ranked = sorted(((contrast(w), w) for w, a in bad.items() if a >= 3), key=lambda x: (-x[0], x[1]))
    positive = [w for g, w in ranked if g > 20]
    if not positive:
        return Model(alphabet, np.zeros(CLASSES**3), 0.0, share)
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if w not in positive]
    z, root = landmarks_map(kernel, positive[:CONTRAST] + common[:COMMON])
    rest = common[COMMON:]
    negative = common[:COMMON] + rest[:: max(1, len(rest) // NEGATIVES)]
    model = None
    for _ in range(2):
        rows = positive + [inserted(w, alphabet[:20]) for w in positive] + negative
        sign = np.array([1.0] * (2 * len(positive)) + [-1.0] * len(negative))
        cost = np.array([min(50.0, bad[w]) for w in positive] + [min(50.0, bad[w]) / 4 for w in positive] + [min(5.0, 0.5 * good[w]) for w in negative])
        w = squared_hinge(nystrom(kernel, z, root, rows), sign, cost)
        model = Model(alphabet, ((root @ w[:-1]) @ z).astype(np.float64), w[-1], share)
        seen = set(positive)
        missed = [max(bag, key=lambda v: (model.known[v], v)) for bag, t, m in zip(bags, toxic, model.worst(bags)) if t and bag and not bag & seen and m[0] > 0]
        positive = positive + sorted(set(missed) - seen)
        hard = [w for w in rest if w not in seen and model.margin(w) > -0.5]
        negative = sorted({*negative, *hard[:NEGATIVES]})
    model.logistic = logistic(model.worst(bags), y)
    return model


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    """Trains in one task on at most `rows` labelled documents outside the held-out part."""
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    picked = known.filter(~held_out("doc_id", 3, 1)).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    sample = docs.join(F.broadcast(picked), "doc_id").select("text", "toxic").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted((t, y) for b in batches for t, y in zip(as_text(b.column(0)), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_pydict({"model": pa.array([train([t for t, _ in pairs], [y for _, y in pairs]).dump()], pa.binary())})

    found = sample.mapInArrow(run, "model binary").first()
    return found.model if found else train([], []).dump()


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. `labels` has doc_id and toxic (0 or 1)."""
    kind = docs.schema[id].dataType
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    raw = fitted(own, labels.select("doc_id", "toxic"), rows)
    model = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = per_process(("toxicity", model.value), lambda: Model.load(model.value))
        for part in slices(batches):
            found = tool.scores([words(t) for t in as_text(part.column(1))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.float64()), pa.array(found >= THRESHOLD).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return own.withColumn("held_out", held_out("doc_id", 3, 1)).mapInArrow(run, schema)
