"""Language identification by cross-parsing entropy.

For every language a bounded sample of labelled text is compiled to its suffix automaton, which
accepts exactly the sample's substrings. A document is parsed greedily against each: a phrase is the
longest match with the sample from where the last one ended, an unseen letter a phrase of its own.
The number of phrases times log2 of the sample's length, per letter, is the cross-parsing entropy;
the language that needs least wins, ties go to the language first by code point.

Whole texts are parsed, in blocks that run side by side through one table of all automata. A block
first starts anew; blocks whose predecessor ended elsewhere are parsed again from there until none
changes, which is the parse of the whole text: a greedy parse mostly falls in step within a few phrases.
The commonest letters have columns of that table, as many as CELLS allow, the rest sorted keys; the
parse does not depend on which.

A sample takes SAMPLE_ROWS texts in the order of a hash, of a longer text SAMPLE_TEXT characters from a
place that a hash chooses, and SAMPLE_CHARS characters together. The model is bounded by the number of
languages and does not grow with the corpus.

Letters are folded to lower case, everything else counts as one space. Null texts and texts without
a letter are `und` with score 0. Rows without a label are predicted, not learned from. Further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.llm.common import as_text, per_process, slices
from quartermark.operators.windows import topk_per_group

#: Rows per language that a sample is filled from, the most it takes of one text, and its length in characters.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS = 200, 4_000, 48_000
#: Cells of the automata's table.
CELLS = 1 << 25
#: Characters parsed in one row, and characters taken from a batch at a time.
BLOCK, CHUNK = 512, 4 << 20
SPACE, UNKNOWN, PAD, FIRST = 0, 1, 2, 3


def held_out(id: str, parts: int = 4, part: int = 2) -> Column:
    """Rows that are never learned from: crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def fold(text: str) -> str:
    """Lower case, runs of anything but letters as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions by state of the automaton of all substrings of `text`; state 0 is the start."""
    edges: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges


class Parser:
    """All languages' automata in one table of (state, letter) to 4 * row of the next state + phrases ended."""

    def __init__(self, samples: dict[str, str], cells: int = CELLS):
        self.names = sorted(samples)
        counts = Counter(c for t in samples.values() for c in t if c != " ")
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        code = {" ": SPACE} | {c: FIRST + i for i, c in enumerate(letters)}
        self.n_codes = FIRST + len(letters)
        self.bits = np.array([math.log2(max(2, len(samples[n]))) for n in self.names])
        automata = []
        for n in self.names:
            edges = suffix_automaton(samples[n])
            moves = np.array([(s, code[c], to) for s, out in enumerate(edges) for c, to in out.items()], np.int64).reshape(-1, 3)
            automata.append((len(edges), moves))
        rows = sum(n for n, _ in automata)
        self.width = width = min(self.n_codes, max(FIRST, cells // max(1, rows)))
        table, at, keys, to = np.empty((rows, width), np.int32), 0, [], []
        self.roots = np.empty(len(self.names), np.int32)
        for i, (n, moves) in enumerate(automata):
            self.roots[i] = root = at * width
            start = np.full(width, 4 * root + 1, np.int32)  # an unseen letter is a phrase
            dense = moves[moves[:, 1] < width]
            first = dense[dense[:, 0] == 0]
            start[first[:, 1]] = 4 * (at + first[:, 2]) * width
            table[at] = start
            table[at + 1 : at + n] = start + 1  # the phrase before ends as well
            table[at + dense[:, 0], dense[:, 1]] = 4 * (at + dense[:, 2]) * width
            table[at : at + n, PAD] = 4 * width * np.arange(at, at + n)
            rare = moves[moves[:, 1] >= width]
            keys.append((at + rare[:, 0]) * self.n_codes + rare[:, 1])
            to.append(4 * (at + rare[:, 2]) * width)
            at += n
        self.table = table.ravel()
        keys, to = np.concatenate([*keys, np.empty(0, np.int64)]), np.concatenate([*to, np.empty(0, np.int64)])
        order = np.argsort(keys)
        self.rare_keys, self.rare_to = keys[order], to[order].astype(np.int32)
        kinds = np.fromiter((UNKNOWN if chr(c).isalpha() else SPACE for c in range(0x110000)), np.int32, 0x110000)
        for c, k in code.items():
            kinds[ord(c)] = k
        self.kinds = kinds

    def rare_moves(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is one, where to) of transitions by letters without a column."""
        key = (state // self.width).astype(np.int64) * self.n_codes + letter
        at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
        return self.rare_keys[at] == key, self.rare_to[at]

    def advance(self, columns: np.ndarray, block: np.ndarray, state: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases ended, last state) of the parse of each block from its state; `columns` is characters x blocks."""
        ended, width = np.zeros(len(state), np.int32), self.width
        some_rare = bool((columns >= width).any())
        for column in columns:
            letter = column[block]
            if some_rare and (rare := np.flatnonzero(letter >= width)).size:
                step = self.table[state + np.where(letter >= width, UNKNOWN, letter)]
                held, to = self.rare_moves(state[rare], letter[rare])
                anew, start = self.rare_moves(root[rare], letter[rare])
                step[rare] = np.where(held, to, np.where(anew, start + 1, step[rare]))
            else:
                step = self.table[state + letter]
            ended += step & 3
            state = step >> 2
        return ended, state

    def codes(self, text: str) -> np.ndarray:
        """Letter codes of the folded text with a space on either side."""
        raw = self.kinds[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")]
        return raw[np.concatenate([[True], (raw[1:] != SPACE) | (raw[:-1] != SPACE)])]

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language: (texts, languages)."""
        if not codes:
            return np.zeros((0, len(self.names)), np.int64)
        rows = np.array([-(-len(c) // BLOCK) for c in codes])
        grid = np.full((rows.sum(), BLOCK), PAD, np.int32)
        starts = np.cumsum(rows) - rows
        for c, at in zip(codes, starts.tolist()):
            grid.ravel()[at * BLOCK : at * BLOCK + len(c)] = c
        columns = np.ascontiguousarray(grid.T)
        entry = np.repeat(self.roots[None, :], len(grid), 0)
        block, lang = (x.ravel() for x in np.indices(entry.shape))
        ended, last = (x.reshape(entry.shape) for x in self.advance(columns, block, entry.ravel(), self.roots[lang]))
        inner = np.setdiff1d(np.arange(len(grid)), starts)
        while True:
            due = entry.copy()
            due[inner] = last[inner - 1]
            block, lang = np.nonzero(due != entry)
            if not len(block):
                break
            entry = due
            ended[block, lang], last[block, lang] = self.advance(columns, block, entry[block, lang], self.roots[lang])
        ends = starts + rows - 1
        ended[ends] += last[ends] != self.roots
        return np.add.reduceat(ended, starts, axis=0)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, margin between the best two entropies in [0, 1]) of each text."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            codes = self.codes(text) if text else np.empty(0, np.int32)
            if (codes >= UNKNOWN).any():
                group.append((i, codes))
                size += len(codes)
            if group and (size >= CHUNK or i == len(texts) - 1):
                entropy = self.phrases([c for _, c in group]) * self.bits
                best = entropy.argmin(axis=1)
                ranked = np.sort(entropy, axis=1)
                margin = 1 - ranked[:, 0] / ranked[:, 1] if len(self.names) > 1 else np.ones(len(group))
                for (k, _), b, m in zip(group, best, margin):
                    out[k] = (self.names[b], float(m))
                group, size = [], 0
        return out


def samples(
    labelled: DataFrame, id: str, text: str, lang: str, rows: int = SAMPLE_ROWS, most: int = SAMPLE_TEXT, chars: int = SAMPLE_CHARS
) -> dict[str, str]:
    """Folded sample per language: at most `rows` rows in the order of a hash, `most` characters of each, then `chars` in all."""
    place = F.pmod(F.xxhash64(F.col(id), F.lit(11)), F.greatest(F.length(text) - most + 1, F.lit(1))).cast("int") + 1
    part = F.substring(F.col(text), place, F.lit(most)).alias("text")
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(id).alias("id"), part)
    usable = usable.withColumn("order", F.xxhash64(F.col("id"), F.lit(7)))
    picked = topk_per_group(usable, ["lang"], [F.col("order"), F.col("id"), F.col("text")], rows, tie="order")
    found: dict[str, list] = {}
    for r in picked.collect():
        found.setdefault(r.lang, []).append((r.order, r.id is None, r.id, fold(r.text)))
    return {k: " ".join(["", *(t for *_, t in sorted(v, key=lambda x: (x[0], x[1], str(x[2]), x[3]))), ""])[:chars] for k, v in found.items()}


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. `bounds`: rows, most and chars of `samples`."""
    kind = docs.schema[id].dataType
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("held_out", held_out("doc_id"))
    model = docs.sparkSession.sparkContext.broadcast(samples(rows.filter(~F.col("held_out")), "doc_id", "text", "lang", **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = per_process(("languages", hash(tuple(sorted(model.value.items())))), lambda: Parser(model.value))
        for b in slices(batches, 2000):
            found = parser.predict(as_text(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, schema)
