"""Quality rules as a short-circuit cascade.

Each rule names the features it reads. A bounded sample of documents gives every rule's cost (time
to compute the features it still needs) and selectivity (documents it rejects among those that are
left); rules then run in the order of rejections per second, and a document leaves at its first
rejection, so later features are never computed for it. The verdict is a conjunction: it does not
depend on the order, only the work does. Documents are judged one by one where they lie: no shuffle.

Nulls and empty texts have no words and are rejected by `few_words`; null ids, repeated rows and
extra columns pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.llm.common import as_bytes, slices

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER_ASCII, LOWER_ASCII = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Rows that cost and selectivity are estimated on.
SAMPLE_ROWS = 500


class Features:
    """Features of one text, each computed at first use."""

    def __init__(self, raw: bytes, points: int):
        self.raw, self.points = raw, points

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.points - (len(self.raw) - len(self.raw.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more; equal hashes are confirmed on the words."""
        w = self.words
        if len(w) < 4:
            return 0
        h = np.fromiter(map(hash, w), np.int64, len(w)).astype(np.uint64)
        windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[2:] >> np.uint64(1)))
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        at = np.flatnonzero(np.isin(windows, twice)).tolist()
        seen = Counter((w[i], w[i + 1], w[i + 2]) for i in at)
        covered = bytearray(len(w))
        for i in at:
            if seen[w[i], w[i + 1], w[i + 2]] > 1:
                covered[i : i + 3] = b"\1\1\1"
        return sum(covered)

    @cached_property
    def upper_share(self) -> float:
        upper = len(self.raw) - len(self.raw.translate(None, UPPER_ASCII))
        lower = len(self.raw) - len(self.raw.translate(None, LOWER_ASCII))
        return upper / max(1, upper + lower)


Rule = tuple[str, Callable[[Features], bool]]

#: (name, whether the document is rejected). The first two are the base rules.
RULES: list[Rule] = [
    ("few_words", lambda f: f.n_words < 50),
    ("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    ("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
    ("repeated_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    ("capitals", lambda f: f.upper_share > 0.5),
    ("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 16 * f.n_words),
]
BASE = {"few_words", "repeated_words"}


def measure(texts: list[tuple[bytes, int]], rules: list[Rule]) -> list[str]:
    """Names of `rules` by greatest rejections per second on a sample, each step on what earlier ones left."""
    left, todo, order = texts, dict(rules), []
    used: list[str] = []
    while todo:
        best = None
        for name, rejects in todo.items():
            ready = [Features(*t) for t in left]
            for f in ready:  # features that rules before this one have computed already
                for earlier in used:
                    dict(rules)[earlier](f)
            start = time.perf_counter()
            gone = [rejects(f) for f in ready]
            rate = (sum(gone) + 1e-3) / (time.perf_counter() - start + 1e-7)
            if best is None or rate > best[0]:
                best = (rate, name, gone)
        _, name, gone = best
        order.append(name)
        used.append(name)
        del todo[name]
        left = [t for t, g in zip(left, gone) if not g]
    return order


def cascade_order(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Order of the rules for `docs`, measured in one task on at most `sample_rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in _texts(b.column(0))]
        yield pa.RecordBatch.from_pydict({"name": measure(texts, rules)})

    sample = docs.select(F.col(text).alias("text")).limit(sample_rows).coalesce(1)
    names = [r.name for r in sample.mapInArrow(run, "name string").collect()]
    return names or [n for n, _ in rules]


def _texts(column: pa.Array) -> list[tuple[bytes, int]]:
    points = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    return list(zip(as_bytes(column), points))


def ordered(rules: list[Rule], names: list[str]) -> list[Callable[[Features], bool]]:
    by_name = dict(rules)
    return [by_name[n] for n in names]


def passing(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of `docs`, all columns, that no rule rejects."""
    order = cascade_order(docs, text, rules, sample_rows)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = ordered(rules, order)
        for b in slices(batches):
            keep = [not any(step(f) for step in steps) for f in (Features(*t) for t in _texts(b.column(at)))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The statistics are wanted of every row, so the cascade saves only what they do not cover.
    """
    order = cascade_order(docs, text, rules, sample_rows)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, base = ordered(rules, order), [r for n, r in rules if n in BASE]
        for b in slices(batches):
            features = [Features(*t) for t in _texts(b.column(1))]
            kept = [not any(step(f) for step in steps) for f in features]
            failed = [any(r(f) for r in base) for f in features]
            out = [b.column(0), *(pa.array([getattr(f, c) for f in features], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *counts, "base_failed", "kept"])

    schema = f"doc_id {kind}, {', '.join(c + ' long' for c in counts)}, base_failed boolean, kept boolean"
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
