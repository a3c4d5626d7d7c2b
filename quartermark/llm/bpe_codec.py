"""BPE encoding and decoding with a public byte-level tokenizer.

Texts are encoded whole by a byte-pair encoder that takes its ranks from the tokenizer's file. Its
time grows with the square of a pre-token's length, so long unsplit text (a run of over LEAF
characters without a break) goes another way, tree concatenation: halves of halves are encoded in
parallel, and around each join a window of a few tokens from either side is encoded again; it grows
until its first token is the left side's and its last token the right side's. In byte-pair encoding a
token sequence is the encoding of its text exactly if every two neighbours are, so such a join equals
the encoding of the whole.

Strings of special tokens in a text become their ids, as the tokenizers library does by default. Null
counts as empty and gives no ids. Ids are stored as little-endian unsigned 32-bit integers. Rows are
encoded where they lie: nothing is shuffled, repeated rows and extra columns make no difference.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.llm.common import as_text, per_process, slices

#: Longest pre-token in characters that is encoded in one go.
LEAF = 64
#: Tokens taken from either side of a join at first.
WINDOW = 4
#: White space (the Unicode property) and the split pattern of byte-level vocabularies: fixed values.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts that pre-tokens never cross: a space belongs to what follows, other white space stands alone.
_PIECES = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken

        self.path, self.leaf = path, leaf
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = specials
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        table = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in specials}
        self.ranks = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={t: i for i, t in table.items()}, special_tokens={})
        table |= {i: s.encode() for s, i in specials.items()}
        size = max(table) + 1
        self.lengths = np.array([len(table.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.unsplit = re.compile(f"[^{_WS}]{{{leaf + 1}}}|[{_WS}]{{{leaf + 1}}}")

    @cached_property
    def tokenizer(self) -> Any:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    # --- encoding ---

    def part(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if not self.unsplit.search(text):
            return self.ranks.encode_ordinary(text)
        out: list[int] = []
        for piece in _PIECES.findall(text):
            if len(piece) <= self.leaf:
                out += self.ranks.encode_ordinary(piece)
                continue
            for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
                out += self.tree(piece[a:b])
        return out

    def tree(self, run: str) -> list[int]:
        """Ids of one pre-token, its leaves encoded in parallel and joined upwards."""
        plan = self.halves(0, len(run))
        leaves = [run[a:b] for a, b in self.spans(plan)]
        encode = self.ranks.encode_ordinary_batch if len(leaves) > 64 else lambda x: list(map(self.ranks.encode_ordinary, x))
        return self.grow(run, plan, iter(encode(leaves)))

    def halves(self, a: int, b: int) -> Any:
        """Binary tree of (start, middle, end) over a run; leaves are (start, end)."""
        if b - a <= self.leaf:
            return (a, b)
        m = (a + b) // 2
        return (self.halves(a, m), m, self.halves(m, b))

    def spans(self, plan: Any) -> Iterator[tuple[int, int]]:
        if len(plan) == 2:
            yield plan
        else:
            yield from self.spans(plan[0])
            yield from self.spans(plan[2])

    def grow(self, run: str, plan: Any, ids: Iterator[list[int]]) -> list[int]:
        if len(plan) == 2:
            return next(ids)
        left = self.grow(run, plan[0], ids)
        return self.join(run, plan[1], left, self.grow(run, plan[2], ids))

    def join(self, run: str, cut: int, left: list[int], right: list[int]) -> list[int]:
        """Encoding of left's text followed by right's, which meet at character `cut` of the run."""
        k = WINDOW
        while True:
            a, before = self.reach(reversed(left), k, run, cut, -1)
            b, after = self.reach(right, k, run, cut, 1)
            w = self.ranks.encode_ordinary(run[cut - before : cut + after])
            if (a == len(left) or w[0] == left[-a]) and (b == len(right) or w[-1] == right[b - 1]):
                return left[: len(left) - a] + w + right[b:]
            k *= 2

    def reach(self, ids: Iterable[int], least: int, run: str, cut: int, way: int) -> tuple[int, int]:
        """(tokens, characters) from the cut: `least` tokens, and on to where a token ends with a character."""
        tokens = size = chars = passed = 0
        for i in ids:
            tokens += 1
            size += int(self.lengths[i])
            while passed < size:
                passed += len(run[cut + chars if way > 0 else cut - chars - 1].encode())
                chars += 1
            if tokens >= least and passed == size:
                break
        return tokens, chars

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(mark in text for mark in self.special):
            return np.array(self.part(text), "<u4").tobytes()
        ids = [([self.special[x]] if i % 2 else self.part(x)) for i, x in enumerate(self.marks.split(text))]
        return np.array([i for part in ids for i in part], "<u4").tobytes()

    # --- decoding ---

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        tokens = np.frombuffer(ids, "<u4")
        if not len(tokens):
            return ""
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[tokens] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.flat[at].tobytes().decode("utf-8", "replace")


def codec(path: str, leaf: int = LEAF) -> Codec:
    return per_process(("bpe", path, leaf), lambda: Codec(path, leaf))


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (binary), n_tokens of every row."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(file, leaf)
        for part in slices(batches):
            ids = [tool.encode(t) for t in as_text(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id]}, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of `encode` with the decoded text."""
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(file)
        for b in slices(batches):
            texts = [tool.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, decoded string")


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of every row, decoded again from its ids.

    Both ways run in one Python worker: the ids are not sent out and back in between.
    """
    file = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(file)
        for b in slices(batches):
            ids = [tool.encode(t) for t in as_text(b.column(1))]
            out = [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(tool.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    both = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id]}, ids binary, n_tokens long, decoded string")
    return both.select("doc_id", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
