"""Exact deduplication by Patricia-trie owners.

Normalised texts (A-Z folded, nothing else) are dealt out by (length, content hash). Each partition
inserts the full byte strings into one compressed radix trie; the node where a text ends stores the
owner among the rows that carry it and their number. A trie that outgrows its byte budget writes its
heaviest subtree to a local file of the task, later texts of that subtree follow it there, and each
file becomes a trie of its own in the end.

Copies meet early: every COMBINED rows are reduced to their distinct texts before the shuffle, so a
group that holds a third of all rows reaches its partition as one row per slice.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.llm.common import as_bytes, salted_left, slices

#: Bytes of labels and rows a trie holds before it writes a subtree to disk.
TRIE_BYTES = 64 << 20
#: Rows whose copies are put together before the shuffle.
COMBINED = 2500


class Node:
    __slots__ = ("label", "below", "best", "count", "row", "file")

    def __init__(self, label: bytes):
        self.label, self.below, self.best, self.count, self.row, self.file = label, {}, None, 0, None, None


def records(file: Any) -> Iterator[tuple]:
    """What was pickled to a subtree's file; the file is gone afterwards."""
    with file:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def shared(a: bytes, b: bytes, at: int) -> int:
    """Bytes that `a` and `b[at:]` have in common."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Radix trie over byte strings; a text's last node holds its owner's rank, row and the row count."""

    def __init__(self, budget: int = TRIE_BYTES, largest: bool = True):
        self.root, self.budget, self.largest, self.held, self.ends = Node(b""), budget, largest, 0, 0

    def insert(self, key: bytes, rank: Any, count: int, row: Any = None, size: int = 0) -> None:
        """`rank` orders rows of equal text and says who owns it; `size` is the row's own bytes."""
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key[at:], rank, count, row, size), node.file, pickle.HIGHEST_PROTOCOL)
                return
            if at == len(key):
                break
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:])
                self.held += len(child.label)
                node = child
                break
            if not key.startswith(child.label, at):
                k = shared(child.label, key, at)
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.below[child.label[0]] = child
                node.below[key[at]] = child = upper
            at += len(child.label)
            node = child
        if not node.count:
            self.ends += 1
        if node.best is None or _wins(rank, node.best, self.largest):
            node.best, node.row = rank, row
            self.held += size
        node.count += count
        if self.held > self.budget and self.ends > 1:
            self.spill()

    @staticmethod
    def weigh(top: Node) -> dict[int, int]:
        """Bytes at and below each node, by identity, without recursion."""
        order, todo = [], [top]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node.below.values())
        weight: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = len(node.label) + sum(weight[id(x)] for x in node.below.values())
        return weight

    def spill(self) -> None:
        """Write the heaviest subtree that is not most of the trie to a file."""
        weight, node = self.weigh(self.root), self.root
        while True:
            node = max(node.below.values(), key=lambda x: weight[id(x)])
            if not node.below or 2 * weight[id(node)] <= weight[id(self.root)]:
                break
        file = tempfile.TemporaryFile()
        for key, x in self.walk(node, b""):
            key = key[len(node.label) :]
            if x.file is None:
                pickle.dump((key, x.best, x.count, x.row, 0), file, pickle.HIGHEST_PROTOCOL)
                self.ends -= 1
                continue
            for rest, *entry in records(x.file):  # a subtree of this one that went out before
                pickle.dump((key + rest, *entry), file, pickle.HIGHEST_PROTOCOL)
        node.below, node.best, node.count, node.row, node.file = {}, None, 0, None, file
        self.held = sum(len(x.label) for _, x in self.every(self.root)) + len(node.label)

    @staticmethod
    def every(top: Node) -> Iterator[tuple[int, Node]]:
        todo = [top]
        while todo:
            node = todo.pop()
            todo.extend(node.below.values())
            yield id(node), node

    @staticmethod
    def walk(top: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """(key, node) of the nodes where texts end or that went to a file."""
        todo = [(prefix + top.label, top)]
        while todo:
            key, node = todo.pop()
            if node.count or node.file is not None:
                yield key, node
            todo.extend((key + x.label, x) for x in node.below.values())

    def owners(self, prefix: bytes = b"") -> Iterator[tuple[bytes, Any, int, Any]]:
        """(text, owner's rank, rows, owner's row) of every text."""
        for key, node in self.walk(self.root, prefix):
            if node.file is None:
                yield key, node.best, node.count, node.row
                continue
            lower = Trie(self.budget, self.largest)
            for entry in records(node.file):
                lower.insert(*entry)
            yield from lower.owners(key)


def _rank(id: Any, largest: bool) -> tuple:
    """Sort key of an id; a null id never wins against another."""
    return ((id is not None) if largest else (id is None), id)


def _wins(a: tuple, b: tuple, largest: bool) -> bool:
    return a > b if largest else a < b


def _dealt(docs: DataFrame, id_at: int, text_at: int, largest: bool, rows: bool) -> DataFrame:
    """Distinct texts of each slice with their owner there, dealt out by length and content hash.

    With `rows` the owner's whole row goes along instead of the folded text, which it implies.
    """
    names = [f"c{i}" for i in range(len(docs.columns))] if rows else ["__key", "__id"]
    kinds = [f.dataType for f in docs.schema] if rows else [T.BinaryType(), docs.schema[id_at].dataType]
    head = ["__length", "__hash", "__count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, COMBINED):
            ids, found = b.column(id_at).to_pylist(), {}
            for i, raw in enumerate(as_bytes(b.column(text_at))):
                key = raw.lower()
                slot = found.get(key)
                if slot is None:
                    found[key] = [i, 1]
                else:
                    slot[1] += 1
                    if _wins(_rank(ids[i], largest), _rank(ids[slot[0]], largest), largest):
                        slot[0] = i
            at = pa.array([s[0] for s in found.values()], pa.int64())
            hashes = [xxhash.xxh64_intdigest(k) - (1 << 63) for k in found]
            out = [
                pa.array([len(k) for k in found], pa.int64()),
                pa.array(hashes, pa.int64()),
                pa.array([s[1] for s in found.values()], pa.int64()),
            ]
            out += [c.take(at) for c in b.columns] if rows else [pa.array(list(found), pa.binary()), b.column(id_at).take(at)]
            yield pa.RecordBatch.from_arrays(out, head + names)

    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in head), *map(T.StructField, names, kinds)])
    return docs.mapInArrow(run, schema).repartition("__length", "__hash")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", largest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: sha256 (binary), keep_id, group_size."""
    dealt = _dealt(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), 0, 1, largest, rows=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(budget, largest)
        kind = None
        for b in slices(batches):
            kind = b.schema.field("__id").type
            for key, i, n in zip(b.column("__key").to_pylist(), b.column("__id").to_pylist(), b.column("__count").to_pylist()):
                trie.insert(key, _rank(i, largest), n, i)
        found = ((hashlib.sha256(key).digest(), i, n) for key, _, n, i in trie.owners())
        while out := list(islice(found, 10_000)):
            sha, ids, counts = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(ids, kind), pa.array(counts, pa.int64())], ["sha256", "keep_id", "group_size"])

    return dealt.mapInArrow(run, f"sha256 binary, keep_id {dict(docs.dtypes)[id]}, group_size long")


def owners(docs: DataFrame, id: str = "doc_id", text: str = "text", largest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Null texts count as empty. Null ids own a text only if no other row has it; repeated rows of the
    owner's id all count as kept. Only texts with several rows are looked up, in salted parts.
    """
    kind = dict(docs.dtypes)[id]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sha = [hashlib.sha256(x.lower()).digest() for x in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary())], ["doc_id", "sha256"])

    keyed = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(digest, f"doc_id {kind}, sha256 binary")
    copies = groups(docs, id, text, largest, budget).filter("group_size > 1")
    joined = salted_left(keyed, copies, "sha256", "doc_id")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id: str = "doc_id", text: str = "text", largest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One whole row of `docs` per distinct text: the owner's, carried through the trie with its key."""
    id_at, text_at, width = docs.columns.index(id), docs.columns.index(text), len(docs.columns)
    dealt = _dealt(docs, id_at, text_at, largest, rows=True)
    kept = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = Trie(budget, largest), None
        for b in slices(batches):
            rows = pa.RecordBatch.from_arrays(b.columns[3:], [f"c{i}" for i in range(width)])
            schema = rows.schema
            values = zip(*[c.to_pylist() for c in rows.columns])
            for raw, n, row in zip(as_bytes(rows.column(text_at)), b.column("__count").to_pylist(), values):
                trie.insert(raw.lower(), _rank(row[id_at], largest), n, row, len(raw))
        out: list[tuple] = []
        size = 0
        for key, _, _, row in trie.owners():
            out.append(row)
            size += len(key)
            if size > 8 << 20:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    return dealt.mapInArrow(run, kept).toDF(*docs.columns)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
