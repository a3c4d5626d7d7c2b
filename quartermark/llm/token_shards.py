"""Token shards: raw id payloads with a minimal perfect hash index.

Documents are dealt out by ranges of their key and sorted, so shards follow each other in key order.
A shard file holds, one after the other, the ids of its documents (little-endian unsigned integers,
2 bytes if the vocabulary allows, else 4), the end of each record, the keys, the index and a footer
that says where each part lies. The index is a minimal perfect hash: at each level the keys that
have a bit to themselves stay, the others go on to the next level, and a key's slot is the number of
set bits before its own. A slot stores the key's fingerprint, offset, length, record number and
number of records. A lookup hashes once per level and reads one slot: constant time per key.

A file's name is new for every attempt of a task, and only the names that came back are in the
manifest, so a lost executor leaves files that nobody reads. Null texts are one end id; null keys
come first and are read by scans only; records of equal keys follow each other, and the index has
the first of them and their number. An empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.llm.bpe_codec import byte_symbols
from quartermark.llm.common import as_text, file_system, per_process, shared_folder, slices
from quartermark.session import cut

MAGIC = b"QMTS0001"
#: Words whose ids a Python worker keeps.
CACHE = 700_000
#: Id appended to every document.
END = 1
#: Bits per key on each level of the hash.
SPREAD = 2.0
_NO_KEY = np.iinfo(np.int64).min
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_LATIN = re.compile("[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- encoding ----------------------------------------------------------------------


class WordEncoder:
    """The tokenizers library's encoding of texts, word by word.

    This tokenizer drops white space, so a text's ids are those of its words; words recur and are
    looked up. A plain lower-case word goes to the library's model at once, anything else through
    all of its steps.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.symbols = {b: c for c, b in byte_symbols().items()}
        self.limit, self.known = cache, {"": b""}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: Latin letters, then at most a tail of punctuation, are two pre-tokens."""
        known = self.known
        for word in words:
            head = word.rstrip(_MARKS)
            if not _LATIN.fullmatch(head):
                known[word] = self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
                continue
            ids = self.letters(head.lower())
            if len(head) < len(word):
                tail = word[len(head) :]
                if tail not in known:
                    known[tail] = self.pack(self.tokenizer.encode(tail, add_special_tokens=False).ids)
                ids += known[tail]
            known[word] = ids

    def letters(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin letters, a single pre-token, from the library's model."""
        ids = self.known.get(word)
        if ids is None:
            symbols = word if word.isascii() else "".join(map(self.symbols.__getitem__, word.encode()))
            ids = self.known[word] = self.pack([t.id for t in self.tokenizer.model.tokenize(symbols)])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.limit:
            self.known = {"": b""}
        self.learn(set().union(*split) - self.known.keys())
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


# --- minimal perfect hash -------------------------------------------------------------


def spread(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints(keys: np.ndarray) -> np.ndarray:
    """32-bit fingerprints, independent of the levels' hashes."""
    return (spread(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys as levels of bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            bits = 64 * max(1, int(np.ceil(SPREAD * len(left) / 64)))
            at = (spread(left, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key outside the set gets any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = (spread(keys[open_], level) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out


# --- shard files ------------------------------------------------------------------------


class ShardWriter:
    """Streams records to a file; only keys and record ends stay in memory."""

    def __init__(self, stream: Any, width: int):
        self.stream, self.width, self.at, self.ids = stream, width, 0, 0
        self.keys: list[int] = []
        self.ends: list[int] = []
        self.parts: dict[str, list] = {}
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _part(self, name: str, data: np.ndarray) -> None:
        self.parts[name] = [self.at, len(data), data.dtype.str]
        self._put(data.tobytes())

    def add(self, key: int | None, ids: bytes) -> None:
        self._put(ids)
        self.ids += len(ids) // self.width
        self.ends.append(self.ids)
        self.keys.append(_NO_KEY if key is None else key)

    def close(self) -> None:
        keys, ends = np.array(self.keys, np.int64), np.array(self.ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        own, first, count = np.unique(keys, return_index=True, return_counts=True)
        if len(own) and own[0] == _NO_KEY:
            own, first, count = own[1:], first[1:], count[1:]
        hash_ = PerfectHash.build(own)
        to = hash_.slots(own)
        slot = lambda values, kind: self._scatter(to, values, kind)
        self._part("ends", ends.astype("<i8"))
        self._part("keys", keys.astype("<i8"))
        for i, words in enumerate(hash_.levels):
            self._part(f"level{i}", words)
        self._part("print", slot(prints(own), "<u4"))
        self._part("offset", slot(starts[first], "<i8"))
        self._part("length", slot((ends - starts)[first], "<u4"))
        self._part("record", slot(first, "<u4"))
        self._part("records", slot(count, "<u4"))
        footer = json.dumps({"width": self.width, "levels": len(hash_.levels), "parts": self.parts}).encode()
        self._put(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.stream.close()

    @staticmethod
    def _scatter(to: np.ndarray, values: np.ndarray, kind: str) -> np.ndarray:
        out = np.zeros(len(to), kind)
        out[to] = values
        return out


class ShardReader:
    """Opens a shard by its footer; keyed access reads the index and then only the records asked for."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(min(size, 1 << 16), max(0, size - (1 << 16)))
        if tail[-8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        (n,) = struct.unpack("<I", tail[-12:-8])
        footer = json.loads(tail[-12 - n : -12])
        self.width, self.parts = footer["width"], footer["parts"]
        self.hash = PerfectHash([self.part(f"level{i}") for i in range(footer["levels"])])

    def part(self, name: str) -> np.ndarray:
        at, n, kind = self.parts[name]
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of the first record of each key."""
        if not self.hash.size:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slots = self.hash.slots(keys)
        found = (slots >= 0) & (self.values("print", slots) == prints(keys))
        return found, self.values("offset", slots), self.values("length", slots).astype(np.int64)

    def values(self, name: str, slots: np.ndarray) -> np.ndarray:
        """Entries at `slots`; few are read where they lie, so one lookup does not depend on the shard's size."""
        at, n, kind = self.parts[name]
        if len(slots) * 512 >= n:
            return self.part(name)[slots]
        width = np.dtype(kind).itemsize
        return np.frombuffer(b"".join(self.file.read_at(width, at + (s % n) * width) for s in slots.tolist()), kind)

    def ids(self, offset: int, length: int) -> bytes:
        """Ids of one record as little-endian unsigned 32-bit integers."""
        return self.widen(self.file.read_at(length * self.width, len(MAGIC) + offset * self.width))

    def widen(self, raw: bytes) -> bytes:
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()

    def scan(self, block: int = 1 << 22) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
        """(keys, offsets, ids) of runs of records, payload read in blocks; the index gives each key's place."""
        keys, ends = self.part("keys"), self.part("ends")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        held = keys != _NO_KEY
        found, offset, length = self.find(keys[held])
        first = np.concatenate([[True], keys[1:] != keys[:-1]])[held] if len(keys) else held
        if not (found.all() and (offset == starts[held])[first].all() and (length == (ends - starts)[held])[first].all()):
            raise ValueError("the index does not match the payload")
        a = 0
        while a < len(keys):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + block, "right")))
            raw = memoryview(self.file.read_at(int(ends[b - 1] - starts[a]) * self.width, len(MAGIC) + int(starts[a]) * self.width))
            at = (np.concatenate([[starts[a]], ends[a:b]]) - starts[a]) * self.width
            ids = [self.widen(raw[x:y]) if self.width != 4 else bytes(raw[x:y]) for x, y in zip(at, at[1:])]
            yield [None if k == _NO_KEY else k for k in keys[a:b].tolist()], starts[a:b], ids
            a = b


# --- operator ---------------------------------------------------------------------------


def write(docs: DataFrame, folder: str | None = None, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and write `docs`; the manifest: shard, path, records, ids, start (ids of all shards before), low, high."""
    spark = docs.sparkSession
    to, file = folder or shared_folder(spark, "token-shards"), path or default_path()
    spark._jvm.org.apache.hadoop.fs.Path(to).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = per_process(("words", file), lambda: WordEncoder(file))
        end, out, name = tool.pack([END]), None, f"{to}/{uuid.uuid4().hex}.tokens"
        for part in slices(batches, 2000):
            out = out or ShardWriter(file_system(to)[0].open_output_stream(file_system(name)[1]), tool.width)
            for key, ids in zip(part.column(0).to_pylist(), tool.encode(as_text(part.column(1)))):
                out.add(key, ids + end)
        if out:
            out.close()
            held = [k for k in out.keys if k != _NO_KEY] or [None]
            row = {"shard": TaskContext.get().partitionId(), "path": name, "records": len(out.keys), "ids": out.ids, "low": held[0], "high": held[-1]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    rows = docs.select(F.col(id).cast("long").alias("key"), F.col(text).alias("text"))
    # The text's hash splits rows of one id, null included, over ranges.
    ordered = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered, "text")
    done = cut(dealt.mapInArrow(run, "shard int, path string, records long, ids long, low long, high long"))
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return done.withColumn("start", F.coalesce(before, F.lit(0)))


def scan(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for keys, offsets, ids in ShardReader(path).scan():
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(offsets + start, pa.int64()), counts, pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    # Names are few bytes, so a number is given: AQE would read every file in one task.
    shards = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fetch(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: doc_id, ids of the first record of every key of `keys` that the shards hold.

    A key goes to the first shard whose range has it (the manifest has one row per file and is all the
    driver sees), and there to its slot.
    """
    shards = [(r.high, r.path) for r in manifest.filter("low is not null").orderBy("shard").select("high", "path").collect()]
    highs, paths = np.array([x for x, _ in shards], np.int64), [p for _, p in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([k for k in b.column(0).to_pylist() if k is not None], np.int64)
            at = np.searchsorted(highs, own)
            held = at < len(paths)
            yield pa.RecordBatch.from_arrays([pa.array(own[held]), pa.array(at[held].astype(np.int32))], ["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[int, ShardReader] = {}
        for b in batches:
            own, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in np.unique(at).tolist():
                reader = readers.get(s) or readers.setdefault(s, ShardReader(paths[s]))
                found, offset, length = reader.find(own[at == s])
                rows = [(k, reader.ids(int(o), int(n))) for k, f, o, n in zip(own[at == s].tolist(), found, offset, length) if f]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["doc_id", "ids"])

    routed = keys.select(F.col(key).cast("long").alias("key")).mapInArrow(route, "key long, shard int")
    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(read, "doc_id long, ids binary")


def written_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, as read back from the shards."""
    return scan(write(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
