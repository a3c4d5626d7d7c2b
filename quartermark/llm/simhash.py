"""Near duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of a text's word shingles. Each
distinct fingerprint gets a row of the pivot table: its Hamming distances to many reference
fingerprints, every reference covering one segment of the bits. A distance changes by at most the
number of differing bits, so a pair whose coordinates differ by more than the radius anywhere is
discarded, and survivors are verified on the fingerprints themselves.

`linked` is exact. With radius + 2 segments, two fingerprints within the radius agree on at least two
segments, hence in all coordinates of these; rows meet on the coordinates of each pair of segments.
Pairs are formed only inside small meetings. In larger ones a fingerprint instead meets others on its
one-bit variants (of the bits outside the agreeing segments): two fingerprints within two bits share
such a variant, and a variant has at most one fingerprint per such bit, so the work stays in
proportion to the rows however many near copies meet.

`similar` serves similarities where many bits differ, on the sets of shingles themselves. Rows meet on
the first shingles of their sets in one order of all, the common ones last: so many that two sets of the
similarity share at least one. A sample tells which are common, then a count of the keys of all rows. Only
these keys are written; sets that pairs name are made again from the texts. Of meetings of the same sets
one is kept. Each row of a meeting is compared with a few leaders first, those with the fewest shingles
that are rarer than the key: near copies of one text are nearest to these. Then rows that are not connected
to the first leader are compared with all rows of the meeting that they are not connected to, unless sizes
and places rule the pair out. A pair that shares one of the last keys before is left to its earlier
meeting. Every link is confirmed on the sets, so the result is exact.

Texts without words have fingerprint zero and link like any other. Copies of a fingerprint are one
row of the table. Null ids take part in links but are never a component's id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.llm.common import as_bytes, salted_left, slices
from quartermark.plans.graph import components
from quartermark.session import cut, discard

SEED = 42
#: Bits in which linked 64-bit fingerprints differ at most; one-bit variants find exactly these.
RADIUS = 2
#: References per segment of the pivot table.
REFERENCES = 12
#: Largest meeting in which pairs are formed.
MEETING = 32
#: Rows of the sample that tells common shingles from rare ones, the hash buckets it counts in, and the least count that is kept.
SAMPLE, BUCKETS, COMMON = 20_000, 1 << 22, 4
#: Least count of a key over all rows that makes it common, and how many of these the order takes at most (the commonest).
COMMON_KEY, COMMON_KEYS = 8, 1 << 20
#: Rows of a meeting that all others are compared with before pairs are formed.
LEADERS = 8
#: Keys before that of a meeting by which a pair is told to have met.
BEFORE = 8

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of `width` words (A-Z folded, space-joined), or of all words if there are fewer."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    spans = zip(starts, ends[width - 1 :])
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(raw: bytes, width: int) -> bytes:
    """Big-endian fingerprint of 64 bits: the majority of the hashes."""
    hashes = shingle_hashes(raw, width)
    if not len(hashes):
        return bytes(8)
    columns = np.arange(8, dtype=np.int64) * 256
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + columns).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits(2 * (seen @ _BITS) > len(hashes), bitorder="little")[::-1].tobytes()


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (binary) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = [fingerprint(x, width) for x in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id]}, fp binary")


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints of a batch as rows of big-endian bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def pivot_table(prints: np.ndarray, segments: int) -> np.ndarray:
    """Hamming distances of 64-bit fingerprints to the references: (rows, segments, REFERENCES)."""
    values = prints.copy().view(">u8").astype(np.uint64)[:, 0]
    cuts = [64 * i // segments for i in range(segments + 1)]
    table = np.empty((len(values), segments, REFERENCES), np.uint8)
    for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        mask = np.uint64(((1 << (hi - lo)) - 1) << lo)
        for r in range(REFERENCES):
            reference = np.uint64(xxhash.xxh64_intdigest(f"reference {r}".encode(), s))
            table[:, s, r] = np.bitwise_count((values ^ reference) & mask)
    return table


def _located(prints: DataFrame) -> DataFrame:
    """fp, row of the pivot table, and a key per pair of segments: equal coordinates, equal key."""
    segments = RADIUS + 2
    pairs = list(combinations(range(segments), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            table = pivot_table(_words(b.column(0)), segments)
            code = np.zeros((segments, len(table)), np.uint64)
            for s in range(segments):
                for r in range(REFERENCES):
                    code[s] = mix(code[s] * np.uint64(31) + table[:, s, r].astype(np.uint64) + np.uint64(1))
            keys = [mix(code[i] + mix(code[j])).view(np.int64) for i, j in pairs]
            rows = pa.array([t.tobytes() for t in table], pa.binary())
            for k, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(np.full(len(key), k, np.int32)), pa.array(key)], ["fp", "pivots", "pair", "key"])

    return prints.select("fp").mapInArrow(run, "fp binary, pivots binary, pair int, key long")


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (src, src_pivots, dst, dst_pivots) that pass the coordinate bound and then the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p, q = (_words(b.column(i)).astype(np.int16) for i in (1, 3))
            b = b.select(["src", "dst"]).filter(pa.array(np.abs(p - q).max(axis=1) <= RADIUS))
            if b.num_rows:
                apart = np.bitwise_count(_words(b.column(0)) ^ _words(b.column(1))).sum(axis=1)
                yield b.filter(pa.array(apart <= RADIUS))

    return pairs.select("src", "src_pivots", "dst", "dst_pivots").mapInArrow(run, "src binary, dst binary")


def _variants(met: DataFrame) -> DataFrame:
    """fp and each of its one-bit variants outside the two agreeing segments, itself included."""
    segments = RADIUS + 2
    pairs = list(combinations(range(segments), 2))
    cuts = [64 * i // segments for i in range(segments + 1)]
    free = [[x for s in range(segments) if s not in p for x in range(cuts[s], cuts[s + 1])] for p in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in sorted(set(b.column(1).to_pylist())):
                own = b.filter(pa.array([x == k for x in b.column(1).to_pylist()]))
                values = _words(own.column(0)).copy().view(">u8").astype(np.uint64)[:, 0]
                flips = np.array([0] + [1 << x for x in free[k]], np.uint64)
                variants = (values[:, None] ^ flips).ravel().view(np.int64)
                at = pa.array(np.repeat(np.arange(own.num_rows), len(flips)))
                yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.array(variants)], ["fp", "pair", "variant"])

    return met.select("fp", "pair").mapInArrow(run, "fp binary, pair int, variant long")


def linked(prints: DataFrame, meeting: int = MEETING) -> DataFrame:
    """Links (src, dst) that connect exactly the distinct 64-bit fingerprints within RADIUS bits."""
    located = _located(prints)
    sizes = located.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = cut(located.join(sizes, ["pair", "key"]))
    small = met.filter(F.col("size") <= meeting)
    left = small.select("pair", "key", F.col("fp").alias("src"), F.col("pivots").alias("src_pivots"))
    right = small.select("pair", "key", F.col("fp").alias("dst"), F.col("pivots").alias("dst_pivots"))
    near = _verified(left.join(right, ["pair", "key"]).filter(F.col("src") < F.col("dst")))
    shared = _variants(met.filter(F.col("size") > meeting)).groupBy("pair", "variant").agg(F.collect_set("fp").alias("fps"))
    crowd = shared.filter(F.size("fps") > 1).select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).filter("src <> dst")
    return near.unionByName(crowd).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, meeting: int = MEETING) -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id: the smallest id its links reach, its own included."""
    prints = cut(fingerprints(docs, id, text, width))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    found = components(linked(classes, meeting))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named)
    least = named.filter(F.col("component") != F.col("fp")).select("component").distinct().join(named, "component").groupBy("component").agg(F.min("first").alias("least"))
    several = named.join(least, "component", "left").filter((F.col("rows") > 1) | F.col("least").isNotNull())
    several = several.select("fp", F.coalesce("least", "first").alias("component_id"))
    joined = salted_left(prints, several.withColumn("__hit", F.lit(True)), "fp", "doc_id")
    return joined.select(
        "doc_id",
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.when(F.col("__hit").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


# --- similarity of shingle sets ---------------------------------------------------


def _set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    return np.unique(shingle_hashes(raw, width))


def _node(shingles: np.ndarray) -> int:
    """Name of a set, as a signed 64-bit hash."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def _level(counts: np.ndarray) -> np.ndarray:
    """Twice the base-2 logarithm of counts, as bytes."""
    return (2 * np.log2(counts)).astype(np.uint8)


def _levels(docs: DataFrame, text: str, width: int, sample: int) -> np.ndarray:
    """Level of the shingles of each hash bucket, by how often they occur in about `sample` rows; counts stand for all rows."""
    rows = docs.count()
    if rows > sample:
        docs = docs.sample(sample / rows, seed=SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            for x in as_bytes(b.column(0)):
                np.add.at(seen, (_set(x, width) % np.uint64(BUCKETS)).view(np.int64), 1)
        cells = np.flatnonzero(seen)
        for at in range(0, len(cells), 1 << 16):
            part = cells[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part])], ["cell", "n"])

    found = docs.select(text).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = found.filter(F.col("n") >= COMMON).select("cell", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[found.column("cell").to_numpy()] = _level(found.column("n").to_numpy() * max(1, rows / sample))
    return levels


def _prefix(own: np.ndarray, order: tuple[bytes, bytes, bytes], similarity: float) -> np.ndarray:
    """The shingles of a set that come first in the order: sets of at least that similarity share one."""
    buckets, keys, key_levels = (np.frombuffer(x, t) for x, t in zip(order, (np.uint8, np.uint64, np.uint8)))
    level = buckets[(own % np.uint64(BUCKETS)).view(np.int64)]
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        level = np.where(keys[at] == own, np.maximum(level, key_levels[at]), level)
    return own[np.argsort(level, kind="stable")[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]]


def _order(docs: DataFrame, text: str, width: int, similarity: float, sample: int) -> tuple[bytes, bytes, bytes]:
    """Levels of hash buckets, then sorted keys with levels of their own: the order that `_prefix` follows.

    A sample of a bounded size misses what is rare in it but common in many rows. So the first shingles in
    the sample's order are counted over all rows, and those that are common there come later as well.
    """
    buckets = _levels(docs, text, width, sample).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast((buckets, b"", b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [_prefix(_set(x, width), shared.value, similarity) for x in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], ["key"])

    counts = docs.select(text).mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    common, least = cut(counts.filter(F.col("n") >= COMMON_KEY)), COMMON_KEY
    while common.filter(F.col("n") >= least).count() > COMMON_KEYS:
        least *= 2
    found = common.filter(F.col("n") >= least).toArrow()
    discard(common)
    keys = found.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    return buckets, keys[by].tobytes(), _level(found.column("n").to_numpy()[by]).tobytes()


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, sample: int = SAMPLE) -> DataFrame:
    """doc_id, digest (of the text), node (of its shingle set), size (of the set), keys of every row; null texts count as empty.

    Keys are the shingles that come first in one order of all: sets of at least that similarity share
    one. Common shingles come last; that only saves work, any order finds the same pairs.
    """
    order = docs.sparkSession.sparkContext.broadcast(_order(docs, text, width, similarity, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes, sizes, keys = [], [], []
            for x in as_bytes(b.column(2)):
                own = _set(x, width)
                nodes.append(_node(own))
                sizes.append(len(own))
                keys.append(_prefix(own, order.value, similarity).tobytes())
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "node", "size", "keys"])

    named = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id]}, digest long, node long, size int, keys binary")


def _meetings(rows: DataFrame) -> DataFrame:
    """key, node, size, place: the keys that several sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            places = np.concatenate([np.arange(len(x), dtype=np.int32) for x in keys])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(places), pa.array(np.concatenate(keys))], ["node", "size", "place", "key"])

    each = rows.select("node", "size", "keys").dropDuplicates(["node"]).mapInArrow(run, "node long, size int, place int, key long")
    beside = W.partitionBy("key").orderBy("node")
    shared = F.lag("node").over(beside).isNotNull() | F.lead("node").over(beside).isNotNull()
    return each.withColumn("shared", shared).filter("shared").drop("shared")


def _distinct_meetings(met: DataFrame) -> DataFrame:
    """Of the meetings of the same sets, the one whose key comes first in the order of keys.

    Near copies share most of their keys, so most meetings only repeat others. The first key has the
    least place in every member, so no pair that may be similar is ruled out by going without the rest.
    """
    name = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    members = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), name(0).alias("x"), name(1).alias("y"), F.sum("place").alias("places"))
    first = members.groupBy("n", "x", "y").agg(F.min_by("key", "places").alias("key")).select("key")
    return met.join(first, "key", "left_semi")


def _with_before(met: DataFrame) -> DataFrame:
    """Meetings with `before`: the keys of the last meetings of the same set that come earlier in the order."""
    return met.withColumn("before", F.collect_list("key").over(W.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1)))


def _possible(similarity: float) -> Column:
    """Whether sets a and b may first meet at this key and can share enough: no more than what comes from there on.

    A pair that shares a key before has met there, and is judged there.
    """
    rest = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    enough = rest * (1 + similarity) >= similarity * (F.col("a.size") + F.col("b.size")) - 1e-6
    return enough & ~F.arrays_overlap("a.before", "b.before")


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct (src, dst) of joined rows a and b."""
    return met.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct()


def _sets(rows: DataFrame, docs: DataFrame, text: str, width: int, nodes: DataFrame) -> DataFrame:
    """node, shingles of the wanted nodes, made again from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [_set(x, width) for x in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    wanted = cut(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("wanted")).select("wanted").distinct())
    texts = docs.select(F.col(text).alias("text")).join(wanted, F.xxhash64("text") == F.col("wanted"), "left_semi")
    return texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes whose shingle sets have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    for side in ("src", "dst"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set")), side)
    return pairs.select("src", "dst", "src_set", "dst_set").mapInArrow(run, "src long, dst long")


def similar(rows: DataFrame, docs: DataFrame, text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, component) of the nodes with similar others; `rows` are the signatures of `docs`."""
    row, near = F.struct("node", "size", "place", "before"), _possible(similarity)
    every = cut(_meetings(rows))
    met = cut(_with_before(_distinct_meetings(every)), replaces=every)
    central = ["place", F.xxhash64("node"), "node"]
    leaders = met.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*central))).filter(F.col("rank") <= LEADERS)
    led = met.select("key", row.alias("a")).join(leaders.select("key", row.alias("b")), "key")
    first = cut(_pairs(led.filter(F.col("a.node") != F.col("b.node")).filter(near)))
    ends = lambda pairs: pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    sets = cut(_sets(rows, docs, text, width, ends(first)))
    links = cut(_confirmed(first, sets, similarity))
    named = met.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    heads = F.min_by("label", F.struct(*central))
    open_ = named.groupBy("key").agg(heads.alias("led"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "led")
    again = cut(named.join(open_, "key"), replaces=met)
    left = again.filter(F.col("label") != F.col("led")).alias("a")
    once = (F.col("b.label") == F.col("b.led")) | (F.col("a.node") < F.col("b.node"))
    apart = left.join(again.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & once & near)
    rest = cut(_pairs(apart).join(first, ["src", "dst"], "left_anti"), replaces=again)
    new = ends(rest).join(sets.select("node"), "node", "left_anti")
    more = cut(sets.unionByName(_sets(rows, docs, text, width, new)), replaces=sets)
    further = cut(_confirmed(rest, more, similarity))
    out = cut(components(links.unionByName(further)))
    discard(first, rest, more, links, further)
    return out


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, sample: int = SAMPLE) -> DataFrame:
    """Rows of `docs`, all columns, but those that are similar to a row with a smaller id, directly or in steps.

    Rows with a null id stay. Rows that share both id and text stay or go together; rows that share only the
    id are judged each by its text. Columns of `docs` may have any names.
    """
    rows = cut(signatures(docs, id, text, width, similarity, sample))
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    found = similar(rows, docs, text, width, similarity)
    named = cut(classes.join(found, "node", "left"))
    least = named.filter("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    several = named.join(least, "component", "left").filter((F.col("rows") > 1) | F.col("least").isNotNull())
    several = several.select("node", F.coalesce("least", "first").alias("least"))
    lost = salted_left(rows.select("doc_id", "digest", "node"), several, "node", "doc_id").filter(F.col("doc_id") > F.col("least"))
    mark = "lost_" + uuid.uuid4().hex
    lost = cut(lost.select(F.col("doc_id").alias(f"{mark}_id"), F.col("digest").alias(f"{mark}_digest")).distinct())
    discard(rows, found, named)
    return docs.join(lost, (docs[id] == F.col(f"{mark}_id")) & (F.xxhash64(docs[text]) == F.col(f"{mark}_digest")), "left_anti")
