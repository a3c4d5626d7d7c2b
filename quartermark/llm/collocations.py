"""Phrase collocations by a multikey quicksort of suffix pointers.

Every word of a piece starts a suffix of up to `longest` words. Suffixes are routed over the whole
corpus by language and their two leading words, so each group holds all occurrences of its phrases. A
group's suffix pointers are sorted by multikey three-way quicksort: pointers are parted by the word at
the current depth into smaller, equal and larger ones; the size of an equal part is the count of the
phrase up to that depth and the part goes on one word deeper. Parts of fewer than `least` pointers are
abandoned, whatever they would still hold is rarer. Equal suffixes of a batch of texts travel as one
pointer with a weight, and sizes are sums of weights.

A group that is far larger than the others is routed again by three leading words, and what is still
too large is counted where it lies and summed; the sizes of the prefixes that routing splits are summed
over the parts. Single words are summed the same way. So no phrase, however common, meets in one task,
and all counts are exact.

A candidate is a phrase of 2 to `longest` words that occurs at least `least` times. It is cut after its
first k words; its score is floor(scale * a / (l + r)) of the weakest cut, ties to the smallest k, in
exact decimals. A candidate within a longer one that has at least 80 % of its occurrences is dropped: as
counts never grow with length, it is enough to look at phrases one word longer.

Null texts count as empty; a null language is `und`. Texts without words add nothing, an empty table or
one without candidates gives no rows; repeated rows count each time. Texts of any length are read in
segments that overlap by the words a suffix can reach. Only the two named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.llm.common import byte_slices
from quartermark.operators.windows import topk_per_group
from quartermark.session import cut

#: Bytes of text whose words are told apart at once.
BATCH = 6 << 20
#: Bytes of text per group of suffixes, on average.
GROUP_BYTES = 6 << 20
#: Suffixes above which a group is routed deeper: at most, and at least.
LARGE, SMALL = 2 << 20, 1 << 15
#: Times the mean group above which a group is routed deeper.
UNEVEN = 4
#: Parts that the lookups of one single word are dealt to.
SALTS = 16
#: Bytes that end a piece, and bytes that only part words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_BORDER = re.compile(rb"[ \t.,;:!?\n-\r]")
_SCHEMA = "lang string, part long, suffixes long, words binary, codes binary, weights binary, phrase string, length int, f long"
_ARROW = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("suffixes", pa.int64()), *((c, pa.binary()) for c in ("words", "codes", "weights")), ("phrase", pa.string()), ("length", pa.int32()), ("f", pa.int64())])


# --- suffixes of a text ---


def segments(raw: bytes, size: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, end): a text in parts whose suffixes start before `end`; what follows completes the last ones."""
    context = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n-\r]+){0,%d}" % (longest - 1))
    at = 0
    while at < len(raw):
        border = _BORDER.search(raw, at + size) if len(raw) - at > size else None
        to = border.start() if border else len(raw)
        yield raw[at : context.match(raw, to).end()], to - at
        at = to


def suffixes(raw: bytes, end: int, longest: int) -> tuple[pa.Array, np.ndarray]:
    """(distinct words in order, codes): a column per suffix that starts before `end`; code -1 where its piece has ended."""
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = data[kind == 0].tobytes()
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters)]).dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    codes = place[found.indices.to_numpy(zero_copy_only=False)]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    own = int(np.searchsorted(starts, end))
    table = np.full((longest, own), -1, np.int32)
    for k in range(longest):
        n = max(0, min(own, len(codes) - k))
        table[k, :n] = np.where(piece[k : k + n] == piece[:n], codes[k : k + n], -1)
    return found.dictionary.take(order), table


def equal_parts(table: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(pointer, length, count) of every phrase of at least `least` of the suffixes in `table`.

    Multikey three-way quicksort of suffix pointers; smaller parts are abandoned.
    """
    todo, most = [(np.arange(table.shape[1], dtype=np.int32), 0)], int(weights.max(initial=0))
    while todo:
        pointers, depth = todo.pop()
        n = len(pointers)
        if n < least and (n * most < least or weights[pointers].sum() < least):
            continue
        keys = table[depth][pointers]
        pivot = keys[len(keys) // 2]
        todo.append((pointers[keys < pivot], depth))
        todo.append((pointers[keys > pivot], depth))
        if pivot < 0:
            continue
        same = pointers[keys == pivot]
        size = int(weights[same].sum()) if len(same) * most >= least else 0
        if size >= least:
            yield int(same[0]), depth + 1, size
            if depth + 1 < len(table):
                todo.append((same, depth + 1))


# --- routing ---


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _distinct(table: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns in order, with their weights' sums."""
    if not table.shape[1]:
        return table, weights
    if table.max(initial=0) < 1 << (64 // len(table)) - 1:  # a column fits one word
        bits = np.uint64(64 // len(table))
        key = np.zeros(table.shape[1], np.uint64)
        for row in table:
            key = key << bits | (row + 1).astype(np.uint64)
        order = np.argsort(key) if (weights != 1).any() else None
        key = np.sort(key) if order is None else key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shifts = bits * np.arange(len(table), dtype=np.uint64)[::-1]
        mask = ~np.uint64(0) >> np.uint64(64 - int(bits))
        columns = (key[first] >> shifts[:, None] & mask).astype(np.int32) - 1
    else:
        order = np.lexsort(table[::-1])
        rows = table[:, order]
        first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
        columns = rows[:, first]
    if order is None:
        return columns, np.diff(np.append(first, len(weights)))
    return columns, np.add.reduceat(weights[order], first)


def _packed(lang: str, words: pa.Array, table: np.ndarray, weights: np.ndarray, depth: int, parts: int) -> Iterator[dict[str, Any]]:
    """Suffixes of at least `depth` words, those of one part together with the words they use."""
    far = table[depth - 1] >= 0
    table, weights = table[:, far], weights[far]
    names = words.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    key = np.full(table.shape[1], xxhash.xxh64_intdigest(lang, depth), np.uint64)
    for k in range(depth):
        key = _mixed(key + hashes[table[k]])
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    part, table, weights = part[order], table[:, order], weights[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    zstd = pa.Codec("zstd", 1)
    for a, b in zip(cuts, cuts[1:]):
        own = table[:, a:b]
        if len(words) < 8 * own.size:
            seen = np.zeros(len(words) + 1, bool)
            seen[own + 1] = True
            seen[0] = False
            used = np.flatnonzero(seen) - 1
            codes = np.cumsum(seen, dtype=np.int32)[own + 1]
            codes[own < 0] = 0
        else:
            used, codes = np.unique(own, return_inverse=True)
            none = int(used[0] == -1)
            used, codes = used[none:], codes.reshape(own.shape).astype(np.int32) + 1 - none
        codes, sums = _distinct(codes - 1, weights[a:b])
        kind = "<u2" if len(used) < (1 << 16) - 1 else "<u4"
        held = [b" ".join(map(names.__getitem__, used.tolist())), (codes + 1).astype(kind).tobytes(), sums.astype("<i8").tobytes()]
        packs = [len(x).to_bytes(8, "little") + zstd.compress(x, asbytes=True) for x in held]
        yield {"lang": lang, "part": int(part[a]), "suffixes": codes.shape[1]} | dict(zip(("words", "codes", "weights"), packs))


def _unpacked(words: list[bytes], codes: list[bytes], weights: list[bytes], longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of several packs, all their suffixes as `suffixes` gives them, and their weights."""
    zstd = pa.Codec("zstd")
    plain = lambda x: zstd.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
    lists = [plain(w).split(b" ") for w in words]
    found = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    shared, at, tables, sums = found.indices.to_numpy(zero_copy_only=False).astype(np.int32), 0, [], []
    for x, raw, w in zip(lists, codes, weights):
        raw, n = plain(raw), np.frombuffer(plain(w), "<i8")
        own = np.frombuffer(raw, "<u2" if len(raw) == 2 * len(n) * longest else "<u4").astype(np.int32)
        tables.append(np.concatenate([[np.int32(-1)], shared[at : at + len(x)]])[own].reshape(longest, len(n)).astype(np.int32))
        sums.append(n)
        at += len(x)
    return found.dictionary, np.concatenate(tables, axis=1), np.concatenate(sums)


def _counted(lang: str, words: pa.Array, table: np.ndarray, weights: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of the phrases of exactly `length` words, to be summed."""
    far = table[length - 1] >= 0
    rows, sums = _distinct(table[:length, far], weights[far])
    for at in range(0, rows.shape[1], 1 << 16):
        own = rows[:, at : at + (1 << 16)]
        parts = [words.take(pa.array(x)) for x in own]
        phrases = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" "))
        n = own.shape[1]
        known = {"lang": pa.array([lang] * n, pa.string()), "phrase": phrases.cast(pa.string()), "length": pa.array(np.full(n, length, np.int32)), "f": pa.array(sums[at : at + n])}
        yield pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _batches(packs: Iterator[dict[str, Any]]) -> Iterator[pa.RecordBatch]:
    """Packs in batches of bounded bytes."""
    held, size = [], 0
    for row in packs:
        held.append(row)
        size += 256 + len(row["codes"]) + len(row["words"]) + len(row["weights"])
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def _routed(texts: DataFrame, longest: int, parts: int, batch: int) -> DataFrame:
    """Counts of single words and packs of suffixes by two leading words, from (lang, text)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for b in byte_slices(batches, 1, batch):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                text = text.lower()
                if len(text) > batch:
                    yield from ((lang, raw, end) for raw, end in segments(text, batch, longest))
                else:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
            if size >= batch:
                for lang, own in held.items():
                    raw = b"\n".join(own)
                    yield lang, raw, len(raw)
                held, size = {}, 0
        for lang, own in held.items():
            raw = b"\n".join(own)
            yield lang, raw, len(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw, end in joined(batches):
            words, table = suffixes(raw, end, longest)
            once = np.ones(table.shape[1], np.int64)
            yield from _counted(lang, words, table, once, 1)
            yield from _batches(_packed(lang, words, table, once, 2, parts))

    return texts.mapInArrow(run, _SCHEMA)


def _deeper(packs: DataFrame, longest: int, depth: int, parts: int) -> DataFrame:
    """Packs routed by one more word than `depth`; the sizes of what they split are counted.

    From the last depth on nothing is routed, all phrases are counted where they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 2, 1 << 20):
            for lang, *pack in zip(*(b.column(i).to_pylist() for i in range(4))):
                held, table, weights = _unpacked(*([x] for x in pack), longest)
                yield from _counted(lang, held, table, weights, depth)
                if depth < longest - 1:
                    yield from _batches(_packed(lang, held, table, weights, depth + 1, parts))
                elif depth < longest:
                    yield from _counted(lang, held, table, weights, longest)

    return packs.select("lang", "words", "codes", "weights").mapInArrow(run, _SCHEMA)


def _sorted(packs: DataFrame, longest: int, depth: int, least: int) -> DataFrame:
    """lang, phrase, length, f of the phrases of at least `depth` words in groups that hold all their suffixes."""

    def mine(key: tuple[Any, ...], group: pa.Table) -> pa.Table:
        held, table, weights = _unpacked(*(group.column(c).to_pylist() for c in ("words", "codes", "weights")), longest)
        names, out = held.to_pylist(), []
        for pointer, length, n in equal_parts(table, weights, least):
            if length >= depth:
                out.append((b" ".join(names[c] for c in table[:length, pointer].tolist()).decode(), length, n))
        phrases, lengths, counts = zip(*out) if out else ((), (), ())
        columns = [pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(phrases, pa.string()), pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())]
        return pa.table(columns, ["lang", "phrase", "length", "f"])

    return packs.select("lang", "part", "words", "codes", "weights").groupBy("lang", "part").applyInArrow(mine, "lang string, phrase string, length int, f long")


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 4,
    least: int = 30,
    batch: int = BATCH,
    group_bytes: int = GROUP_BYTES,
    large: int = LARGE,
    small: int = SMALL,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("octet_length(text) > 0")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // group_bytes))
    done, summed, depth = [], [], 2
    table = cut(_routed(texts, longest, parts, batch))
    words = table.filter("length = 1")
    while True:
        summed.append(table.filter("phrase is not null").select("lang", "phrase", "length", "f"))
        packs = table.filter("phrase is null")
        if depth >= longest:
            done.append(_sorted(packs, longest, depth, least))
            break
        groups = packs.groupBy("lang", "part").agg(F.sum("suffixes").alias("size"))
        groups = cut(groups)
        mean = groups.agg(F.avg("size")).first()[0] or 0
        most = min(large, max(small, UNEVEN * mean))
        heavy = groups.filter(F.col("size") > most).select("lang", "part")
        if heavy.isEmpty():
            done.append(_sorted(packs, longest, depth, least))
            break
        done.append(_sorted(packs.join(heavy, ["lang", "part"], "left_anti"), longest, depth, least))
        table = cut(_deeper(packs.join(heavy, ["lang", "part"], "left_semi"), longest, depth, parts))
        depth += 1
    whole = summed[0]
    for more in summed[1:]:
        whole = whole.unionByName(more)
    counts = whole.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    for more in done:
        counts = counts.unionByName(more)
    return cut(counts), words.groupBy("lang").agg(F.sum("f").alias("n"))


# --- scores ---


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 4,
    least: int = 30,
    scale: int = 2_000_000,
    best: int = 2000,
    **sizes: int,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `best` phrases of each language.

    Ordered by score, then a, both descending, then the phrase in byte order.
    """
    counts, totals = phrase_counts(docs, text, lang, longest, least, **sizes)
    several = counts.filter("length > 1").withColumnRenamed("f", "a")
    shorter = F.explode(F.array(F.expr("substring_index(phrase, ' ', length - 1)"), F.expr("substring_index(phrase, ' ', 1 - length)")))
    covered = counts.filter("length > 2").select("lang", "f", shorter.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = "longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"
    kept = several.join(covered, ["lang", "phrase"], "left").filter(free).drop("longer")

    cuts = F.explode(F.expr("sequence(1, length - 1)"))
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("k").alias("size"), F.expr("substring_index(phrase, ' ', k)").alias("of")),
            F.struct(F.lit(1).alias("side"), (F.col("length") - F.col("k")).alias("size"), F.expr("substring_index(phrase, ' ', k - length)").alias("of")),
        )
    )
    asked = kept.withColumn("k", cuts).withColumn("part", sides).select("lang", "phrase", "a", "k", "part.*")
    # Common single words are parts of many phrases: their lookups are dealt.
    asked = asked.withColumn("salt", F.when(F.col("size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = F.explode(F.when(F.col("length") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    known = counts.filter(F.col("length") < longest).select("lang", F.col("phrase").alias("of"), "f", copies.alias("salt"))
    met = asked.join(known, ["lang", "of", "salt"])
    value = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"f{k}{side}")
    wide = met.groupBy("lang", "phrase", "a").agg(*(value(k, side) for k in range(1, longest) for side in (0, 1)))
    score = lambda k: F.expr(f"cast(cast(a as decimal(20,0)) * {scale} as decimal(38,0)) div cast(f{k}0 + f{k}1 as decimal(20,0))")
    choice = lambda k: F.when(F.col(f"f{k}0").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")))
    scored = wide.select("lang", "phrase", "a", F.array_min(F.array(*(choice(k) for k in range(1, longest)))).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    top = topk_per_group(scored, ["lang"], order, best)
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
