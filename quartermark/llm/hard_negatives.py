"""Hard-negative mining by score bounds along a spanning tree of anchors.

Anchors are sorted by the signs of fixed projections, so that near ones come together, and cut into
blocks; each block gets a minimum spanning tree. A row's score with an anchor differs from its score
with the parent anchor by at most the edge's length times the row's norm. So bounds of all scores are
carried from anchor to anchor, and only rows whose bounds overlap the window of scores an anchor looks
for are scored again. An edge too long to rule anything out is cut: its child starts a tree of its own
and is scored outright, many of them in one product.

Two passes over the rows do this: the first looks for an anchor's best rows of its own label, whose
scores set the windows of the second, which looks for the best rows of other labels in each window. The
first pass has no window of its own: what the parent's best rows score with an anchor is its lower end.
Rows stay in the tasks that read them; a task holds HOLD bytes of vectors at a time and streams the
blocks of anchors, which lie in the shared folder, past them. Only the best per held rows, anchor and window are shuffled. Equal anchors
are mined once and repeated afterwards.

Rows with a null label or vector, or with a null or non-finite component, take no part. A null id is no
anchor and comes last in ties. Shorter vectors count as if filled up with zeros. Repeated rows are rows
of their own: another copy of an anchor's row is a positive. An anchor without other rows of its label,
and a positive without rows in its window, give no rows; so does an empty table. Scores must fit 64-bit
integers. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.llm.common import file_system, shared_folder
from quartermark.session import cut

#: Anchors of a spanning tree.
BLOCK = 256
#: Bytes of vectors (as the table has them) that a task scores at a time.
HOLD = 16 << 20
#: Edges longer than this share of the anchor's norm are cut.
LONG_EDGE = 0.5
#: Scale of the components before they are rounded down.
SCALE = 256


# --- vectors ---


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, filled up with zeros."""
    flat = np.floor(SCALE * pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _exact(norm: float) -> type:
    """The narrowest kind in which sums of products up to that bound are exact."""
    return np.float32 if norm < 2**23 else np.float64 if norm < 2**52 else np.int64


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, not below the true ones."""
    wide = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide)) * (1 + 1e-9)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of the minimum spanning tree: parents come before children, a root is its own parent."""
    n, wide = len(vectors), vectors.astype(np.float64)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    reach, via, free = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    reach[0] = 0
    for i in range(n):
        at = int(np.argmin(np.where(free, reach, np.inf)))
        order[i], parent[at], edge[at] = at, via[at], reach[at]
        free[at] = False
        apart = np.sqrt(((wide - wide[at]) ** 2).sum(axis=1))
        closer = free & (apart < reach)
        reach[closer], via[closer] = apart[closer], at
    return order, parent, edge * (1 + 1e-9)


# --- blocks of anchors ---


def _taking_part(rows: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """id, label, vector (doubles) of the rows that take part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = rows.select(F.col(id).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return named.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", sound))


def _blocked(anchors: DataFrame, width: int, block: int) -> DataFrame:
    """Anchors (id, label, vector, copies) with their place in a block's spanning tree."""
    spark = anchors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signs = np.random.default_rng(5).standard_normal((width, 24))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = (_matrix(b.column(2), width) @ signs > 0) @ (1 << np.arange(24)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits.astype(np.int64))], [*b.schema.names, "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= block:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield tree(whole.slice(0, block), number)
                held, number = [whole.slice(block)], number + 1
        if sum(x.num_rows for x in held):
            yield tree(pa.Table.from_batches(held).combine_chunks().to_batches()[0], number)

    def tree(b: pa.RecordBatch, number: int) -> pa.RecordBatch:
        vectors = _matrix(b.column(2), width)
        order, parent, edge = spanning_tree(vectors)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        b = b.take(pa.array(order))
        own = (vectors[order] ** 2).sum(axis=1)
        more = [np.full(len(order), number), np.arange(len(order)), place[parent[order]], edge[order], own]
        return pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, more)], [*b.schema.names[:4], "block", "place", "parent", "edge", "self"])

    kinds = f"id {dict(anchors.dtypes)['id']}, label long, vector array<double>, copies long, "
    sorted_ = anchors.mapInArrow(keyed, kinds + "near long").repartitionByRange(tasks, "near", "id", F.xxhash64("vector", "label"))
    return sorted_.sortWithinPartitions("near", "id").mapInArrow(run, kinds + "block long, place long, parent long, edge double, self long")


def _written(anchors: DataFrame, kind: str) -> str:
    """Folder with the anchors, a block's in one file and in order."""
    folder = shared_folder(anchors.sparkSession, kind)
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors.repartition(tasks, "block").sortWithinPartitions("block", "place").write.option("compression", "zstd").parquet(folder)
    return folder


def _blocks(folder: str) -> Iterator[pa.Table]:
    """The blocks below a folder, one at a time."""
    from pyarrow import fs
    from pyarrow import parquet

    system, path = file_system(folder)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    for name in files:
        rest = None
        with system.open_input_file(name) as source:
            for batch in parquet.ParquetFile(source).iter_batches(batch_size=4 * BLOCK):
                table = pa.Table.from_batches([batch])
                table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
                number = table.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    yield table.slice(a, b - a)
                rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield rest


# --- scores of held rows ---


class Held:
    """Vectors that a task holds, with what the search along a tree needs."""

    def __init__(self, ids: pa.Array, labels: np.ndarray, vectors: np.ndarray, anchors: float):
        order = pc.sort_indices(ids)  # nulls come last
        self.ids, at = ids.take(order), order.to_numpy()
        self.labels, vectors = labels[at], vectors[at]
        self.norms = _norms(vectors)
        self.kind = _exact(float(self.norms.max(initial=0)) * anchors)
        self.vectors = vectors.astype(self.kind)

    def scores(self, anchors: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        own = self.vectors if rows is None else self.vectors[rows]
        return (own @ anchors.astype(self.kind).T).astype(np.int64)

    def search(self, vectors: np.ndarray, parent: np.ndarray, edge: np.ndarray, windows: Any) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores): rows of each anchor that may lie in its window (low, high), scored.

        Bounds come from the parent's. A window is asked for when its anchor is reached.
        """
        n, root = len(vectors), edge > LONG_EDGE * _norms(vectors)
        root[0] = True
        children = np.bincount(parent[~root], minlength=n)
        bounds: dict[int, list[np.ndarray]] = {}
        roots = np.flatnonzero(root)
        for first in range(0, len(roots), 32):
            bounds.update((int(r), [s, s]) for r, s in zip(roots[first : first + 32], self.scores(vectors[roots[first : first + 32]]).T) if children[r])
        for i in range(n):
            low, high = windows(i)
            if root[i]:
                found = bounds[i][0] if i in bounds else self.scores(vectors[i : i + 1])[:, 0]
                rows = np.flatnonzero((found >= low) & (found <= high))
                yield i, rows, found[rows]
                continue
            above, below = bounds[int(parent[i])]
            children[parent[i]] -= 1
            if not children[parent[i]]:
                bounds.pop(int(parent[i]))
            if edge[i] == 0:  # the same vector: the parent's bounds are its own
                own = [above, below]
            else:
                swing = np.ceil(edge[i] * self.norms).astype(np.int64)
                own = [above - swing, below + swing]
            rows = np.flatnonzero((own[1] >= low) & (own[0] <= high))
            scores = self.scores(vectors[i : i + 1], rows)[:, 0]
            if children[i]:
                if edge[i] == 0:
                    own = [own[0].copy(), own[1].copy()]
                own[0][rows] = own[1][rows] = scores
                bounds[i] = own
            inside = (scores >= low) & (scores <= high)
            yield i, rows[inside], scores[inside]


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by place (held rows are in id order)."""
    if len(rows) > 8 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[scores >= least], scores[scores >= least]
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


def _held(batches: Iterator[pa.RecordBatch], width: int, hold: int, anchors: float) -> Iterator[Held]:
    """Rows (id, label, vector) of a task in parts of at most about `hold` bytes."""
    some = max(1, hold // max(1, 8 * width))
    ids, labels, vectors, n = [], [], [], 0

    def part() -> Held:
        return Held(pa.concat_arrays(ids), np.concatenate(labels), np.concatenate(vectors), anchors)

    for whole in batches:
        for at in range(0, whole.num_rows, some):
            b = whole.slice(at, some)
            if n + b.num_rows > some and n:
                yield part()
                ids, labels, vectors, n = [], [], [], 0
            ids.append(b.column(0))
            labels.append(b.column(1).to_numpy())
            vectors.append(_matrix(b.column(2), width))
            n += b.num_rows
    if n:
        yield part()


def _positives(rows: DataFrame, folder: str, width: int, anchors: float, k: int, hold: int) -> DataFrame:
    """block, place, id, score: the best k + 1 rows of an anchor's label among rows held together, its own row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, width, hold, anchors):
            for table in _blocks(folder):
                vectors, labels = _matrix(table.column("vector").combine_chunks(), width), table.column("label").to_numpy()
                found, seen = [], np.full(len(vectors), np.iinfo(np.int64).min)
                parent, edge = table.column("parent").to_numpy(), table.column("edge").to_numpy()

                def window(i: int) -> tuple[int, int]:
                    # What the parent's best rows of this label score here is reached by k + 1 rows at least.
                    own = near.get((int(parent[i]), int(labels[i])))
                    if own is not None and len(own) > k:
                        seen[i] = held.scores(vectors[i : i + 1], own)[:, 0].min()
                    return int(seen[i]), np.iinfo(np.int64).max

                near: dict[tuple[int, int], np.ndarray] = {}
                for i, at, scores in held.search(vectors, parent, edge, window):
                    same = held.labels[at] == labels[i]
                    best, scores = _best(at[same], scores[same], k + 1)
                    near[i, int(labels[i])] = best
                    found.append((np.full(len(best), i), best, scores))
                place, at, scores = (np.concatenate(x) for x in zip(*found))
                block = np.full(len(at), table.column("block")[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(place), held.ids.take(pa.array(at)), pa.array(scores)], ["block", "place", "id", "score"])

    return rows.mapInArrow(run, f"block long, place long, id {dict(rows.dtypes)['id']}, score long")


def _negatives(rows: DataFrame, folder: str, width: int, anchors: float, k: int, hold: int) -> DataFrame:
    """block, place, window, id, score: the best k rows of other labels in each window among rows held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, width, hold, anchors):
            for table in _blocks(folder):
                vectors, labels = _matrix(table.column("vector").combine_chunks(), width), table.column("label").to_numpy()
                lows, highs = (table.column(c).to_pylist() for c in ("lows", "highs"))
                ends = [(min(lo, default=1), max(hi, default=0)) for lo, hi in zip(lows, highs)]
                found: list[tuple[Any, ...]] = []
                parent, edge = table.column("parent").to_numpy(), table.column("edge").to_numpy()
                for i, at, scores in held.search(vectors, parent, edge, ends.__getitem__):
                    other = held.labels[at] != labels[i]
                    at, scores = at[other], scores[other]
                    for w, (lo, hi) in enumerate(zip(lows[i], highs[i])):
                        inside = (scores >= lo) & (scores <= hi)
                        best, own = _best(at[inside], scores[inside], k)
                        if len(best):
                            found.append((np.full(len(best), i), np.full(len(best), w), best, own))
                if found:
                    place, window, at, scores = (np.concatenate(x) for x in zip(*found))
                    block = np.full(len(at), table.column("block")[0].as_py())
                    columns = [pa.array(block), pa.array(place), pa.array(window), held.ids.take(pa.array(at)), pa.array(scores)]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "place", "window", "id", "score"])

    return rows.mapInArrow(run, f"block long, place long, window long, id {dict(rows.dtypes)['id']}, score long")


def mine(
    rows: DataFrame,
    anchor: Column,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block: int = BLOCK,
    hold: int = HOLD,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `anchor` (over id, label, vector) holds. Their positives are their
    first other rows of the same label by score, ties by smaller id. Negatives are the first rows of other
    labels whose score is `low` to `high` per cent of the positive's.
    """
    known = _taking_part(rows, id, label, vector)
    width = known.agg(F.max(F.size("vector"))).first()[0] or 0
    chosen = known.filter(anchor).groupBy("id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    trees = cut(_blocked(chosen, width, block))
    norm = float(trees.agg(F.max("self")).first()[0] or 0) ** 0.5 + 1

    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    found = _positives(known, _written(trees, "anchors"), width, norm, positives, hold)
    found = found.withColumn("n", F.row_number().over(W.partitionBy("block", "place").orderBy(*best))).filter(F.col("n") <= positives + 1)
    named = found.join(trees.select("block", "place", F.col("id").alias("anchor_id"), "self"), ["block", "place"])
    # One row with the anchor's id and its score with itself is the anchor's own.
    own = F.min(F.when((F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("self")), F.col("n"))).over(W.partitionBy("block", "place"))
    others = named.withColumn("own", F.coalesce(own, F.lit(positives + 1))).filter("n <> own")
    ordered = F.array_sort(F.collect_list(F.struct("n", "id", "score")))
    share = lambda score, per_cent: score.cast("decimal(20,0)") * F.lit(per_cent) * F.lit(Decimal("0.01"))
    windows = others.groupBy("block", "place").agg(ordered.alias("p"))
    windows = windows.select(
        "block",
        "place",
        "p",
        F.transform("p", lambda x: F.ceil(share(x.score, low))).cast("array<long>").alias("lows"),
        F.transform("p", lambda x: F.floor(share(x.score, high))).cast("array<long>").alias("highs"),
    )
    ready = cut(trees.join(windows, ["block", "place"], "left").withColumns({c: F.coalesce(c, F.array().cast("array<long>")) for c in ("lows", "highs")}), replaces=trees)

    met = _negatives(known, _written(ready, "windows"), width, norm, negatives, hold)
    met = met.withColumn("rank", F.row_number().over(W.partitionBy("block", "place", "window").orderBy(*best))).filter(F.col("rank") <= negatives)
    asked = ready.select("block", "place", F.col("id").alias("anchor_id"), "copies", F.posexplode("p").alias("window", "p"))
    return (
        met.join(asked.withColumn("window", F.col("window").cast("long")), ["block", "place", "window"])
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
    )
