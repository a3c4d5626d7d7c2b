"""2A: one FeatureCollection file over many tasks.

A byte range cannot tell by itself whether it starts inside a string or how deep it lies. Two passes
answer that: the first sums up each range as the parity of its quotes and the change of depth for
either state at its start; running sums over the ranges of a file give each its true start; the second
pass cuts out the features that start in a range, reading on to the end of the last one. Backslashes
occur only in strings, so whether a quote is escaped does not depend on the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a range; a feature may be longer.
RANGE = 32 << 20
#: Depth at which the features of a collection open: below the root object and its array.
LEVEL = 2


def _open(uri: str):
    """Random-access file of a path as Spark lists it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _backslashes(file, start: int) -> int:
    """Length of the run of backslashes that ends right before `start`."""
    run, step = 0, 64
    while start > 0:
        at = max(0, start - step)
        file.seek(at)
        raw = file.read(start - at)
        tail = len(raw) - len(raw.rstrip(b"\\"))
        run += tail
        if tail < len(raw):
            break
        start, step = at, step * 8
    return run


def _quotes(raw: np.ndarray, before: int) -> np.ndarray:
    """Places of the quotes that no backslash escapes; `before` backslashes come right before `raw`."""
    at = np.flatnonzero(raw == ord('"'))
    slashes = np.flatnonzero(raw == ord("\\"))
    if not len(slashes):
        return at[1:] if before % 2 and len(at) and at[0] == 0 else at
    order = np.arange(len(slashes))
    head = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, order, 0))
    run = order - head + 1 + np.where(slashes[head] == 0, before, 0)
    last = np.searchsorted(slashes, at) - 1
    beside = (last >= 0) & (slashes[np.maximum(last, 0)] == at - 1)
    return at[np.where(beside, run[np.maximum(last, 0)], np.where(at == 0, before, 0)) % 2 == 0]


def _steps(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets and braces, and +1 or -1 for each."""
    opens = (raw == ord("{")) | (raw == ord("["))
    closes = (raw == ord("}")) | (raw == ord("]"))
    at = np.flatnonzero(opens | closes)
    return at, np.where(opens[at], 1, -1)


def _summary(raw: np.ndarray, before: int) -> tuple[int, int, int]:
    """Number of quotes, and change of depth if the range starts outside and inside a string."""
    quotes = _quotes(raw, before)
    at, step = _steps(raw)
    within = np.searchsorted(quotes, at) % 2
    return len(quotes), int(step[within == 0].sum()), int(step[within == 1].sum())


def _lead(buffer: bytes, place: int) -> bytes:
    """Last byte before `place` that is no space, empty if there is none."""
    step = 64
    while place > 0:
        at = max(0, place - step)
        found = buffer[at:place].rstrip()
        if found:
            return found[-1:]
        place, step = at, step * 8
    return b""


def _lead_in(file, start: int) -> bytes:
    """`_lead` of a file."""
    step = 64
    while start > 0:
        at = max(0, start - step)
        file.seek(at)
        found = file.read(start - at).rstrip()
        if found:
            return found[-1:]
        start, step = at, step * 8
    return b""


def _features(file, start: int, stop: int, inside: bool, depth: int) -> Iterator[bytes]:
    """Objects at `LEVEL` of an array that open in [start, stop), each to its end."""
    before, lead = _backslashes(file, start), _lead_in(file, start)
    file.seek(start)
    buffer = file.read(stop - start)
    size, scanned, odd, level, opened = len(buffer), 0, int(inside), depth, None
    while True:
        raw = np.frombuffer(buffer, np.uint8)[scanned:]
        quotes = _quotes(raw, before)
        at, step = _steps(raw)
        outside = (np.searchsorted(quotes, at) + odd) % 2 == 0
        at, step = at[outside], step[outside]
        reach = level + np.cumsum(step)
        for i in np.flatnonzero(((step > 0) & (reach == LEVEL + 1)) | ((step < 0) & (reach == LEVEL))):
            place = scanned + int(at[i])
            if step[i] > 0:
                if place >= size:
                    return
                if buffer[place : place + 1] == b"{" and (_lead(buffer, place) or lead) in (b"[", b","):
                    opened = place
            elif opened is not None:
                yield buffer[opened : place + 1]
                opened = None
        if opened is None:
            return
        level = int(reach[-1]) if len(reach) else level
        before = len(buffer) - len(buffer.rstrip(b"\\"))
        odd, scanned = odd + len(quotes), len(buffer)
        more = file.read(max(1 << 16, len(buffer) - opened))
        if not more:
            raise ValueError(f"the feature at byte {start + opened} does not end")
        buffer += more


def _ranges(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, int]:
    """path, start, stop of every range of the files, dealt to as many tasks as there are, and their number."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    n = int(files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    cuts = files.filter("length > 0").select("path", "length", start.alias("start"))
    return cuts.select("path", "start", F.least(F.col("start") + size, "length").alias("stop")).repartition(n), n


def feature_texts(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """A3. JSON text of each feature of the FeatureCollections below `path`; a file is read in ranges of `size` bytes.

    Features are the objects in root-level arrays whose type is "Feature". Nulls in the list give no
    row. A file that ends within a feature fails the job. Needs a store that Arrow can open.
    """
    ranges, n = _ranges(spark, path, size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                with _open(row["path"]) as file:
                    before = _backslashes(file, row["start"])
                    file.seek(row["start"])
                    out.append(_summary(np.frombuffer(file.read(row["stop"] - row["start"]), np.uint8), before))
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "quotes", "outside", "inside"])

    summed = ranges.mapInArrow(sums, "path string, start long, stop long, quotes long, outside long, inside long")
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    change = F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum(change).over(earlier), F.lit(0))
    placed = summed.withColumn("odd", odd).withColumn("depth", depth).select("path", "start", "stop", "odd", "depth")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with _open(row["path"]) as file:
                    held, room = [], 0
                    for x in _features(file, row["start"], row["stop"], row["odd"], row["depth"]):
                        held.append(x.decode())
                        room += len(x)
                        if room > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                            held, room = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    texts = placed.repartition(n).mapInArrow(cut, "value string")
    return texts.filter(F.get_json_object("value", "$.type") == "Feature")
