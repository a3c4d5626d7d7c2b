"""Shared helpers of the corpus operators: table access, per-process state, files in the shared folder."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermark.session import salt, scratch_root

#: The white space that separates words, as bytes.split() and this pattern see it.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper and lower case of the only letters that normalisation folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key: Any, build: Callable[[], Any]) -> Any:
    """What `build` returns, made once per Python worker and kept for its later tasks.

    Task functions travel by value, so their module globals last one task only; this registry lives
    in the interpreter. It holds caches alone: a lost worker makes them again.
    """
    store = sys.modules.setdefault("_quartermark_state", types.ModuleType("_quartermark_state")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, which bounds what a task holds as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's URI below the shared checkpoint folder."""
    root = scratch_root(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/{kind}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[Any, str]:
    """(Arrow file system, path) of a URI, so that tasks write and read any store Arrow knows."""
    from pyarrow import fs

    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


def by_code_point(column: str):
    """Sort key under which strings order by code point and null comes last."""
    return [F.col(column).isNull(), F.col(column)]


#: Parts that rows of one key are split into when they look up a small table of keys.
SALTS = 16


def salted_left(rows: DataFrame, keyed: DataFrame, key: str, spread: str) -> DataFrame:
    """`rows` left-joined to `keyed` (one row per key) on `key`; a key's rows are dealt by `spread`.

    `keyed` is repeated once per salt, so give it only the keys that occur more than once.
    """
    left = rows.withColumn("__salt", salt(SALTS, spread))
    right = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose strings (or binaries) in `column` hold at most `limit` bytes, a longer one alone."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(at, to - at)
            at = to
