"""WARC archives and their capture index by external merging.

Pages are written as WARC 1.0 records, one gzip member each, one archive per task. Of equal payloads
the page with the smallest id is a response and the others are revisits that refer to it; which is
which comes from a join on the payload's hash, so no archive has to know another. An indexer reads
every archive from beginning to end, checks payloads against their digests and leaves a run of
captures sorted by (URL key, timestamp, id). Runs are dealt out by ranges of that order, and each
range merges its stretch of every run through a loser tree; what exceeds a task's buffer goes to
merged runs on local disk, which a last loser tree joins. Ranges follow each other, so the result is
one capture history in global order. Ranges split on time and id as well: a host or URL that holds a
third of all captures spans many of them.

An archive's name is new for every attempt of a task and only names that came back are read, so lost
executors do no harm. A null or empty html is an empty payload. Null ids never own a payload others
share with an id; rows that repeat the owner's id are responses too. Null URLs come first. An empty
table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermark.llm.common import as_bytes, file_system, salted_left, shared_folder, slices
from quartermark.session import cut

#: Payloads below this size are always responses.
LEAST_BYTES = 0
#: Captures a merging task holds before it writes a merged run to disk.
BUFFER = 200_000
#: gzip level of records.
LEVEL = 5
#: Time of page 0 where pages carry no capture time: 2020-01-01.
EPOCH = 1_577_836_800
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_RUN = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in _RUN.split(", "))])


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and sorted query, lower case, no scheme or www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower() if "://" in url else f"http://{url.strip().lower()}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{query}" if query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records -----------------------------------------------------------------------


def record(page: int | None, url: str | None, captured: datetime, payload: bytes, response: bool, refers_to: int | None) -> bytes:
    """One gzip member with a response (HTTP head and payload) or a revisit (HTTP head alone)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if response else head
    lines = ["WARC/1.0", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>"]
    lines += [f"WARC-Date: {captured.astimezone(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if not response:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream: Any, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a stream."""
    offset, rest = 0, stream.read(block)
    while rest:
        unpacker, out, size = zlib.decompressobj(31), [], 0
        while True:
            out.append(unpacker.decompress(rest))
            size += len(rest) - len(unpacker.unused_data)
            if unpacker.eof:
                rest = unpacker.unused_data or stream.read(block)
                break
            rest = stream.read(block)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield offset, size, b"".join(out)
        offset += size


def parse(raw: bytes) -> dict[str, Any]:
    """Fields of a record; the payload's digest and length are checked where it is there."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    page = lambda name: int(v) if (v := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    url = fields.get("WARC-Target-URI")
    stamp = "".join(c for c in fields["WARC-Date"] if c.isdigit())
    return {"url": url, "captured": stamp, "page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": named, "record_type": kind, "refers_to": page("WARC-Refers-To"), "payload": payload}


# --- loser tree -----------------------------------------------------------------------


class LoserTree:
    """Merges sorted iterators: inner nodes keep the losers of their matches, the winner leaves at the top.

    Replacing the winner replays only the matches on its own path, one comparison per level.
    """

    def __init__(self, runs: Iterable[Iterator[tuple]], key: Any):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads: list[Any] = [None] * len(self.runs)
        self.keys: list[Any] = [None] * len(self.runs)
        for i in range(len(self.runs)):
            self._advance(i)
        self.losers = [-1] * len(self.runs)
        self.winner = self._play(1) if self.runs else -1

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; an exhausted run goes last, ties go by run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return self.keys[a] < self.keys[b] or (self.keys[a] == self.keys[b] and a < b)

    def _play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.keys[self.winner] is not None:
            yield self.heads[self.winner]
            self._advance(self.winner)
            node, win = (self.winner + len(self.runs)) // 2, self.winner
            while node:
                if self._beats(self.losers[node], win):
                    win, self.losers[node] = self.losers[node], win
                node //= 2
            self.winner = win


def order(row: tuple) -> tuple:
    """(URL key, time, id, archive, offset) of an index row; null ids first."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8])


def merged(rows: Iterator[tuple], buffer: int = BUFFER) -> Iterator[tuple]:
    """Rows of many interleaved runs (each in order) as one run, with at most `buffer` of them in memory."""
    spilled: list[Any] = []
    held: dict[str, list[tuple]] = {}
    size = 0

    def flush() -> LoserTree:
        runs = [r if all(order(a) <= order(b) for a, b in zip(r, r[1:])) else sorted(r, key=order) for r in held.values()]
        return LoserTree(map(iter, runs), order)

    def stored(file: Any) -> Iterator[tuple]:
        with file:
            file.seek(0)
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    for row in rows:
        held.setdefault(row[7], []).append(row)
        size += 1
        if size >= buffer:
            file, part = tempfile.TemporaryFile(), []
            for x in flush():
                part.append(x)
                if len(part) == 1000:
                    pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
                    part = []
            pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
            spilled.append(stored(file))
            held, size = {}, 0
    yield from LoserTree([*spilled, iter(flush())], order)


# --- operator ---------------------------------------------------------------------------


def write(pages: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Writes an archive per task; the manifest: archive, records."""
    spark = pages.sparkSession
    to = folder or shared_folder(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    when = captured if captured is not None else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col(id).cast("long"), F.lit(0)), F.lit(10**9)))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), when.alias("captured"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    same = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    named = salted_left(rows, same.filter("copies > 1").drop("copies"), "sha", "page_id")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = named.select("page_id", "url", "html", "captured", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = f"{to}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in slices(batches):
            if out is None:
                out = file_system(to)[0].open_output_stream(file_system(name)[1], compression=None)
            for page, link, raw, time, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                out.write(record(page, link, time, raw, first is None, first))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return cut(named.mapInArrow(run, "archive string, records long"))


def _batches(rows: Iterable[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)


def runs(manifest: DataFrame) -> DataFrame:
    """Index rows read back from the archives, a sorted run per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, path = file_system(archive)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        r = parse(raw)
                        rows.append((url_key(r["url"]), r["captured"], r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], archive, offset, length))
                rows.sort(key=order)
                yield from _batches(rows)

    # Names are few bytes, so a number is given: AQE would read every archive in one task.
    return manifest.select("archive").repartition(max(1, manifest.count()), "archive").mapInArrow(run, _RUN)


def index(manifest: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """All captures in global order of (URL key, time, id), merged from the archives' runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        yield from _batches(merged(rows, buffer))

    ordered = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "archive", "offset"]
    return cut(runs(manifest)).repartitionByRange(*ordered).mapInArrow(run, _RUN)


def archived(pages: DataFrame, **names: Any) -> DataFrame:
    """Writes `pages`, reads the archives back and returns the merged capture index."""
    return index(write(pages, **names))
