import base64
import gzip
import hashlib
import heapq
import random

import pytest

from quartermark.llm import warc
from quartermark.llm.common import file_system


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree_matches_heap_merge(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randint(0, 12))) for i in range(k)]
    assert list(warc.LoserTree(map(iter, runs), lambda r: r)) == list(heapq.merge(*runs))


@pytest.mark.parametrize("buffer", [1, 7, 1000])
def test_external_merge(buffer):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(9)}", str(rng.randrange(5)), rng.choice([None, rng.randrange(50)]), 0, "", "", None, f"a{i % 6}", i, 1) for i in range(300)]
    arriving = sorted(rows, key=lambda r: (r[7], warc.order(r)))
    assert list(warc.merged(iter(arriving), buffer)) == sorted(rows, key=warc.order)
    assert list(warc.merged(iter([]), buffer)) == []


def test_url_keys():
    assert warc.url_key("https://www.Example.org:443/A/b?z=1&a=2") == "org,example)/a/b?a=2&z=1"
    assert warc.url_key("example.org:8080") == "org,example:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def plain(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same, default=None)
        revisit = first is not None and page != first
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return out


def rows_for_test():
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(4)}.org/p{rng.randrange(9)}", rng.choice(["", "<p>a</p>", "<p>\xe9</p>", f"<i>{i}</i>"])) for i in range(5, 200)]
    return rows + [(1, None, None), (2, "http://x\r\ny/", "a\r\n\r\nb"), (3, "u", "w" * 300_000), (None, "u", "only null"), (None, "u", "<p>a</p>"), (7, "dup", "<p>a</p>"), (5, "http://h", "same"), (5, "http://h", "same")]


def test_archives_round_trip(spark):
    rows = rows_for_test()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, length int").repartition(4)
    manifest = warc.write(df)
    got = warc.index(manifest, buffer=16).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(plain(rows), key=key)
    assert [warc.order(tuple(r)) for r in got] == sorted(warc.order(tuple(r)) for r in got)
    texts = {(p, (h or "").encode()) for p, _, h in rows}
    for r in got[:40]:
        fs, path = file_system(r.archive)
        raw = gzip.decompress(fs.open_input_file(path).read_at(r.length, r.offset))
        found = warc.parse(raw)
        assert found["page_id"] == r.page_id and (r.record_type == "revisit" or (r.page_id, found["payload"]) in texts)


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type) for r in warc.archived(df, least=3).collect()}
    assert got == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}
    assert warc.archived(df.limit(0)).count() == 0


def test_damaged_archive_is_noticed():
    raw = gzip.decompress(warc.record(1, "u", warc.datetime(2020, 1, 1, tzinfo=warc.timezone.utc), b"payload", True, None))
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paylord"))
