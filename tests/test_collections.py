"""Feature collections read in byte ranges, beside a plain parse of the whole document."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.sources import collections, readers

NASTY = ['plain', 'br{ace}s [and] more', 'quote \\" inside', 'ends in slash\\\\', '}}]]', '{"type": "Feature"}', '\\\\\\" odd run', "é 語 \U0001f600", ""]


def feature(i, rng):
    props = {"code": str(i), "name": rng.choice(NASTY) + rng.choice(NASTY), "deep": {"a": [{"b": [1, {"c": "]"}]}]}}
    return {"type": "Feature", "properties": props, "geometry": {"type": "LineString", "coordinates": [[i, -i], [i + 1, 0]]}}


def document(n, seed, **dumps):
    rng = random.Random(seed)
    doc = {
        "name": "x \\ {[", "crs": {"type": "name", "properties": {"name": "a{b"}}, "bbox": [0, 0, 1, 1],
        "other": [{"no": "feature"}], "features": [feature(i, rng) for i in range(n)], "after": {"x": {"y": [1]}},
    }
    return json.dumps(doc, **dumps)


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_ranges_of_any_size_give_every_feature(tmp_path, size):
    for k, dumps in enumerate(({}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")})):
        path, text = tmp_path / f"{k}.json", document(6, k, **dumps)
        path.write_text(text)
        want, got, odd, depth, raw = json.loads(text)["features"], [], 0, 0, path.read_bytes()
        with collections._open(f"file:{path}") as file:
            for start in range(0, len(raw), size):
                stop = min(start + size, len(raw))
                got += collections._features(file, start, stop, bool(odd), depth)
                before = collections._backslashes(file, start)
                quotes, out, within = collections._summary(collections.np.frombuffer(raw[start:stop], "u1"), before)
                depth, odd = depth + (within if odd else out), (odd + quotes) % 2
        got = [json.loads(x) for x in got]
        assert [x for x in got if x.get("type") == "Feature"] == want
        assert depth == 0 and odd == 0


def test_one_file_over_several_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(document(300, 1))
    (tmp_path / "b c.json").write_text(document(0, 2))
    (tmp_path / "empty.json").write_text("")
    texts = collections.feature_texts(spark, str(tmp_path), size=4096).withColumn("task", F.spark_partition_id())
    rows = texts.collect()
    assert sorted(int(json.loads(r.value)["properties"]["code"]) for r in rows) == list(range(300))
    assert len({r.task for r in rows}) > 4
    props = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType())])
    cols = dict(coordinates="array<array<double>>")
    pieces = readers.scan_features(spark, str(tmp_path / "a.json"), props, layout="pieces", **cols)
    whole = readers.scan_features(spark, str(tmp_path / "a.json"), props, layout="document", **cols)
    assert sorted(map(str, pieces.select("code", "name", "geom_type", "geom").collect())) == sorted(map(str, whole.select("code", "name", "geom_type", "geom").collect()))


def test_broken_file_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text(document(5, 1)[:900])
    with pytest.raises(Exception, match="does not end"):
        collections.feature_texts(spark, str(tmp_path), size=256).collect()
