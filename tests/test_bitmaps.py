import random
from collections import defaultdict

from quartermark.operators import bitmaps, joins, quality, sets

OBS = "geospatial_type string, geospatial_codes string, dwelling_type string, bedrooms string, statistic string, source_file string"
FC = "geospatial_type string, geospatial_codes string, dwelling_type string, bedrooms string"


def tables(spark, n=400, codes=300):
    rng = random.Random(n)
    slices = [("house", "2"), ("unit", "all"), ("all", "all"), ("vacant_land", "all"), ("house", "0")]
    group = lambda: "-".join(sorted({str(rng.randrange(codes)) for _ in range(rng.choice([1, 1, 2, 5]))}))
    tier = lambda: rng.choice(["suburb", "suburb", "lga"])
    obs = [(tier(), group(), *rng.choice(slices), rng.choice(["median", "median", "count"]), rng.choice(["a.xlsx", "imputed:x"])) for _ in range(n)]
    fc = [(tier(), group(), *rng.choice(slices[1:])) for _ in range(n // 3)]
    return obs * 2, fc


def test_counts_equal_sets_of_polygons(spark):
    obs, fc = tables(spark)
    held = defaultdict(lambda: defaultdict(set))
    for g, codes, d, b, stat, src in [(*r[:4], r[4], r[5]) for r in obs] + [(*r, "median", "fc") for r in fc]:
        if stat == "median" and d != "vacant_land" and b != "0":
            cls = "forecast" if src == "fc" else "imputed" if src.startswith("imputed:") else "observed"
            key = ({"suburb": "sal", "lga": "lga"}[g], d, b)
            held[key]["polygon", cls] |= set(codes.split("-"))
            held[key]["row_key", cls].add(codes)
    o, f = spark.createDataFrame(obs, OBS), spark.createDataFrame(fc, FC)
    maps = bitmaps.class_bitmaps(bitmaps.presence_keys(o, f))
    want = {(*k, c, len(v["polygon", c]), len(v["row_key", c])) for k, v in held.items() for c in bitmaps.SHORT if v["polygon", c]}
    assert {tuple(r) for r in bitmaps.coverage_counts(maps).collect()} == want
    short = {s: c for c, s in bitmaps.SHORT.items()}
    diffs = {(*k, i, p, len(v["polygon", short[a]] - v["polygon", short[b]])) for k, v in held.items() for i, (p, a, b) in enumerate(sets.PAIRS)}
    assert {tuple(r) for r in bitmaps.difference_counts(maps).collect()} == {d for d in diffs if d[-1]}
    rows = joins.presence(o, f)
    by_rows = quality.classify_diffs(rows, sets.pairwise_diffs(rows))
    by_bits = quality.classify_counts(bitmaps.difference_counts(maps), bitmaps.class_sizes(maps)).select(by_rows.columns)
    assert sorted(map(tuple, by_bits.collect())) == sorted(map(tuple, by_rows.collect()))


def test_more_polygons_than_a_bucket_holds(spark):
    rows = spark.range(70_000).selectExpr("'suburb' geospatial_type", "cast(id as string) geospatial_codes", "'house' dwelling_type", "'2' bedrooms", "'median' statistic", "if(id % 2 = 0, 'a', 'imputed:b') source_file")
    fc = rows.filter("cast(geospatial_codes as int) % 3 = 0").select("geospatial_type", "geospatial_codes", "dwelling_type", "bedrooms")
    maps = bitmaps.class_bitmaps(bitmaps.presence_keys(rows, fc))
    assert {r.source_class: r.region_count for r in bitmaps.coverage_counts(maps).collect()} == {"observed": 35_000, "imputed": 35_000, "forecast": 23_334}
    assert {r.pair: r.n_diff for r in bitmaps.difference_counts(maps).collect()}["obs_minus_fc"] == 35_000 - 11_667
    assert maps.filter("kind = 'polygon'").count() == 9


def test_empty(spark):
    maps = bitmaps.class_bitmaps(bitmaps.presence_keys(spark.createDataFrame([], OBS), spark.createDataFrame([], FC)))
    assert bitmaps.coverage_counts(maps).count() == 0 and bitmaps.difference_counts(maps).count() == 0
