import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermark.plans import graph as K

TREE = "node_id string, parent_id string, size long, distance double, is_leaf boolean"


def points(spark, xy):
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")


def brute_mst(xy):
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    best, out, left = d[0].copy(), [], set(range(1, len(xy)))
    while left:
        j = min(left, key=lambda k: best[k])
        out.append(best[j])
        left.remove(j)
        best = np.minimum(best, d[j])
    return sorted(out)


def brute_merges(edges):
    parent, size, out = {}, {}, []
    find = lambda k: k if parent.setdefault(k, k) == k else find(parent[k])
    for d, a, b in sorted(edges):
        a, b = find(a), find(b)
        parent[b] = a
        size[a] = size.get(a, 1) + size.get(b, 1)
        out.append((d, size[a]))
    return out


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.normal(0, 0.02, (20, 2)), rng.normal(1, 0.3, (20, 2)), rng.normal([3, 0], 0.001, (20, 2))])
    xy[5] = xy[6]
    return xy


def test_spanning_tree_equals_brute_force_with_forced_splitting(spark, blobs):
    edges = K.mst(points(spark, blobs), occupancy=16, pair_work=16).collect()
    assert len(edges) == 59
    assert np.allclose(sorted(e.distance for e in edges), brute_mst(blobs), atol=1e-12)


def test_merges_equal_union_find_and_bisection_agrees(spark):
    rng = np.random.default_rng(5)
    edges = [(float(rng.random()), int(rng.integers(0, i)), i) for i in range(1, 60)]
    tree = spark.createDataFrame([(a, b, d) for d, a, b in edges], "src long, dst long, distance double").cache()
    whole = sorted(tuple(r) for r in K.merges(tree).collect())
    assert [(r[3], r[4]) for r in whole] == brute_merges([(d, a, b) for d, a, b in edges])
    assert sorted(tuple(r) for r in K.merges(tree, ranges=16).collect()) == whole


def test_two_pairs(spark):
    df = spark.createDataFrame([("A", "B", 0.1), ("C", "D", 0.2), ("B", "C", 5.0)], "src string, dst string, distance double")
    got = sorted(tuple(r) for r in K.merges(df).collect())
    assert len(got) == 3 and {got[0][1], got[0][2]} == {"A", "B"} and got[-1][3:] == (5.0, 4)
    tree = K.linkage_to_tree(K.merges(df), spark.createDataFrame([(c,) for c in "ABCD"], "id string"))
    assert tree.filter("parent_id is null").count() == 1 and tree.count() == 7
    sizes = K.subtree_sizes(tree).withColumnRenamed("size", "s").join(tree, "node_id")
    assert sizes.filter("s != size").count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(30) if i % 10 != 9]
    got = {r.node: r.component for r in K.components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(30)}


def leaf(n, p):
    return (n, p, 1, None, True)


def test_condense_trunk(spark):
    rows = [("C3", None, 5, 4.0, False), ("C2", "C3", 4, 3.0, False), ("C0", "C2", 2, 1.0, False), leaf("A", "C0"), leaf("B", "C0"), leaf("E", "C3"), leaf("F", "C2")]
    got = K.condense(spark.createDataFrame(rows, TREE), 2).collect()
    assert [(r.node_id, r.parent_id, r.lambda_birth, r.lambda_death) for r in got] == [("C3", None, 0.0, 1.0)]


def test_condense_balanced(spark):
    rows = [("C2", None, 4, 3.0, False), ("C0", "C2", 2, 1.0, False), ("C1", "C2", 2, 1.5, False), leaf("A", "C0"), leaf("B", "C0"), leaf("D", "C1"), leaf("E", "C1")]
    tree = spark.createDataFrame(rows, TREE)
    got = {r.node_id: r for r in K.condense(tree, 2).collect()}
    assert {k: r.lambda_birth for k, r in got.items()} == pytest.approx({"C2": 0, "C0": 1 / 3, "C1": 1 / 3})
    assert {k: r.lambda_death for k, r in got.items()} == pytest.approx({"C2": 1 / 3, "C0": 1, "C1": 2 / 3})
    assert got["C0"].parent_id == "C2" and K.condense(tree, 3).count() == 1
    st = {r.node_id: r.stability for r in K.stability(tree, 2).collect()}
    assert st == pytest.approx({"C2": 4 / 3, "C0": 2 * (1 - 1 / 3), "C1": 2 * (2 / 3 - 1 / 3)})


def test_layered_tree_has_one_root_and_all_leaves(spark):
    rng = np.random.default_rng(2)
    x = sorted(rng.random(20)) + [50.0]
    pts = points(spark, np.array([(v, 0.0) for v in x]))
    tree = spark.createDataFrame([(i, i + 1, float(x[i + 1] - x[i])) for i in range(20)], "src long, dst long, distance double")
    rows = K.layered_tree(pts, tree, noise_beyond=10.0).cache()
    ids = {r.node_id for r in rows.collect()}
    assert rows.filter("is_leaf").count() == 21 and rows.filter("parent_id is null").count() == 1
    assert all(r.parent_id in ids for r in rows.collect() if r.parent_id)
    assert rows.filter("parent_id = 'NOISE'").count() == 1 and rows.filter("parent_id is null").first()["size"] == 21


@pytest.fixture(scope="module")
def regional(spark):
    n = 5
    nodes = spark.createDataFrame([(str(20001 + i), float(i % n), float(i // n)) for i in range(n * n)], "id string, x double, y double").cache()
    e = [(i, j) for i in range(25) for j in range(25) if i < j and abs(i % 5 - j % 5) <= 1 and abs(i // 5 - j // 5) <= 1]
    edges = spark.createDataFrame([(str(20001 + a), str(20001 + b)) for a, b in e], "src string, dst string").cache()
    return nodes, edges, K.regional_linkage(nodes, edges, "sal").cache()


def test_regional_merges(spark, regional):
    _, _, links = regional
    rows = sorted(links.collect(), key=lambda r: r.merge_step)
    assert [r.merge_step for r in rows] == list(range(24)) and rows[-1].n_obs == 25
    seen = set()
    for r in rows:
        assert r.cluster_a < 25 + r.merge_step and r.cluster_b < 25 + r.merge_step
        assert not {r.cluster_a, r.cluster_b} & seen
        seen |= {r.cluster_a, r.cluster_b}


def test_regions_are_contiguous(spark, regional):
    nodes, edges, links = regional
    rows = K.regionalise(nodes, links, [5, 10, 15], "sal").cache()
    assert rows.count() == 75
    counts = {r.cluster_level: r.n for r in rows.groupBy("cluster_level").agg(F.countDistinct("parent_cluster_id").alias("n")).collect()}
    assert counts == {5: 5, 10: 10, 15: 15}
    five = rows.filter("cluster_level = 5")
    a, b = five.select(F.col("node_id").alias("src"), F.col("parent_cluster_id").alias("ca")), five.select(F.col("node_id").alias("dst"), F.col("parent_cluster_id").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst")
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    parts = K.components(inside.unionByName(loops)).join(five, F.col("node") == F.col("node_id"))
    assert parts.groupBy("parent_cluster_id").agg(F.countDistinct("component").alias("k")).filter("k > 1").count() == 0
    with pytest.raises(ValueError):
        K.regionalise(nodes, links, [26], "sal")


def _line(spark, xs):
    nodes = spark.createDataFrame([(f"{i:03d}", float(x), 0.0) for i, x in enumerate(xs)], "id string, x double, y double")
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(len(xs) - 1)], "src string, dst string")
    return nodes, edges


def _groups(spark, nodes, links, k):
    out = {}
    for r in K.regionalise(nodes, links, [k], "sal").collect():
        out.setdefault(r.parent_cluster_id, []).append(int(r.node_id))
    return sorted(map(sorted, out.values()))


def test_cut_takes_the_closest_first(spark):
    nodes, edges = _line(spark, [0, 50, 200, 201, 202.5])
    links = K.regional_linkage(nodes, edges, "sal").cache()
    assert _groups(spark, nodes, links, 3) == [[0], [1], [2, 3, 4]]
    assert _groups(spark, nodes, links, 2) == [[0, 1], [2, 3, 4]]


def test_hub_takes_its_arms_in_one_round(spark):
    from quartermark.session import scratch_root

    n = 40
    nodes = spark.createDataFrame([("hub", 0.0, 0.0)] + [(f"leaf{i:02d}", float(i + 1), 0.0) for i in range(n)], "id string, x double, y double")
    edges = spark.createDataFrame([(f"leaf{i:02d}", "hub") for i in range(n)], "src string, dst string")
    rows = sorted(K.regional_linkage(nodes, edges, "sal").collect(), key=lambda r: r.merge_step)
    assert scratch_root(spark)
    assert [r.rep_b for r in rows] == [f"leaf{i:02d}" for i in range(n)]
    assert [r.distance for r in rows] == [float(i + 1) for i in range(n)] and [r.n_obs for r in rows] == list(range(2, n + 2))
    assert [(r.cluster_a, r.cluster_b) for r in rows] == [(0, 1)] + [(i + 1, n + i) if i + 1 < n + i else (n + i, i + 1) for i in range(1, n)] 


def _chosen(parent, stable, allow_root=True):
    kids = {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)

    def best(n):
        below = [best(k) for k in kids.get(n, [])]
        total, picked = sum(b for b, _ in below), [x for _, xs in below for x in xs]
        return (stable[n], [n]) if not below or (stable[n] >= total and (allow_root or parent[n] is not None)) else (total, picked)

    return {x for n, p in parent.items() if p is None for x in best(n)[1]}


@pytest.mark.parametrize("shape", ["random", "branch", "star", "single", "forest"])
def test_clusters_chosen_by_excess_of_mass(spark, shape):
    import random

    rng, parent = random.Random(shape), {0: None}
    for i in range(1, 1 if shape == "single" else 61):
        if shape == "branch":  # one long branch with a leaf at every step
            parent[i] = i - 1 if i % 2 else i - 2
        elif shape == "star":
            parent[i] = 0
        else:
            parent[i] = None if shape == "forest" and i % 20 == 0 else rng.randrange(i)
    stable = {i: float(rng.randrange(1, 9) if shape != "branch" else rng.randrange(60) / 4) for i in parent}
    name = lambda i: None if i is None else f"c{i:03d}"
    tree = spark.createDataFrame([(name(i), name(p)) for i, p in parent.items()], "node_id string, parent_id string")
    own = spark.createDataFrame([(name(i), s) for i, s in stable.items()], "node_id string, stability double")
    for allow_root in (True, False):
        got = {int(r.node_id[1:]) for r in K.select_clusters(tree, own, allow_root).filter("selected").collect()}
        assert got == _chosen(parent, stable, allow_root)


def _gradient(spark, wide, high):
    """A grid whose steps shrink steadily, so that a whole row waits for its last pair."""
    at = {(i, j): (sum(100 - 0.5 * k for k in range(i)), sum(90 - 0.4 * k for k in range(j))) for i in range(wide) for j in range(high)}
    name = {p: f"{n:04d}" for n, p in enumerate(sorted(at))}
    nodes = spark.createDataFrame([(name[p], float(x), float(y)) for p, (x, y) in at.items()], "id string, x double, y double")
    edges = [(name[p], name[p[0] + a, p[1] + b]) for p in at for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)) if (p[0] + a, p[1] + b) in at]
    return nodes, spark.createDataFrame(edges, "src string, dst string")


def _merge_rows(links):
    return sorted((round(r.distance, 6), r.n_obs, r.rep_a, r.rep_b) for r in links.collect())


def test_blocks_merge_as_rounds_do(spark, monkeypatch):
    """A block that holds every edge takes the same merges as rounds over the whole graph."""
    nodes, edges = _gradient(spark, 4, 3)
    whole = _merge_rows(K.regional_linkage(nodes, edges, "sal"))
    with monkeypatch.context() as m:
        m.setattr(K, "BLOCK_ENDS", 0)
        assert _merge_rows(K.regional_linkage(nodes, edges, "sal")) == whole


def test_falling_distances_take_few_rounds(spark, monkeypatch):
    """On a chain the merges do not depend on blocks; before, 200 regions took 199 rounds."""
    nodes, edges = _gradient(spark, 200, 1)
    whole = _merge_rows(K.regional_linkage(nodes, edges, "sal"))
    rounds, one = [], K._round
    monkeypatch.setattr(K, "BLOCK_ENDS", 120)
    monkeypatch.setattr(K, "_round", lambda cur: rounds.append(1) or one(cur))
    assert _merge_rows(K.regional_linkage(nodes, edges, "sal")) == whole
    assert len(whole) == 199 and 1 <= len(rounds) <= 8


def test_blocks_give_contiguous_trees(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ENDS", 60)
    nodes, edges = _gradient(spark, 9, 7)
    rows = sorted(K.regional_linkage(nodes, edges, "sal").collect(), key=lambda r: r.merge_step)
    assert [r.merge_step for r in rows] == list(range(62)) and rows[-1].n_obs == 63
    members = {i: {f"{i:04d}"} for i in range(63)}
    pairs = {frozenset(e) for e in edges.collect()}
    for r in rows:
        a, b = members.pop(r.cluster_a), members.pop(r.cluster_b)
        assert any(frozenset((x, y)) in pairs for x in a for y in b) and len(a | b) == r.n_obs
        members[63 + r.merge_step] = a | b


def test_linkage_broadcasts_no_table_that_grows(spark, monkeypatch):
    """Loops join by shuffles: a broadcast passes through the driver once per round and join."""
    from pyspark.sql import DataFrame

    plans, one = [], K.cut

    def seen(df, replaces=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return one(df, replaces)

    monkeypatch.setattr(K, "cut", seen)
    points = spark.createDataFrame([(i, float(i * i % 97), 0.0) for i in range(40)], "id long, x double, y double")
    chain = spark.createDataFrame([(i, i + 1, float((i * 7) % 11 + 1)) for i in range(39)], "src long, dst long, distance double")
    tree = K.linkage_to_tree(K.merges(chain, ranges=8), points)
    out = K.select_clusters(K.condense(tree, 4), K.stability(tree, 4))
    assert isinstance(out, DataFrame) and out.count() > 0
    K.subtree_sizes(tree)
    # The totals of a running sum have one row per range and may be broadcast.
    loops = [p for p in plans if "__run" not in p and "__in_" not in p]
    assert len(loops) > 10 and not [p for p in loops if "BroadcastHashJoin" in p]
