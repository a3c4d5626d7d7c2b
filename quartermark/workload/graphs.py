"""Queries of 2K, K13 and C5.

Points on a line (supplier balances) have a spanning tree, merges and sizes that SQL can state; the
plane (embeddings) and the polygon grid are checked by brute force and invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quartermark.functions import columns as C
from quartermark.operators import filters, joins, windows
from quartermark.plans import graph as K
from quartermark.plans import spatial as P
from quartermark.sources import sinks
from quartermark.workload import base as B
from quartermark.workload import spatial as SP
from quartermark.workload.base import VIEWS, query, r6


def line_points(spark, sf):
    return B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_acctbal") + F.col("s_suppkey") / 1048576.0).alias("x"), F.lit(0.0).alias("y")
    )


def line_tree(spark, sf):
    """Spanning tree of points on a line: neighbours in order."""
    at = windows.row_index(line_points(spark, sf), [], ["x", "id"], "pos")
    nxt = at.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("id2"), F.col("x").alias("x2"))
    # Both sides are all points: by shuffles, also while they are under the broadcast threshold.
    pair = at.join(nxt.hint("merge"), "pos")
    return pair.select(F.least("id", "id2").alias("src"), F.greatest("id", "id2").alias("dst"), (F.col("x2") - F.col("x")).alias("distance"))


VIEWS["gaps"] = """
  SELECT *, row_number() OVER (ORDER BY distance, src, dst) - 1 AS rk FROM
  (SELECT pos, least(id, id2) AS src, greatest(id, id2) AS dst, x2 - x AS distance, id, id2 FROM
   (SELECT s_suppkey AS id, s_acctbal + s_suppkey / 1048576.0::DOUBLE AS x, row_number() OVER w AS pos, lead(s_suppkey) OVER w AS id2,
      lead(s_acctbal + s_suppkey / 1048576.0::DOUBLE) OVER w AS x2 FROM supplier WINDOW w AS (ORDER BY s_acctbal + s_suppkey / 1048576.0::DOUBLE, s_suppkey)) WHERE id2 IS NOT NULL)"""
# A merge joins the runs of lower gaps to its left and right, up to the nearest higher gaps.
VIEWS["runs"] = """
  SELECT g.*, coalesce((SELECT max(h.pos) FROM gaps h WHERE h.pos < g.pos AND h.rk > g.rk), 0) AS lo,
         coalesce((SELECT min(h.pos) FROM gaps h WHERE h.pos > g.pos AND h.rk > g.rk), (SELECT count(*) + 1 FROM gaps)) AS hi FROM gaps g"""
VIEWS["links"] = """
  SELECT rk AS merge_idx, distance, hi - lo AS size, least(a, b) AS left_id, greatest(a, b) AS right_id FROM
  (SELECT r.*, coalesce((SELECT 'C' || CAST(max(h.rk) AS VARCHAR) FROM gaps h WHERE h.pos > r.lo AND h.pos < r.pos HAVING count(*) > 0), CAST(r.id AS VARCHAR)) AS a,
          coalesce((SELECT 'C' || CAST(max(h.rk) AS VARCHAR) FROM gaps h WHERE h.pos > r.pos AND h.pos < r.hi HAVING count(*) > 0), CAST(r.id2 AS VARCHAR)) AS b FROM runs r)"""
VIEWS["tree"] = """
  SELECT n.node_id, p.parent_id, n.size, n.distance, n.is_leaf FROM
  (SELECT 'C' || CAST(merge_idx AS VARCHAR) AS node_id, size, distance, false AS is_leaf FROM links
   UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, NULL, true FROM supplier) n
  LEFT JOIN (SELECT unnest([left_id, right_id]) AS node_id, 'C' || CAST(merge_idx AS VARCHAR) AS parent_id FROM links) p USING (node_id)"""


VIEWS["inner_nodes"] = """
  SELECT t.node_id, t.parent_id, t.size, CASE WHEN t.distance > 0 THEN 1 / t.distance ELSE 0 END AS lam, a.node_id AS big, a.size AS big_size,
         b.node_id AS small, coalesce(b.size, 0) AS small_size, coalesce(l.n, 0) AS n_leaf
  FROM tree t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY size DESC, node_id) AS o FROM tree WHERE NOT is_leaf) a ON a.parent_id = t.node_id AND a.o = 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY size DESC, node_id) AS o FROM tree WHERE NOT is_leaf) b ON b.parent_id = t.node_id AND b.o = 2
  LEFT JOIN (SELECT parent_id, count(*) AS n FROM tree WHERE is_leaf GROUP BY 1) l ON l.parent_id = t.node_id WHERE NOT t.is_leaf"""
# One row per cluster and node it passes through, from the root down.
WALK = """
WITH RECURSIVE walk AS (
  SELECT node_id AS start, CAST(NULL AS VARCHAR) AS above, CAST(0 AS DOUBLE) AS birth, node_id AS cursor FROM inner_nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT CASE WHEN small_size >= 4 THEN c.node ELSE start END, CASE WHEN small_size >= 4 THEN start ELSE above END, CASE WHEN small_size >= 4 THEN lam ELSE birth END, c.node
  FROM walk JOIN inner_nodes ON node_id = cursor, LATERAL (SELECT unnest(CASE WHEN small_size >= 4 THEN [big, small] ELSE [big] END) AS node) c WHERE big IS NOT NULL),
cond AS (
  SELECT start AS node_id, above AS parent_id, first.size AS size_at_birth, birth AS lambda_birth,
    CASE WHEN last.small_size >= 4 OR last.n_leaf > 0 THEN last.lam ELSE birth END AS lambda_death
  FROM walk JOIN inner_nodes last ON last.node_id = cursor JOIN inner_nodes first ON first.node_id = start WHERE last.big IS NULL OR last.small_size >= 4)
"""

WALK_STABLE = WALK + """,
stable AS (SELECT start AS node_id, sum((size - CASE WHEN small_size >= 4 OR big IS NULL THEN 0 ELSE big_size END) * (lam - birth)) AS stability
  FROM walk JOIN inner_nodes ON node_id = cursor GROUP BY 1)"""


def _tree(spark, sf):
    return K.linkage_to_tree(K.merges(line_tree(spark, sf)), line_points(spark, sf))


@query("K1_mst_line", "SELECT src, dst, distance FROM gaps")
def _(spark, sf):
    return K.mst(line_points(spark, sf))


@query("K1_mst_plane")
def _(spark, sf):
    e = F.col("embedding")
    pts = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.get(e, 0).cast("double").alias("x"), F.get(e, 1).cast("double").alias("y"))
    return K.mst(pts)


@query("K2_merges", "SELECT merge_idx, left_id, right_id, distance, size FROM links")
def _(spark, sf):
    return K.merges(line_tree(spark, sf))


@query("K2_merges_bisected", "SELECT merge_idx, left_id, right_id, distance, size FROM links")
def _(spark, sf):
    return K.merges(line_tree(spark, sf), ranges=32)


@query("K3_linkage_tree", "SELECT * FROM tree")
def _(spark, sf):
    return _tree(spark, sf)


@query("C5_linkage_lookup", "SELECT 'sal' AS tier, 'single' AS method, * FROM tree")
def _(spark, sf):
    tree = _tree(spark, sf)
    path = sinks.scratch_path(spark, "linkage")
    for tier in ("sal", "lga"):
        sinks.replace_slice(tree.withColumns({"tier": F.lit(tier), "method": F.lit("single")}), path, ["tier", "method"])
    return filters.linkage(spark.read.parquet(path), "sal", "single")


@query("K4_layered_tree")
def _(spark, sf):
    return K.layered_tree(line_points(spark, sf), line_tree(spark, sf), noise_beyond=400.0)


@query("K5_subtree_sizes", "SELECT node_id, size FROM tree")
def _(spark, sf):
    return K.subtree_sizes(_tree(spark, sf))


@query("K6_condense", WALK + "SELECT * FROM cond")
def _(spark, sf):
    return K.condense(_tree(spark, sf), 4)


@query("K7_stability", WALK + """
SELECT start AS node_id, round(sum((size - CASE WHEN small_size >= 4 OR big IS NULL THEN 0 ELSE big_size END) * (lam - birth)), 4) AS stability
FROM walk JOIN inner_nodes ON node_id = cursor GROUP BY 1""")
def _(spark, sf):
    return K.stability(_tree(spark, sf), 4).withColumn("stability", r6("stability", 4))


@query("K7_select_clusters", WALK_STABLE + """,
kids AS (SELECT parent_id, list(node_id) AS kids FROM cond WHERE parent_id IS NOT NULL GROUP BY 1),
deep AS (SELECT node_id, parent_id, 0 AS depth FROM cond WHERE parent_id IS NULL
  UNION ALL SELECT c.node_id, c.parent_id, depth + 1 FROM cond c JOIN deep d ON c.parent_id = d.node_id),
up AS (SELECT (SELECT max(depth) FROM deep) + 1 AS level, MAP {} :: MAP(VARCHAR, DOUBLE) AS best
  UNION ALL
  SELECT level - 1, map_concat(best, (SELECT map(list(n), list(b)) FROM (SELECT CAST(d.node_id AS VARCHAR) AS n,
      greatest(s.stability, coalesce(list_sum(list_transform(k.kids, lambda x: best[CAST(x AS VARCHAR)])), s.stability)) AS b
    FROM deep d JOIN stable s USING (node_id) LEFT JOIN kids k ON k.parent_id = d.node_id WHERE d.depth = level - 1)))
  FROM up WHERE level > 0),
best AS (SELECT node_id, best[CAST(node_id AS VARCHAR)] AS best FROM cond, (SELECT best FROM up WHERE level = 0)),
fit AS (SELECT node_id, c.parent_id, stability, best, stability >= coalesce(below, stability) AS fit
  FROM cond c JOIN stable USING (node_id) JOIN best USING (node_id)
  LEFT JOIN (SELECT c.parent_id, sum(best) AS below FROM cond c JOIN best USING (node_id) GROUP BY 1) k ON k.parent_id = c.node_id),
down AS (SELECT node_id, fit AS selected, fit AS covered FROM fit WHERE parent_id IS NULL
  UNION ALL SELECT f.node_id, f.fit AND NOT covered, covered OR f.fit FROM fit f JOIN down d ON f.parent_id = d.node_id)
SELECT node_id, round(stability, 4) AS stability, round(best, 4) AS best, selected FROM fit JOIN down USING (node_id)""")
def _(spark, sf):
    tree = _tree(spark, sf)
    chosen = K.select_clusters(K.condense(tree, 4), K.stability(tree, 4))
    return chosen.withColumns({c: r6(c, 4) for c in ("stability", "best")})


def _adjacent(spark, sf):
    return P.touching_pairs(SP.squares(spark, sf))


def _nodes(spark, sf):
    return P.centroid_area(P.reproject(SP.squares(spark, sf), 4326, 7855)).select(
        F.col("code").alias("id"), F.round("cx", 3).alias("x"), F.round("cy", 3).alias("y")
    )


@query("K8_regionalise")
def _(spark, sf):
    nodes = _nodes(spark, sf)
    links = K.regional_linkage(nodes, _adjacent(spark, sf), "sal")
    return K.regionalise(nodes, links, [5, 10], "sal")


@query("K9_regional_linkage")
def _(spark, sf):
    return K.regional_linkage(_nodes(spark, sf), _adjacent(spark, sf), "sal")


@query("K10_assignment_counts", """
SELECT 'lga' AS tier, k AS cluster_level, (SELECT count(DISTINCT p) FROM sq) AS n_nodes, k::BIGINT AS n_clusters FROM (VALUES (1), (3)) v(k)""")
def _(spark, sf):
    regions = SP.parents(spark, sf)
    nodes = P.centroid_area(P.reproject(regions, 4326, 7855)).select(F.col("code").alias("id"), "cx", "cy").withColumnsRenamed({"cx": "x", "cy": "y"})
    links = K.regional_linkage(nodes, P.touching_pairs(regions), "lga")
    rows = K.regionalise(nodes, links, [1, 3], "lga")
    return rows.groupBy("tier", "cluster_level").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("parent_cluster_id").alias("n_clusters"))


@query("K12_tree_nodes", "SELECT node_id AS id, CASE WHEN is_leaf THEN node_id ELSE 'n=' || CAST(size AS VARCHAR) END AS label, size, is_leaf FROM tree")
def _(spark, sf):
    return K.tree_nodes(_tree(spark, sf))


@query("K12_tree_edges", "SELECT parent_id || '→' || node_id AS id, parent_id AS source, node_id AS target, size AS weight FROM tree WHERE parent_id IS NOT NULL")
def _(spark, sf):
    return K.tree_edges(_tree(spark, sf))


@query("K12_condensed_edges", WALK + """
SELECT parent_id || '→' || node_id AS id, parent_id AS source, node_id AS target, greatest(0, lambda_death - lambda_birth) AS delta_lambda,
  CAST(least(50, greatest(1, floor(greatest(0, lambda_death - lambda_birth) * 1000 + 0.5))) AS DOUBLE) AS min_len FROM cond WHERE parent_id IS NOT NULL""")
def _(spark, sf):
    return K.condensed_edges(K.condense(_tree(spark, sf), 4), 1000, 50)


@query("K13_scale", "SELECT c_custkey, round(8 + 40 * least(1, greatest(0, c_acctbal / 5000)), 6) AS radius FROM customer")
def _(spark, sf):
    rows = B.table(spark, sf, "customer")
    return rows.select("c_custkey", r6(C.scale("c_acctbal", F.lit(5000.0), 8, 48)).alias("radius"))


@query("K14_components", "SELECT code AS node, min(code) OVER (PARTITION BY p) AS component FROM sq")
def _(spark, sf):
    parent = SP.squares(spark, sf).select("code", "p")
    pairs = _adjacent(spark, sf)
    pairs = pairs.join(parent.select(F.col("code").alias("src"), F.col("p").alias("ps")), "src").join(parent.select(F.col("code").alias("dst"), F.col("p").alias("pd")), "dst")
    return K.components(pairs.filter(F.col("ps") == F.col("pd")).select("src", "dst"))


@query("K15_target_subset", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def _(spark, sf):
    keys = B.table(spark, sf, "lineitem").filter(F.col("l_quantity") == 50).select(F.col("l_suppkey").alias("id"))
    return joins.restrict(line_points(spark, sf).select("id"), keys, "id")
