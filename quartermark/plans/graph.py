"""2K: components, spanning trees, linkage, condensed trees and contiguous regions as DataFrame loops.

Every loop halves what is left (pointer jumping, Boruvka rounds, reciprocal merges, rank bisection)
and cuts its lineage in the checkpoint folder, so rounds stay few and a lost executor repeats one.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartermark.operators.windows import row_index, running_sums
from quartermark.session import cut


def held(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """A cut that is joined by shuffles, as are its projections and groups.

    Tables of a loop grow with the input and are joined many times: each broadcast of one that is still
    under Spark's threshold would go through the driver, in every round.
    """
    out = cut(df, replaces)
    spread = _shuffled(out)
    spread._cut_path = out._cut_path
    return spread


def _shuffled(df: DataFrame) -> DataFrame:
    return df.hint("merge")


# --- components (K14) -----------------------------------------------------------


def pointer_jump(parents: DataFrame) -> DataFrame:
    """(node, parent) with roots pointing at themselves to (node, root); depth halves per round."""
    cur = held(parents.select("node", F.col("parent").alias("root")))
    while True:
        up = cur.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        cur = held(cur.join(up, "root").select("node", F.col("__up").alias("root"), (F.col("__up") != F.col("root")).alias("__moved")), cur)
        if cur.filter("__moved").isEmpty():
            return cur.drop("__moved")


def _links(edges: DataFrame, a: str, b: str) -> DataFrame:
    both = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    return edges.select(F.explode(both).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """K14. (node, component): each node of the edge list with the least node it is connected to.

    Alternates two contractions: a node's larger neighbours are hung on its least neighbour, then
    its smaller ones. A hub's neighbours are reduced by `min` before the shuffle and never listed.
    """
    cur = held(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        both = _links(cur, "u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") >= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(_shuffled(low2), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        cur = held(small.filter(F.col("u") != F.col("v")).distinct(), cur)
        seen = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("component"))
    return leaves.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def _hook(choice: DataFrame) -> DataFrame:
    """(c, other) choices of cheapest edges to (node, root). Under a strict edge order the only
    cycles are mutual pairs; the lesser of a pair becomes the root."""
    back = choice.select(F.col("c").alias("other"), F.col("other").alias("__back"))
    fixed = choice.join(back, "other", "left").select(
        F.col("c").alias("node"),
        F.when((F.col("__back") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("parent"),
    )
    ends = fixed.select(F.col("parent").alias("node")).distinct().join(fixed.select("node"), "node", "left_anti")
    return pointer_jump(fixed.unionByName(ends.withColumn("parent", F.col("node"))))


# --- Euclidean minimum spanning tree (K1) ---------------------------------------------

OCCUPANCY = 64
PAIR_WORK = 4096


def _first_radius(pts: DataFrame, occupancy: int) -> float:
    """Largest power-of-two fraction of the extent at which no cell holds more than `occupancy` points."""
    b = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(b[1] - b[0], b[3] - b[2]) or 1.0
    levels = list(range(0, 28))
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("lv"))
    cells = pts.select(F.explode(F.array(*[F.lit(v) for v in levels])).alias("lv"), "x", "y")
    counts = cells.groupBy("lv", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).count()
    peak = {r[0]: r[1] for r in counts.groupBy("lv").agg(F.max("count")).collect()}
    fit = [v for v in levels if peak[v] <= occupancy]
    return side / 2 ** (fit[0] if fit else levels[-1])


def _cell(c: str, r: float, lv: Column) -> Column:
    return F.floor(F.col(c) / (F.lit(r) / F.pow(F.lit(2.0), lv))).cast("bigint")


def _blocks(pts: DataFrame, r: float, lv: int) -> DataFrame:
    """Points of one component in one cell of side r / 2^lv: how many, and their tight box."""
    level = F.lit(lv)
    return pts.groupBy(_cell("x", r, level).alias("cx"), _cell("y", r, level).alias("cy"), "comp").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


SIDE = ["cx", "cy", "comp", "n", "x0", "x1", "y0", "y1"]


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{s}_{c}") for c in SIDE])


def _near(pairs: DataFrame, r: float) -> DataFrame:
    """Block pairs whose boxes come within r, with the least and greatest distance squared."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"))
    far = lambda lo, hi: F.greatest(F.col(f"a_{hi}") - F.col(f"b_{lo}"), F.col(f"b_{hi}") - F.col(f"a_{lo}"))
    sq = lambda c: c * c
    lb = sq(gap("x0", "x1")) + sq(gap("y0", "y1"))
    ub = sq(far("x0", "x1")) + sq(far("y0", "y1"))
    return pairs.withColumns({"lb": lb, "ub": ub}).filter(F.col("lb") <= r * r * (1 + 1e-9))


def _bounded(near: DataFrame) -> DataFrame:
    """Keep block pairs that may hold the cheapest edge of either component."""
    best = near.select(F.explode(F.array("a_comp", "b_comp")).alias("comp"), "ub").groupBy("comp").agg(F.min("ub").alias("u"))
    a, b = best.select(F.col("comp").alias("a_comp"), F.col("u").alias("ua")), best.select(F.col("comp").alias("b_comp"), F.col("u").alias("u2"))
    slack = 1 + 1e-9
    kept = near.join(a, "a_comp").join(b, "b_comp").filter((F.col("lb") <= F.col("ua") * slack) | (F.col("lb") <= F.col("u2") * slack))
    return kept.drop("ua", "u2")


def _cheapest(pts: DataFrame, r: float, pair_work: int) -> DataFrame:
    """(c, other, d2, src, dst): each component's cheapest outgoing edge no longer than r.

    Cells of side r make the 3 x 3 neighbourhood complete for edges up to r. Blocks whose pairing
    would compare more than `pair_work` points are split in four and bounded again, until what
    remains is small; nothing is dropped that could win.
    """
    blocks = _blocks(pts, r, 0)
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = _side(blocks, "a").withColumn("o", step)
    a = a.withColumn("b_cx", F.col("a_cx") + F.col("o.i")).withColumn("b_cy", F.col("a_cy") + F.col("o.j")).drop("o")
    pairs = a.join(_side(blocks, "b"), ["b_cx", "b_cy"]).filter(F.col("a_comp") < F.col("b_comp"))
    pairs = cut(_near(pairs, r))
    lv, done = 0, []
    work = F.col("a_n") * F.col("b_n")
    if not pairs.filter(work > pair_work).isEmpty():
        pairs = cut(_bounded(pairs))
    while True:
        done.append((lv, pairs.filter(work <= pair_work)))
        heavy = pairs.filter(work > pair_work)
        if heavy.isEmpty():
            break
        lv += 1
        sub = _blocks(pts, r, lv)
        for s in ("a", "b"):
            keys = [f"{s}_cx", f"{s}_cy", f"{s}_comp"]
            parts = _side(sub, s).withColumns({f"{s}_px": F.floor(F.col(f"{s}_cx") / 2), f"{s}_py": F.floor(F.col(f"{s}_cy") / 2)})
            heavy = heavy.select(*[c for c in heavy.columns if not c.startswith(f"{s}_")], F.col(keys[0]).alias(f"{s}_px"), F.col(keys[1]).alias(f"{s}_py"), keys[2])
            heavy = heavy.join(parts, [f"{s}_px", f"{s}_py", f"{s}_comp"]).drop(f"{s}_px", f"{s}_py")
        pairs = cut(_bounded(_near(heavy, r)))
    edges = None
    for level, light in done:
        if level > 0 and light.isEmpty():
            continue
        at = pts.select(_cell("x", r, F.lit(level)).alias("cx"), _cell("y", r, F.lit(level)).alias("cy"), "comp", "id", "x", "y")
        pa = at.select(*[F.col(c).alias(f"a_{c}") for c in at.columns])
        pb = at.select(*[F.col(c).alias(f"b_{c}") for c in at.columns])
        keys = light.select("a_cx", "a_cy", "a_comp", "b_cx", "b_cy", "b_comp")
        hit = keys.join(pa, ["a_cx", "a_cy", "a_comp"]).join(pb, ["b_cx", "b_cy", "b_comp"])
        dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
        e = hit.select(
            "a_comp", "b_comp", (dx * dx + dy * dy).alias("d2"), F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst")
        )
        edges = e if edges is None else edges.unionByName(e)
    ways = F.array(
        F.struct(F.col("a_comp").alias("c"), F.col("b_comp").alias("other")), F.struct(F.col("b_comp").alias("c"), F.col("a_comp").alias("other"))
    )
    best = F.min(F.struct("d2", "src", "dst", "w.other"))
    return (
        # A hair below r: cell numbers are rounded quotients.
        edges.filter(F.col("d2") <= r * r * (1 - 1e-9))
        .select("d2", "src", "dst", F.explode(ways).alias("w"))
        .groupBy("w.c")
        .agg(best.alias("b"))
        .select("c", "b.*")
    )


def mst(points: DataFrame, occupancy: int = OCCUPANCY, pair_work: int = PAIR_WORK) -> DataFrame:
    """K1. Euclidean minimum spanning tree of (id, x, y): n - 1 rows (src, dst, distance).

    Boruvka rounds: every component takes its cheapest outgoing edge of length at most r; when none
    is left at r, r doubles. Equal points are joined to their least id first, at distance 0. Equal
    distances are ordered by (least id, greatest id).
    """
    stars = points.groupBy("x", "y").agg(F.min("id").alias("rep"))
    twins = points.join(stars, ["x", "y"]).filter(F.col("id") != F.col("rep"))
    zero = twins.select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"))
    pts = cut(stars.select(F.col("rep").alias("id"), "x", "y", F.col("rep").alias("comp")))
    found = [zero]
    left = pts.count()
    if left > 1:
        r = _first_radius(pts, occupancy)
        while left > 1:
            choice = cut(_cheapest(pts, r, pair_work))
            if choice.isEmpty():
                r *= 2
                continue
            found.append(choice.select("src", "dst", "d2").distinct())
            roots = _hook(choice).select(F.col("node").alias("comp"), "root")
            pts = cut(pts.join(roots, "comp", "left").select("id", "x", "y", F.coalesce("root", "comp").alias("comp")), pts)
            left = pts.select("comp").distinct().count()
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.select("src", "dst", F.sqrt("d2").alias("distance"))


# --- linkage (K2, K3, K5) -----------------------------------------------------------

#: Parts a rank range is split into at each level of `merges`.
RADIX = 8


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge the edges of one rank range in order; ends already carry their size and last merge."""
    parent: dict[str, str] = {}
    size: dict[str, int] = {}
    top: dict[str, str] = {}

    def find(k: str) -> str:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for e in pdf.sort_values("rank").itertuples(index=False):
        for k, n, t in ((e.u, e.su, e.tu), (e.v, e.sv, e.tv)):
            if k not in parent:
                parent[k], size[k], top[k] = k, n, t
        a, b = find(e.u), find(e.v)
        left, right = sorted((top[a], top[b]))
        parent[b] = a
        size[a] += size[b]
        top[a] = f"C{e.rank}"
        out.append((e.rank, left, right, e.distance, size[a]))
    return pd.DataFrame(out, columns=["merge_idx", "left_id", "right_id", "distance", "size"])


def merges(tree: DataFrame, ranges: int | None = None) -> DataFrame:
    """K2. Single-linkage merges of a spanning tree: (merge_idx, left_id, right_id, distance, size).

    Edges are ranked by (distance, ids). Rank ranges are split RADIX ways at a time: a part only needs
    the parts below it contracted to their components, so all parts go on independently, with all
    ranges of a level in one DataFrame. In the end there are at least `ranges` of them (as many as
    shuffle partitions if not given), each merged in order by one task.
    """
    ranked = row_index(tree.select("src", "dst", "distance"), [], ["distance", "src", "dst"], "rank")
    text = lambda c: F.col(c).cast("string")
    cur = held(
        ranked.select(
            "rank", "distance", text("src").alias("u"), text("dst").alias("v"), F.lit(1).cast("long").alias("su"), F.lit(1).cast("long").alias("sv"),
            text("src").alias("tu"), text("dst").alias("tv"),
        )
    )
    ranges = ranges or int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = max(0, math.ceil(math.log(ranges, RADIX) - 1e-9))
    chunk = max(1, -(-cur.count() // RADIX**depth))
    span = chunk * RADIX**depth
    while span > chunk:
        tagged = cur.withColumns({"seg": F.floor(F.col("rank") / span), "part": F.floor(F.col("rank") % span / (span // RADIX))})
        name = lambda c, part: F.concat_ws("#", F.col("seg").cast("string"), F.col(part).cast("string"), F.col(c))
        above = F.explode(F.sequence(F.col("part") + 1, F.lit(RADIX - 1).cast("long")))
        low = tagged.filter(F.col("part") < RADIX - 1).withColumn("above", above)
        low = low.select("rank", name("u", "above").alias("a"), name("v", "above").alias("b"), "su", "sv")
        comp = held(components(low, "a", "b"))
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("su").alias("n")), F.struct(F.col("b").alias("node"), F.col("sv").alias("n")))
        nodes = low.select(F.explode(ends).alias("e")).select("e.*").distinct()
        size = nodes.join(comp, "node").groupBy("component").agg(F.sum("n").alias("n"))
        last = low.join(comp, low.a == comp.node).groupBy("component").agg(F.max("rank").alias("last"))
        info = comp.join(size.join(_shuffled(last), "component"), "component")
        up = tagged.filter("part > 0").withColumns({"a": name("u", "part"), "b": name("v", "part")})
        for end, k, s, t in (("a", "u", "su", "tu"), ("b", "v", "sv", "tv")):
            side = info.select(F.col("node").alias(end), F.col("component").alias("__c"), F.col("n").alias("__n"), F.col("last").alias("__l"))
            up = up.join(_shuffled(side), end, "left").withColumns(
                {
                    k: F.coalesce("__c", k),
                    s: F.coalesce("__n", s),
                    t: F.coalesce(F.concat(F.lit("C"), F.col("__l").cast("string")), t),
                }
            ).drop("__c", "__n", "__l")
        cur = held(tagged.filter("part = 0").select(*cur.columns).unionByName(up.select(*cur.columns)), cur)
        span //= RADIX
    merged = cur.groupBy(F.floor(F.col("rank") / chunk).alias("seg")).applyInPandas(
        lambda pdf: _union_find(pdf), "merge_idx long, left_id string, right_id string, distance double, size long"
    )
    # Trees read the merges several times.
    return held(merged, cur)


def linkage_to_tree(links: DataFrame, leaves: DataFrame, leaf: str = "id") -> DataFrame:
    """K3. Merges and leaves to nodes (node_id, parent_id, size, distance, is_leaf); the root has no parent."""
    name = F.concat(F.lit("C"), F.col("merge_idx").cast("string"))
    up = links.select(F.explode(F.array("left_id", "right_id")).alias("node_id"), name.alias("parent_id"))
    inner = links.select(name.alias("node_id"), "size", "distance", F.lit(False).alias("is_leaf"))
    outer = leaves.select(
        F.col(leaf).cast("string").alias("node_id"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("double").alias("distance"), F.lit(True).alias("is_leaf")
    )
    return inner.unionByName(outer).join(_shuffled(up), "node_id", "left").select("node_id", "parent_id", "size", "distance", "is_leaf")


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """K5. Leaves below every node, by doubling: a node adds the counts of the nodes 2^k below it."""
    cur = held(tree.select("node_id", F.col("parent_id").alias("up"), F.col("is_leaf").cast("long").alias("n")))
    while not cur.filter(F.col("up").isNotNull()).isEmpty():
        add = cur.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("node_id")).agg(F.sum("n").alias("more"))
        above = cur.select(F.col("node_id").alias("up"), F.col("up").alias("up2"))
        cur = held(
            cur.join(add, "node_id", "left")
            .join(above, "up", "left")
            .select("node_id", F.col("up2").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        )
    return cur.select("node_id", F.col("n").alias("size"))


# --- layered tree (K4) ------------------------------------------------------------


def layered_tree(points: DataFrame, tree: DataFrame, noise_beyond: float | None = None) -> DataFrame:
    """K4. n-ary tree: each Boruvka round over the spanning tree is one layer.

    Points whose nearest neighbour is farther than `noise_beyond` hang under NOISE. When several
    nodes are left without a parent, a ROOT joins them.
    """
    edges = tree
    noise = None
    if noise_beyond is not None:
        ends = tree.select(F.explode(F.array("src", "dst")).alias("id"), "distance")
        far = ends.groupBy("id").agg(F.min("distance").alias("d")).filter(F.col("d") > noise_beyond).select("id")
        noise = cut(far)
        edges = tree.filter(F.col("distance") <= noise_beyond)
    ids = points.select("id").distinct()
    members = ids if noise is None else ids.join(noise, "id", "left_anti")
    comp = cut(members.select("id", F.col("id").alias("comp")))
    node = lambda c: F.col(c).cast("string")
    links = [comp.select(node("id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("is_leaf"), F.lit(-1).alias("layer"), "comp")]
    layer = 0
    live = edges.select("src", "dst", "distance")
    while True:
        a = comp.select(F.col("id").alias("src"), F.col("comp").alias("ca"))
        b = comp.select(F.col("id").alias("dst"), F.col("comp").alias("cb"))
        live = cut(live.select("src", "dst", "distance").join(a, "src").join(b, "dst").filter(F.col("ca") != F.col("cb")))
        if live.isEmpty():
            break
        ways = F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o")))
        pick = live.select("distance", "src", "dst", F.explode(ways).alias("w")).groupBy("w.c").agg(
            F.min(F.struct("distance", "src", "dst", "w.o")).alias("b")
        ).select("c", F.col("b.o").alias("other"))
        roots = cut(_hook(pick))
        label = lambda c, n: F.concat(F.lit(f"L{n}_C"), node(c))
        child = node("node") if layer == 0 else label("node", layer - 1)
        links.append(roots.select(child.alias("node_id"), label("root", layer).alias("parent_id"), F.lit(layer == 0).alias("is_leaf"), F.lit(layer).alias("layer"), F.col("root").alias("comp")))
        # Components without an outgoing edge in this round stay as they are.
        comp = cut(comp.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
        layer += 1
    out = None
    for part in links[1:]:
        step = part.select("node_id", "parent_id")
        out = step if out is None else out.unionByName(step)
    leaf_rows = links[0].select("node_id")
    if out is None:
        out = leaf_rows.select("node_id", F.lit(None).cast("string").alias("parent_id")).limit(0)
    up = cut(out)
    nodes = leaf_rows.select("node_id", F.lit(True).alias("is_leaf")).unionByName(
        up.select(F.col("parent_id").alias("node_id"), F.lit(False).alias("is_leaf")).distinct()
    )
    rows = nodes.join(up, "node_id", "left")
    if noise is not None:
        rows = rows.unionByName(noise.select(node("id").alias("node_id"), F.lit(True).alias("is_leaf"), F.lit("NOISE").alias("parent_id")))
        if not noise.isEmpty():
            rows = rows.unionByName(noise.limit(1).select(F.lit("NOISE").alias("node_id"), F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("parent_id")))
    rows = cut(rows)
    tops = rows.filter(F.col("parent_id").isNull()).count()
    if tops > 1:
        root = rows.limit(1).select(F.lit("ROOT").alias("node_id"), F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("parent_id"))
        rows = cut(rows.withColumn("parent_id", F.coalesce("parent_id", F.lit("ROOT"))).unionByName(root))
    sizes = subtree_sizes(rows)
    return rows.join(sizes, "node_id").select("node_id", "parent_id", "size", F.lit(None).cast("double").alias("distance"), "is_leaf")


# --- condensed tree (K6, K7) ---------------------------------------------------------


def _trunks(tree: DataFrame, m: int) -> DataFrame:
    """Interior nodes with lambda, whether they split, their continuation and their trunk's first node."""
    tree = held(tree)
    inner = tree.filter(~F.col("is_leaf"))
    lam = F.when(F.col("distance") > 0, 1 / F.col("distance")).otherwise(0.0)
    kids = inner.filter(F.col("parent_id").isNotNull())
    # Two largest interior children by (size, then least id), merged map-side per parent.
    first = kids.groupBy("parent_id").agg(F.min(F.struct((-F.col("size")).alias("neg"), F.col("node_id").alias("id"))).alias("big"), F.count(F.lit(1)).alias("n_inner"))
    rest = kids.join(first, "parent_id").filter(F.col("node_id") != F.col("big.id")).groupBy("parent_id").agg(F.max("size").alias("second"))
    leafy = tree.filter("is_leaf").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_leaf"))
    base = (
        inner.select("node_id", "parent_id", "size", lam.alias("lam"))
        .join(first.select(F.col("parent_id").alias("node_id"), F.col("big.id").alias("big"), "n_inner"), "node_id", "left")
        .join(_shuffled(rest.select(F.col("parent_id").alias("node_id"), "second")), "node_id", "left")
        .join(leafy.select(F.col("parent_id").alias("node_id"), "n_leaf"), "node_id", "left")
        .withColumn("is_split", F.coalesce(F.col("second") >= m, F.lit(False)))
        .withColumn("next", F.when(~F.col("is_split"), F.col("big")))
    )
    base = held(base)
    above = base.select(F.col("next").alias("node_id"), F.col("node_id").alias("prev")).filter(F.col("node_id").isNotNull())
    chain = base.join(above, "node_id", "left").select(F.col("node_id").alias("node"), F.coalesce("prev", "node_id").alias("parent"))
    start = pointer_jump(chain).select(F.col("node").alias("node_id"), F.col("root").alias("start"))
    return held(base.join(start, "node_id"))


def condense(tree: DataFrame, m: int) -> DataFrame:
    """K6. Clusters that survive as the tree splits: a split needs two interior children of at least m.

    Otherwise the larger interior child continues the cluster. lambda = 1 / distance.
    """
    t = _trunks(tree, m)
    ends = t.filter(F.col("next").isNull()).select(
        F.col("start"), F.col("node_id").alias("last"), F.col("lam").alias("last_lam"), "is_split", "n_leaf"
    )
    heads = t.filter(F.col("node_id") == F.col("start")).select("start", "size", F.col("parent_id").alias("above"))
    splits = t.filter("is_split").select(F.col("node_id").alias("above"), F.col("start").alias("parent"), F.col("lam").alias("birth"))
    rows = heads.join(splits, "above", "left").filter(F.col("above").isNull() | F.col("parent").isNotNull()).join(ends, "start")
    birth = F.coalesce("birth", F.lit(0.0))
    death = F.when(F.col("is_split") | (F.coalesce("n_leaf", F.lit(0)) > 0), F.col("last_lam")).otherwise(birth)
    return rows.select(
        F.col("start").alias("node_id"), F.col("parent").alias("parent_id"), F.col("size").alias("size_at_birth"), birth.alias("lambda_birth"), death.alias("lambda_death")
    )


def stability(tree: DataFrame, m: int) -> DataFrame:
    """K7. Sum over a cluster's points of (lambda at which the point leaves - lambda of birth)."""
    t = _trunks(tree, m)
    clusters = condense(tree, m).select(F.col("node_id").alias("start"), "lambda_birth")
    nxt = t.select(F.col("node_id").alias("next"), F.col("size").alias("next_size"))
    steps = t.join(nxt, "next", "left").join(_shuffled(clusters), "start")
    left = (F.col("size") - F.coalesce("next_size", F.lit(0))) * (F.col("lam") - F.col("lambda_birth"))
    return steps.groupBy(F.col("start").alias("node_id")).agg(F.sum(left).alias("stability"))


def select_clusters(condensed: DataFrame, stable: DataFrame, allow_root: bool = True) -> DataFrame:
    """K7. The flat clusters of largest total stability: node_id, stability, best, selected.

    `best` is the larger of a cluster's own stability and its children's best together; a cluster whose
    own is not exceeded is chosen unless one above it is. Sums go up the tree by rake and compress: a
    round settles every cluster whose children are settled, and where only one child is open it skips
    that child, as max(s, x + c) stays of that form when it is nested. So rounds follow the logarithm
    of the number of clusters, also for a tree that is one long branch. Without `allow_root` a root is
    chosen only if it has no children.
    """
    base = condensed.select("node_id", "parent_id").join(_shuffled(stable.select("node_id", "stability")), "node_id", "left")
    base = held(base.select("node_id", "parent_id", F.coalesce("stability", F.lit(0.0)).alias("stability")))
    kids = base.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    # floor, add: best = greatest(floor, x + add) with x the best of the open child `to`, if there is one.
    own = F.when(F.lit(allow_root) | F.col("parent_id").isNotNull() | F.col("children").isNull(), F.col("stability")).otherwise(F.lit(float("-inf")))
    start = base.join(kids, "node_id", "left")
    start = start.select("node_id", "parent_id", "stability", own.alias("own"), F.coalesce("children", F.lit(0)).alias("children"))
    done = held(start.filter("children = 0").select("node_id", F.col("own").alias("best")))
    open_ = held(start.filter("children > 0").select("node_id", F.col("own").alias("floor")))
    tree = held(start.filter("parent_id is not null").select(F.col("node_id").alias("child"), F.col("parent_id").alias("node_id")))
    jumps = None
    while not open_.isEmpty():
        known = tree.join(done.withColumnRenamed("node_id", "child"), "child", "left")
        state = known.groupBy("node_id").agg(
            F.count_if(F.col("best").isNull()).alias("unsettled"), F.sum("best").alias("add"), F.max(F.when(F.col("best").isNull(), F.col("child"))).alias("to"),
        )
        now = held(open_.join(state, "node_id"))
        chain = now.filter("unsettled = 1").select("node_id", "floor", F.coalesce("add", F.lit(0.0)).alias("add"), "to")
        settled = now.filter("unsettled = 0").select("node_id", F.greatest("floor", "add").alias("best"))
        # Chains double their reach until every one ends at a settled cluster or at one that branches.
        jumps = held(chain)
        while True:
            below = jumps.select(F.col("node_id").alias("to"), F.col("floor").alias("f2"), F.col("add").alias("a2"), F.col("to").alias("t2"))
            more = jumps.join(below, "to", "left")
            longer = held(
                more.select(
                    "node_id",
                    F.when(F.col("t2").isNull(), F.col("floor")).otherwise(F.greatest("floor", F.col("f2") + F.col("add"))).alias("floor"),
                    F.when(F.col("t2").isNull(), F.col("add")).otherwise(F.col("add") + F.col("a2")).alias("add"),
                    F.coalesce("t2", "to").alias("to"),
                    F.col("t2").isNotNull().alias("moved"),
                )
            )
            moved = not longer.filter("moved").isEmpty()
            jumps = held(longer.drop("moved"), longer)
            if not moved:
                break
        ends = jumps.join(_shuffled(settled.withColumnRenamed("node_id", "to")), "to").select("node_id", F.greatest("floor", F.col("best") + F.col("add")).alias("best"))
        settled = held(settled.unionByName(ends))
        done = held(done.unionByName(settled), done)
        open_ = held(open_.join(settled.select("node_id"), "node_id", "left_anti"), open_)
    below = tree.join(done.withColumnRenamed("node_id", "child"), "child").groupBy("node_id").agg(F.sum("best").alias("below"))
    marked = held(start.join(done, "node_id").join(_shuffled(below), "node_id", "left").withColumn("fit", F.col("below").isNull() | (F.col("own") >= F.col("below"))))
    # A cluster is covered if any cluster above it fits: flags are carried up by pointer doubling.
    up = held(marked.select("node_id", F.col("parent_id").alias("above"), F.lit(False).alias("covered")))
    fits = marked.select(F.col("node_id").alias("above"), "fit")
    up = held(up.join(fits, "above", "left").select("node_id", "above", F.coalesce("fit", F.lit(False)).alias("covered")))
    while not up.filter("above is not null").isEmpty():
        next_ = up.select(F.col("node_id").alias("above"), F.col("above").alias("further"), F.col("covered").alias("c2"))
        up = held(up.join(next_, "above", "left").select("node_id", F.col("further").alias("above"), (F.col("covered") | F.coalesce("c2", F.lit(False))).alias("covered")), up)
    return marked.join(up.select("node_id", "covered"), "node_id").select("node_id", "stability", "best", (F.col("fit") & ~F.col("covered")).alias("selected"))


# --- contiguous regions (K8-K11) ------------------------------------------------------


def _hub_merges(cur: DataFrame, best: DataFrame) -> DataFrame:
    """Regions with one neighbour that are nearer to it than its other neighbours: all merge at once.

    Such a region's distance to its hub stays what it is while the hub grows, so a hub takes them in
    the order of distance in a single round, however many there are.
    """
    single = best.filter("deg = 1").select(F.col("c").alias("__c"), F.lit(True).alias("__one"))
    flag = lambda end: single.withColumnsRenamed({"__c": end, "__one": f"one_{end}"})
    e = cur.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").fillna(False, ["one_src", "one_dst"])
    rank = F.struct("d", _tie("src", "dst").alias("tie"))
    inner = e.filter("not one_src and not one_dst").select(F.explode(F.array("src", "dst")).alias("keep"), rank.alias("limit"))
    inner = inner.groupBy("keep").agg(F.min("limit").alias("limit"))
    pick = lambda a, b: F.when(F.col("one_dst"), F.col(a)).otherwise(F.col(b))
    arms = e.filter("one_src <> one_dst").select(
        pick("src", "dst").alias("keep"), pick("dst", "src").alias("gone"), "d", rank.alias("rank"),
        pick("ns", "nd").alias("nk"), pick("nd", "ns").alias("ng"), pick("hs", "hd").alias("hk"), pick("hd", "hs").alias("hg"),
    )
    arms = arms.join(inner, "keep", "left").filter(F.col("limit").isNull() | (F.col("rank") < F.col("limit")))
    w = W.partitionBy("keep").orderBy("rank", "gone")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return arms.select(
        "keep", "gone", "d", (F.row_number().over(w) - 1).alias("seq"), (F.col("nk") + F.sum("ng").over(upto)).alias("n"),
        F.max(F.greatest("d", "hk", "hg")).over(upto).alias("height"),
    )


def _tie(a: str, b: str) -> Column:
    """Order of equal distances: by a digest of the ids, so that regular grids pair off everywhere at once."""
    return F.md5(F.concat_ws("|", a, b))


#: Edge ends that one block of `_inside_blocks` holds; regions with more neighbours are left to `_round`.
BLOCK_ENDS = 20_000
BLOCK_ROWS = "kind string, turn long, seq int, src {id}, dst {id}, d double, ns long, nd long, hs double, hd double"


def _merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rounds of `_round` on the edges of one block, for regions whose nearest one is inside it.

    A region outside stays as it is here. Whatever it merges with, its new distances are means of those
    held here, so two regions that are nearest to each other stay so. Rows come back by kind: merges,
    edges inside the block, and moves (region, the one that holds it now, size, height).
    """
    pdf = pdf.sort_values(["src", "dst"])
    block = pdf["b"].iat[0]
    near: dict = {}
    far: dict = {}
    size: dict = {}
    height: dict = {}
    for e in pdf.itertuples(index=False):
        size[e.src], size[e.dst], height[e.src], height[e.dst] = e.ns, e.nd, e.hs, e.hd
        if e.bs == e.bd:
            near.setdefault(e.src, {})[e.dst] = near.setdefault(e.dst, {})[e.src] = e.d
        else:
            own, out = (e.src, e.dst) if e.bs == block else (e.dst, e.src)
            far.setdefault(own, {})[out] = (e.d * e.ns * e.nd, e.ns * e.nd)
    first = {c: size[c] for c in [*near, *far]}

    def rank(c, o, d):
        a, b = min(c, o), max(c, o)
        return d, hashlib.md5(f"{a}|{b}".encode()).hexdigest(), a, b, o

    def edges_of(c):
        return [*near.get(c, {}).items(), *((o, s / w) for o, (s, w) in far.get(c, {}).items())]

    def nearest(c):
        edges = edges_of(c)
        least = min((d for _, d in edges), default=None)
        return min((rank(c, o, d) for o, d in edges if d == least), default=None)

    def single(c):
        return len(near.get(c, ())) + len(far.get(c, ())) == 1

    best: dict = {}
    into: dict = {}
    merged = []
    fresh, turn = set(first), 0
    while fresh:
        best.update((c, nearest(c)) for c in fresh)
        now = set()
        for c in fresh:
            o = best[c] and best[c][4]
            if o in best and best[o][4] == c and single(c) == single(o):
                now.add((min(c, o), max(c, o), best[c][0], 0))
        for hub in {o for c in fresh for o in ([c] if not single(c) else near.get(c, ())) if not single(o)}:
            arms = [(o, d) for o, d in near.get(hub, {}).items() if single(o)]
            if arms:
                taken = {o for o, _ in arms}
                limit = min((rank(hub, o, d) for o, d in edges_of(hub) if o not in taken), default=(math.inf,))
                arms = sorted(r for r in (rank(hub, o, d) for o, d in arms) if r < limit)
                now.update((hub, r[4], r[0], i) for i, r in enumerate(arms))
        was, gone = {}, {}
        for keep, other, d, seq in sorted(now, key=lambda m: (m[0], m[3])):
            was.setdefault(keep, size[keep])
            was[other], gone[other] = size[other], keep
            size[keep] += size[other]
            height[keep] = max(d, height[keep], height[other])
            merged.append(("merge", turn, seq, keep, other, d, size[keep], 0, height[keep], 0.0))
        into.update(gone)
        # Distances change only at regions that merged; both ends of an edge may have.
        sums: dict = {}
        for c in was:
            for o, d in near.get(c, {}).items():
                u, v = gone.get(c, c), gone.get(o, o)
                if u != v and (o not in was or c < o):
                    w = was[c] * was.get(o, size[o])
                    s, t = sums.get((min(u, v), max(u, v)), (0.0, 0))
                    sums[min(u, v), max(u, v)] = (s + d * w, t + w)
        for c in was:
            for o in near.pop(c, ()):
                if o not in was:
                    del near[o][c]
        for (u, v), (s, t) in sums.items():
            near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = s / t
        for c, keep in gone.items():
            best.pop(c)
            held = far.setdefault(keep, {})
            for o, (s, w) in far.pop(c, {}).items():
                s0, w0 = held.get(o, (0.0, 0))
                held[o] = (s0 + s, w0 + w)
        kept = set(was) - set(gone)
        fresh = kept.union(*(near.get(c, ()) for c in kept))
        turn += 1

    def holder(c):
        while c in into:
            c = into[c]
        return c

    out = merged + [("edge", 0, 0, c, o, d, size[c], size[o], height[c], height[o]) for c, os in near.items() for o, d in os.items() if c < o]
    for c, n in first.items():
        r = holder(c)
        if r != c or size[r] != n:
            out.append(("move", 0, 0, c, r, 0.0, size[r], 0, height[r], 0.0))
    return pd.DataFrame(out, columns=["kind", "turn", "seq", "src", "dst", "d", "ns", "nd", "hs", "hd"])


def _along_curve(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, deg, upto): regions along a Z curve over their places, with a running sum of their edge ends."""
    e = nodes.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")).first()

    def spread(v):
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    step = lambda c, lo: F.floor((F.col(c) - F.lit(lo)) / F.lit(e["side"] or 1.0) * 65535).cast("long")
    z = spread(step("x", e["x0"])).bitwiseOR(F.shiftleft(spread(step("y", e["y0"])), 1))
    at = ends.join(nodes.select(F.col("id").alias("c"), "x", "y"), "c").select("c", "deg", z.alias("z"))
    return running_sums(at, [], ["z", "c"], {"upto": F.col("deg")})


def _inside_blocks(cur: DataFrame, nodes: DataFrame, phase: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Merges that blocks of neighbouring regions decide by themselves, and the edges left.

    Without this step a row of regions whose distances fall steadily takes a round per region. Blocks
    hold about `BLOCK_ENDS` edge ends, and every other phase moves their borders by half a block.
    Distances between blocks are brought up to date as in `_round`, by the sizes before the phase.
    """
    if whole:
        marked = cur.withColumns({"bs": F.lit(0).cast("long"), "bd": F.lit(0).cast("long")})
    else:
        ends = cur.select(F.explode(F.array("src", "dst")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("deg"))
        first = F.col("upto") - F.col("deg") + F.lit(phase % 2 * BLOCK_ENDS // 2)
        block = F.when(F.col("deg") > BLOCK_ENDS, F.lit(-1)).otherwise(F.floor(first / BLOCK_ENDS)).cast("long")
        blocks = cut(_along_curve(ends, nodes).select("c", block.alias("block")))
        of = lambda end, name: blocks.select(F.col("c").alias(end), F.col("block").alias(name))
        marked = cut(cur.join(of("src", "bs"), "src").join(of("dst", "bd"), "dst"))
    held = marked.withColumn("b", F.explode(F.array_distinct(F.array("bs", "bd")))).filter("b >= 0")
    rows = BLOCK_ROWS.format(id=cur.schema["src"].dataType.simpleString())
    out = cut(held.groupBy("b").applyInPandas(_merge_block, rows))
    pairs = out.filter("kind = 'merge'").select(
        F.col("src").alias("keep"), F.col("dst").alias("gone"), "d", "seq", F.col("ns").alias("n"), F.col("hs").alias("height"), "turn"
    )
    left = out.filter("kind = 'edge'").select("src", "dst", "d", "ns", "nd", "hs", "hd")
    if not whole:
        moved = out.filter("kind = 'move'").select(F.col("src").alias("c"), F.col("dst").alias("r"), F.col("ns").alias("n"), F.col("hs").alias("h"))
        between = marked.filter("bs <> bd or bs < 0").select(*cur.columns)
        left = left.unionByName(_carried(between, moved))
    return pairs, cut(left, cur)


def _carried(cur: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges between the regions that hold their ends now, with size-weighted mean distances."""
    to = lambda end: moved.select(F.col("c").alias(end), F.col("r").alias(f"r_{end}"), F.col("n").alias(f"n_{end}"), F.col("h").alias(f"h_{end}"))
    nxt = cur.join(to("src"), "src", "left").join(to("dst"), "dst", "left").select(
        F.coalesce("r_src", "src").alias("u"), F.coalesce("r_dst", "dst").alias("v"), F.coalesce("n_src", "ns").alias("nu"), F.coalesce("n_dst", "nd").alias("nv"),
        F.coalesce("h_src", "hs").alias("hu"), F.coalesce("h_dst", "hd").alias("hv"), "d", (F.col("ns") * F.col("nd")).alias("w"),
    ).filter(F.col("u") != F.col("v"))
    flip = F.col("u") > F.col("v")
    side = lambda x, y, name: F.when(flip, F.col(y)).otherwise(F.col(x)).alias(name)
    nxt = nxt.select(
        F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), side("nu", "nv", "ns"), side("nv", "nu", "nd"),
        side("hu", "hv", "hs"), side("hv", "hu", "hd"), "d", "w",
    )
    mean = (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("d")
    return nxt.groupBy("src", "dst").agg(mean, *[F.max(c).alias(c) for c in ("ns", "nd", "hs", "hd")])


def _round(cur: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges of every mutually nearest pair and of hubs' arms, and the edges left after them."""
    order = F.struct("d", _tie("src", "dst").alias("tie"), "src", "dst", "ns", "nd", "hs", "hd")
    ends = cur.select(F.explode(F.array("src", "dst")).alias("c"), order.alias("e"))
    best = cut(ends.groupBy("c").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("deg")))
    # A pair with one single-neighbour end is an arm and comes from there.
    mutual = best.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("deg") == 1).cast("int")).alias("singles"))
    mutual = mutual.filter("k = 2 and singles <> 1").select(
        F.col("e.src").alias("keep"), F.col("e.dst").alias("gone"), "e.d", F.lit(0).alias("seq"),
        (F.col("e.ns") + F.col("e.nd")).alias("n"), F.greatest("e.d", "e.hs", "e.hd").alias("height"),
    )
    pairs = cut(mutual.unionByName(_hub_merges(cur, best)))
    kept = pairs.groupBy("keep").agg(F.max("n").alias("n"), F.max("height").alias("h"))
    gone = pairs.select("keep", F.col("gone").alias("c")).unionByName(kept.select("keep", F.col("keep").alias("c")))
    moved = gone.join(kept, "keep").withColumnRenamed("keep", "r")
    return pairs.withColumn("turn", F.lit(0).cast("long")), cut(_carried(cur, moved), cur)


def regional_linkage(nodes: DataFrame, edges: DataFrame, tier: str) -> DataFrame:
    """K9. Merges of an average-linkage agglomeration that only joins adjacent regions.

    `nodes` (id, x, y), `edges` (src, dst). Each round merges every mutually nearest pair and the arms
    of hubs; distances to a merged cluster are the size-weighted means of the existing ones. Blocks of
    neighbouring regions take their own rounds first, then one round goes over all borders. A merge
    is as high as its distance, lifted to its children's heights, and merges are numbered by height:
    cutting takes the closest regions together first, wherever they merged. Rows carry
    (merge_step, cluster_a, cluster_b) with leaves 0..N-1 in id order and merge k as N + k, plus one
    leaf of each side (rep_a, rep_b).
    """
    nodes = cut(nodes.select("id", "x", "y"))
    a = nodes.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    one, zero = F.lit(1).cast("long"), F.lit(0.0)
    # Size and height ride on the edges; isolated nodes need no rows.
    cur = cut(
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().join(a, "src").join(b, "dst")
        .select("src", "dst", d.alias("d"), one.alias("ns"), one.alias("nd"), zero.alias("hs"), zero.alias("hd"))
    )
    done, phase = [], 0
    while not cur.isEmpty():
        whole = 2 * cur.count() <= BLOCK_ENDS
        pairs, cur = _inside_blocks(cur, nodes, phase, whole)
        done.append(pairs.withColumn("round", F.lit(2 * phase << 32) + F.col("turn")).drop("turn"))
        if not whole:
            pairs, cur = _round(cur)
            done.append(pairs.withColumn("round", F.lit((2 * phase + 1) << 32) + F.col("turn")).drop("turn"))
        phase += 1
    if not done:
        raise ValueError("no two regions touch")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    steps = cut(row_index(rows, [], ["height", "round", "keep", "seq"], "merge_step"))
    index = row_index(nodes.select("id"), [], ["id"], "leaf").withColumnRenamed("id", "rep")
    n = nodes.count()
    # A side is the latest earlier merge that kept its representative, or the leaf itself.
    event = lambda end: steps.select("merge_step", "round", "seq", F.col(end).alias("rep"), F.lit(end).alias("end"))
    before = F.lag(F.lit(n) + F.col("merge_step")).over(W.partitionBy("rep").orderBy("round", "seq"))
    sides = event("keep").unionByName(event("gone")).withColumn("prev", before).join(index, "rep")
    cluster = F.coalesce("prev", "leaf")
    named = sides.groupBy("merge_step").agg(F.min(cluster).alias("cluster_a"), F.max(cluster).alias("cluster_b"))
    return steps.join(named, "merge_step").select(
        F.lit(tier).alias("tier"), "merge_step", "cluster_a", "cluster_b", F.col("d").alias("distance"), F.col("n").alias("n_obs"),
        F.col("keep").alias("rep_a"), F.col("gone").alias("rep_b"),
    )


def regionalise(
    nodes: DataFrame, links: DataFrame, cuts: list[int], tier: str, allow_disconnected: bool = False
) -> DataFrame:
    """K8, K10, K11. (node_id, tier, parent_cluster_id, cluster_level, distance) for each cut.

    Cutting to K clusters applies the N - K lowest merges.
    """
    links = cut(links)
    n, have = nodes.count(), links.count()
    out = None
    for k in cuts:
        if not 1 <= k <= n:
            raise ValueError(f"cut {k} out of range for {n} nodes")
        if n - k > have and not allow_disconnected:
            raise ValueError(f"{n - have} separate pieces cannot be cut to {k} clusters")
        joined = links.filter(F.col("merge_step") < n - k)
        comp = components(joined, "rep_a", "rep_b").withColumnRenamed("node", "id")
        named = cut(nodes.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("c")))
        # One row per cluster, numbered by its least member.
        number = row_index(named.select("c").distinct(), [], ["c"], "i")
        rows = named.join(number, "c").select(
            F.col("id").alias("node_id"), F.lit(tier).alias("tier"),
            F.concat(F.lit(f"{tier}_L{k}_C"), F.col("i").cast("string")).alias("parent_cluster_id"), F.lit(k).alias("cluster_level"), F.lit(0.0).alias("distance"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# --- node and edge lists (K12) -------------------------------------------------------


def tree_nodes(tree: DataFrame) -> DataFrame:
    label = F.when(F.col("is_leaf"), F.col("node_id")).otherwise(F.concat(F.lit("n="), F.col("size").cast("string")))
    return tree.select(F.col("node_id").alias("id"), label.alias("label"), "size", "is_leaf")


def tree_edges(tree: DataFrame) -> DataFrame:
    rows = tree.filter(F.col("parent_id").isNotNull())
    return rows.select(
        F.concat_ws("→", "parent_id", "node_id").alias("id"), F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.col("size").alias("weight")
    )


def condensed_edges(condensed: DataFrame, scale: float, max_len: float = float("inf")) -> DataFrame:
    """Edges whose length is the child's lambda span, scaled, rounded and clamped to [1, max_len]."""
    span = F.greatest(F.lit(0.0), F.col("lambda_death") - F.col("lambda_birth"))
    rows = condensed.filter(F.col("parent_id").isNotNull())
    length = F.least(F.lit(float(max_len)), F.greatest(F.lit(1.0), F.floor(span * scale + 0.5).cast("double")))
    return rows.select(
        F.concat_ws("→", "parent_id", "node_id").alias("id"), F.col("parent_id").alias("source"), F.col("node_id").alias("target"),
        span.alias("delta_lambda"), length.alias("min_len"),
    )
