"""Radius-1 out-ego signals per node, from triangles listed in degree order.

For a centre c with successor set S (c excluded):
* size = |S|; directed density = edges inside {c} ∪ S / ((|S|+1)·|S|);
* clustering at c in the undirected ego = 2T / (|S|(|S|−1)), T = undirected
  edges inside S;
* transitivity of the undirected ego = 3Δ / Σ_v C(deg v, 2), Δ = T + triangles
  inside S, degrees counted without self-loops.

An edge inside S closes a triangle with c, and a triangle inside S makes four nodes with all
six edges. Both are listed once from undirected edges that point from the node of smaller
(degree, id) to the other, which is the order of the nodes' numbers: a node then has at most
sqrt(2m) edges out, so a hub's neighbours are never paired. An edge x-y meets y's list of
ends as one row with the rest of x's list, so pairs of neighbours are compared, not shuffled.
Each edge carries which of its two directions exist, so every centre is decided from the row itself.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.ids import consecutive_index
from driftwatch.session import stored

K = "customer_id"
EGO_COLS = ["ego_density", "ego_clustering_coeff", "ego_triadic_closure", "ego_size"]


def ordered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(x, y, d)`` of each undirected edge without self-loops, x < y, and ``(id, n)``: the nodes on
    such edges, numbered by (degree, id). d = 1 if x → y exists, 2 if y → x does, 3 if both do."""
    e = edges.select("src", "dst").filter(F.col("src") != F.col("dst"))
    und = (e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"),
                    F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("d"))
           .groupBy("a", "b").agg(F.expr("bit_or(d)").alias("d")))
    deg = (und.select(F.col("a").alias("id")).unionAll(und.select(F.col("b").alias("id")))
           .groupBy("id").agg(F.count("*").alias("g")))
    names = stored(consecutive_index(deg, ["g", "id"], "n").select("id", "n"), "triangles")
    of = lambda end: names.select(F.col("id").alias(end), F.col("n").alias(f"_{end}"))
    first = F.col("_a") < F.col("_b")
    turned = F.when(first | (F.col("d") == 3), F.col("d")).otherwise(3 - F.col("d"))
    und = und.join(of("a"), "a").join(of("b"), "b").select(
        F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y"), turned.cast("byte").alias("d"))
    return stored(und, "triangles"), names


def triangles(edges: DataFrame) -> DataFrame:
    """``(x, y, z, xy, xz, yz)`` of each triangle, x < y < z; the pairs hold the directions."""
    ends = edges.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("y", "d"))).alias("to"))  # at most sqrt(2m) a node
    ends = stored(ends.select("x", F.col("to.y").alias("zs"), F.col("to.d").alias("ds")), "triangles")
    rest = lambda of: F.slice(of, F.col("i") + 2, F.size(of)).alias(of)
    ahead = (ends.select("x", "zs", "ds", F.posexplode("zs").alias("i", "y")).filter(F.col("i") + 1 < F.size("zs"))
             .select("x", "y", F.get("ds", F.col("i")).alias("xy"), rest("zs"), rest("ds")))
    met = ahead.join(ends.select(F.col("x").alias("y"), F.col("zs").alias("_zs"), F.col("ds").alias("_ds")), "y")
    at = lambda of, d: F.get(d, F.array_position(of, F.col("z")).cast("int") - 1)
    return (met.withColumn("z", F.explode(F.array_intersect("zs", "_zs")))
            .select("x", "y", "z", "xy", at("zs", "ds").alias("xz"), at("_zs", "_ds").alias("yz")))


def fours(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Each four nodes with all six edges, from two triangles on their first two nodes."""
    other = found.select("x", "y", F.col("z").alias("v"), F.col("xz").alias("xv"), F.col("yz").alias("yv"))
    zv = edges.select(F.col("x").alias("z"), F.col("y").alias("v"), F.col("d").alias("zv"))
    return found.join(other, ["x", "y"]).filter(F.col("z") < F.col("v")).join(zv, ["z", "v"])


def _has(pair: str, bit: int) -> Column:
    return F.col(pair).bitwiseAND(bit) != 0


def _both(pair: str) -> Column:
    """Directed edges of a pair."""
    return F.when(F.col(pair) == 3, 2).otherwise(1)


def ego_signals(edges: DataFrame, customers: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    succ = e.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("c"), F.col("dst").alias("u"))
    k = succ.groupBy("c").agg(F.count("*").alias("k"))
    loops = e.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("c"))
    und, names = ordered_edges(e)
    back = (und.filter("d = 3").select(F.explode(F.array("x", "y")).alias("c"))
            .groupBy("c").agg(F.count("*").alias("back")))
    # self-loops of the centre and of its members
    own = loops.withColumn("sl", F.lit(1))
    member_loops = succ.join(loops.withColumnRenamed("c", "u"), "u").groupBy("c").agg(F.count("*").alias("ml"))
    tri = stored(triangles(und), "ego")
    # a centre of a triangle: both others are its successors
    centre = lambda c, a, b, ok, inner: F.when(ok, F.struct(F.col(c).alias("c"), F.col(a).alias("a"),
                                                             F.col(b).alias("b"), inner.alias("inner")))
    at = F.array(centre("x", "y", "z", _has("xy", 1) & _has("xz", 1), _both("yz")),
                 centre("y", "x", "z", _has("xy", 2) & _has("yz", 1), _both("xz")),
                 centre("z", "x", "y", _has("xz", 2) & _has("yz", 2), _both("xy")))
    wed = tri.select(F.explode(F.array_compact(at)).alias("t")).select("t.*")
    t = wed.groupBy("c").agg(F.count("*").alias("T"), F.sum("inner").alias("inner"))
    deg_s = wed.select("c", F.explode(F.array("a", "b")).alias("x")).groupBy("c", "x").agg(F.count("*").alias("dx"))
    triads_s = deg_s.groupBy("c").agg(F.sum((F.col("dx") + 1) * F.col("dx") / 2).alias("tri_pairs"))
    whole = lambda c, ok: F.when(ok, F.col(c))
    four = fours(tri, und).select(F.explode(F.array_compact(F.array(
        whole("x", _has("xy", 1) & _has("xz", 1) & _has("xv", 1)), whole("y", _has("xy", 2) & _has("yz", 1) & _has("yv", 1)),
        whole("z", _has("xz", 2) & _has("yz", 2) & _has("zv", 1)), whole("v", _has("xv", 2) & _has("yv", 2) & _has("zv", 2))))).alias("c"))
    tri_s = four.groupBy("c").agg(F.count("*").alias("D"))
    numbered = (names.withColumnsRenamed({"id": "_id", "n": "c"}).join(back, "c", "left")
                .join(t, "c", "left").join(triads_s, "c", "left").join(tri_s, "c", "left").drop("c").withColumnRenamed("_id", "c"))
    j = (k.join(own, "c", "left").join(member_loops, "c", "left").join(numbered, "c", "left")
         .fillna(0, ["sl", "back", "ml", "inner", "T", "tri_pairs", "D"]))
    kk = F.col("k").cast("double")
    m = F.col("k") + F.col("sl") + F.col("back") + F.col("ml") + F.col("inner")
    # members with no edge inside S still have degree 1 (the centre): C(1,2) = 0
    triads = kk * (kk - 1) / 2 + F.col("tri_pairs")
    delta = F.col("T") + F.col("D")
    sig = j.select(
        F.col("c").alias("id"),
        (m / ((kk + 1) * kk)).alias("ego_density"),
        F.when(kk >= 2, 2 * F.col("T") / (kk * (kk - 1))).otherwise(F.lit(0.0)).alias("ego_clustering_coeff"),
        F.when((kk + 1 >= 3) & (delta > 0), 3 * delta / triads).otherwise(F.lit(0.0)).alias("ego_triadic_closure"),
        F.col("k").cast("long").alias("ego_size"))
    # nodes in the graph without successors: size 0, density 0 (only a self-loop: n = 1)
    c = customers.select(K, F.col(K).cast("string").alias("id"))
    out = c.join(sig, "id", "left")
    return out.select(K, F.coalesce("ego_density", F.lit(0.0)).alias("ego_density"),
                      F.coalesce("ego_clustering_coeff", F.lit(0.0)).alias("ego_clustering_coeff"),
                      F.coalesce("ego_triadic_closure", F.lit(0.0)).alias("ego_triadic_closure"),
                      F.coalesce("ego_size", F.lit(0)).cast("long").alias("ego_size"))
