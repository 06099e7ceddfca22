"""G05 layer depth (64 searches to a word of bits) and G04 circular flows.

Both are iterative DataFrame jobs: each round is a join of the frontier with
the edge table less what is already known, and each round's
state is written into the shared checkpoint folder so lineage stays short
and a lost executor only replays one round.  The loop stop is a bounded
scalar (a row count), never data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions import dims
from driftwatch.functions.ids import consecutive_index
from driftwatch.operators.graph.edges import graph_nodes
from driftwatch.operators.graph.ego import ordered_edges, triangles
from driftwatch.session import release, stored

K = "customer_id"


#: Customers whose searches share a row, one bit each.
WORD = 64
#: Rows of (word, node) that a batch of searches may hold.
BATCH_ROWS = 200_000_000


def _reached(edges: DataFrame, start: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """From ``start`` (word, node, bits): what each word has reached within ``cutoff`` steps, start
    included, as (word, node, bits); and (word, d, bits), the searches that found a new node d steps away."""
    seen = front = stored(start, "reach")
    found, d = [], 0
    while d < cutoff:
        d += 1
        met = (front.join(edges, F.col("node") == F.col("u")).groupBy("word", F.col("v").alias("node"))
               .agg(F.expr("bit_or(bits)").alias("_met")))
        new = (met.join(seen.withColumnRenamed("bits", "_seen"), ["word", "node"], "left")
               .select("word", "node", F.expr("_met & ~coalesce(_seen, 0L)").alias("bits")).filter("bits <> 0"))
        old, before = seen, front
        front = stored(new, "reach")
        found.append(stored(front.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).withColumn("d", F.lit(d)), "reach"))
        release(before if before is not old else None)
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front).groupBy("word", "node").agg(F.expr("bit_or(bits)").alias("bits")), "reach")
        release(old)
    last = found[0]
    for f in found[1:]:
        last = last.unionByName(f)
    return seen, last


def layer_depth(edges: DataFrame, customers: DataFrame, cutoff: int = dims.GRAPH_LAYER_CUTOFF,
                batch_rows: int = BATCH_ROWS) -> DataFrame:
    """For each customer, the largest BFS distance (≤ cutoff) along
    out-edges and the number of nodes reached (source excluded).

    64 customers search at once: a row (word, node) holds one bit for each of them that has
    reached the node, a step is a join with the edges and a bitwise OR per (word, node), and
    what is new is the OR without the bits already seen. Words run in batches, so that no
    more than ``batch_rows`` rows are alive whatever the number of customers.

    A customer none of whose successors has an out-edge reaches just them, one step away, so it
    needs no search: in a graph of customers and outside counterparties that is every one."""
    names = stored(consecutive_index(graph_nodes(edges), ["id"], "n"), "reach")
    of = lambda end, at: names.select(F.col("id").alias(end), F.col("n").alias(at))
    e = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    e = stored(e.join(of("src", "u"), "src").join(of("dst", "v"), "dst").select("u", "v"), "reach")
    onward = e.select(F.col("u").alias("v"), F.lit(True).alias("_on")).distinct()
    near = stored(e.join(onward, "v", "left").groupBy(F.col("u").alias("n")).agg(F.count("*").alias("_k"), F.max("_on").alias("_on"))
                  .join(names, "n"), "reach")
    one_step = near.filter(F.col("_on").isNull()).select("id", F.lit(1).alias("layer_depth"), F.col("_k").alias("reachable_nodes"))
    roots = customers.select(F.col(K).cast("string").alias("id")).distinct().join(near.filter("_on").select("id", "n"), "id")
    roots = stored(consecutive_index(roots, ["n"], "r"), "reach")
    n_nodes, n_roots = names.count(), roots.count()
    words, batch = -(-n_roots // WORD), max(1, batch_rows // max(n_nodes, 1))
    roots = roots.select("id", F.col("n").alias("node"), F.floor(F.col("r") / WORD).cast("long").alias("word"), (F.col("r") % WORD).cast("int").alias("bit"))
    per = one_step
    for first in range(0, words, batch):
        own = roots.filter(F.col("word").between(first, first + batch - 1))
        start = own.select("word", "node", F.expr("shiftleft(1L, bit)").alias("bits"))
        seen, last = _reached(e, start, cutoff)
        counts = seen.groupBy("word").agg(F.array(*[F.expr(f"count_if((shiftrightunsigned(bits, {b}) & 1) = 1)") for b in range(WORD)]).alias("n"))
        depth = last.groupBy("word").agg(F.array(*[F.expr(f"max(CASE WHEN (shiftrightunsigned(bits, {b}) & 1) = 1 THEN d END)") for b in range(WORD)]).alias("d"))
        one = own.join(counts, "word").join(depth, "word").select(
            "id", F.get("d", F.col("bit")).alias("layer_depth"), (F.get("n", F.col("bit")) - 1).alias("reachable_nodes"))
        per = per.unionByName(stored(one, "reach"))
        release(seen)
    c = customers.select(K, F.col(K).cast("string").alias("id"))
    return c.join(per, "id", "left").select(
        K, F.coalesce("layer_depth", F.lit(0)).cast("long").alias("layer_depth"),
        F.coalesce("reachable_nodes", F.lit(0)).cast("long").alias("reachable_nodes"))


def _core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both an in- and an out-edge, repeatedly: no others lie on a cycle."""
    core = stored(edges.select("src", "dst", "weight"), "cycles")
    prev = core.count()
    while prev > 0:
        keep = core.select(F.col("src").alias("id")).distinct().join(core.select(F.col("dst").alias("id")).distinct(), "id")
        whole = core
        core = stored(core.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
                      .join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"), "cycles")
        release(whole)
        n = core.count()
        if n == prev:
            break
        prev = n
    return core


def _key(path: str) -> F.Column:
    """The nodes of a cycle as text, in order from the least node on."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat_ws(">", F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1)))


def _closed(out: DataFrame, back: DataFrame) -> DataFrame:
    """Cycles through ``v`` as (v, key, w): a path out of v meets a path back to it, and they share only
    the node where they meet."""
    both = out.join(back.withColumnsRenamed({"nodes": "_nodes", "w": "_w"}), ["v", "meet"])
    both = both.filter(F.size(F.array_intersect("nodes", "_nodes")) == 1)
    path = F.concat(F.array("v"), F.col("nodes"), F.slice("_nodes", F.lit(2), F.size("_nodes")))
    both = both.select("v", path.alias("p"), (F.col("w") + F.col("_w")).alias("w"))
    return both.select("v", _key("p").alias("key"), "w")


def _short(step: DataFrame, und: DataFrame, names: DataFrame, length: int) -> DataFrame:
    """Cycles of 2 or 3 edges as (v, key, w) for each of their nodes, from the undirected edges and
    their triangles: each cycle is found once, and no paths are kept."""
    if length == 2:
        cycles = und.filter("d = 3").select(F.array("x", "y").alias("q"))
    else:
        has = lambda pair, bit: F.col(pair).bitwiseAND(bit) != 0
        ways = F.array(F.when(has("xy", 1) & has("yz", 1) & has("xz", 2), F.array("x", "y", "z")),
                       F.when(has("xz", 1) & has("yz", 2) & has("xy", 2), F.array("x", "z", "y")))
        cycles = triangles(und).select(F.explode(F.array_compact(ways)).alias("q"))
    for i in range(length):
        cycles = cycles.join(names.select(F.col("n").alias("_n"), F.col("id").alias(f"_{i}")), F.col("q")[i] == F.col("_n")).drop("_n")
    cycles = stored(cycles.select(F.array(*[f"_{i}" for i in range(length)]).alias("p")), "cycles")
    hops = F.array(*[F.struct(F.col("p")[i].alias("src"), F.col("p")[(i + 1) % length].alias("dst")) for i in range(length)])
    weight = cycles.select("p", F.inline(hops)).join(step, ["src", "dst"]).groupBy("p").agg(F.sum("weight").alias("w"))
    return weight.select(F.explode("p").alias("v"), _key("p").alias("key"), "w")


def circular_flows(edges: DataFrame, customers: DataFrame,
                   max_len: int = dims.GRAPH_MAX_CYCLE_LENGTH,
                   max_cycles: int = dims.GRAPH_MAX_CYCLES_PER_NODE) -> DataFrame:
    """Simple directed cycles of length ≤ ``max_len`` through each customer.

    Per node the cycles are ordered by (length, path text from the least node on) and the
    first ``max_cycles`` are counted (our definition, since the reference's choice depends
    on iteration order): has / count / longest / total weight (each edge once per counted
    cycle).  Self-loops are cycles of length 1.

    Lengths are searched one after the other, and only for nodes that have fewer than
    ``max_cycles`` shorter cycles, so a dense graph is done after the first few lengths.
    Cycles of 2 and 3 edges come from the undirected edges and their triangles. A longer one, of
    length L through v, is a path of ceil(L/2) edges out of v and one of the other edges back to v
    that meet: no path is longer than half of ``max_len``, and paths are made when a length needs
    them, from the nodes still searched then.  Nodes that can't lie on any cycle are trimmed first."""
    core = _core(edges)
    step = core.filter(F.col("src") != F.col("dst"))
    ids = customers.select(F.col(K).cast("string").alias("v")).distinct()
    loops = core.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("v"), F.col("src").alias("key"), F.col("weight").alias("w"))
    have = loops.join(ids, "v", "left_semi").withColumn("len", F.lit(1))
    need = ids.join(step.select(F.col("src").alias("v")), "v", "left_semi").join(loops.select("v", F.lit(1).alias("_l")), "v", "left")
    need = stored(need.select("v", (F.lit(max_cycles) - F.coalesce("_l", F.lit(0))).alias("more")).filter(F.col("more") > 0), "cycles")
    lengths = range(2, 2 if need.isEmpty() else max_len + 1)
    if lengths:
        und, names = ordered_edges(step)
    sides = {"out": ("src", "dst", []), "back": ("dst", "src", [])}  # the paths of each number of edges

    def paths(side: str, n: int) -> DataFrame:
        """Paths of ``n`` edges out of v or back to it, (v, meet, nodes, w), for the nodes still needed."""
        here, there, known = sides[side]
        while len(known) < n:
            if not known:
                more = step.join(need, step[here] == need["v"]).select("v", F.col(there).alias("meet"), F.array(there).alias("nodes"), F.col("weight").alias("w"))
            else:
                more = (known[-1].join(need.select("v"), "v", "left_semi").join(step, F.col("meet") == F.col(here))
                        .filter((F.col(there) != F.col("v")) & ~F.array_contains("nodes", F.col(there))))
                nodes = F.concat("nodes", F.array(there)) if side == "out" else F.concat(F.array(there), F.col("nodes"))
                more = more.select("v", F.col(there).alias("meet"), nodes.alias("nodes"), (F.col("w") + F.col("weight")).alias("w"))
            known.append(stored(more, "cycles"))
        return known[n - 1]

    for length in lengths:
        found = _short(step, und, names, length) if length < 4 else _closed(paths("out", (length + 1) // 2), paths("back", length // 2))
        found = found.join(need, "v")
        rank = F.row_number().over(Window.partitionBy("v").orderBy("key"))
        # the limit of every node is at most max_cycles, which Spark applies before rows are dealt
        found = found.withColumn("_r", rank).filter(F.col("_r") <= max_cycles).filter(F.col("_r") <= F.col("more"))
        found = stored(found.select("v", "key", "w", F.lit(length).alias("len")), "cycles")
        have = have.unionByName(found)
        got = found.groupBy("v").agg(F.count("*").alias("_got"))
        need = stored(need.join(got, "v", "left").select("v", (F.col("more") - F.coalesce("_got", F.lit(0))).alias("more"))
                      .filter(F.col("more") > 0), "cycles")
        if need.isEmpty():
            break
    per = have.groupBy("v").agg(F.count("*").alias("num_cycles"), F.max("len").alias("max_cycle_length"),
                                F.sum("w").alias("cycle_total_amount"))
    j = customers.select(K, F.col(K).cast("string").alias("v")).join(per, "v", "left")
    return j.select(
        K,
        F.col("num_cycles").isNotNull().alias("has_circular_flow"),
        F.coalesce("num_cycles", F.lit(0)).cast("long").alias("num_cycles"),
        F.coalesce("max_cycle_length", F.lit(0)).cast("long").alias("max_cycle_length"),
        F.coalesce("cycle_total_amount", F.lit(0.0)).alias("cycle_total_amount"),
    )
