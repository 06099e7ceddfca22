"""Small graphs with known answers, and random ones against brute force."""
import pytest

from driftwatch.operators.graph import paths as GP
from driftwatch.operators.graph import flows as GF


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def _cust(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "customer_id long")


def test_layer_depth_path_and_cycle(spark):
    e = _edges(spark, [("1", "2"), ("2", "3"), ("3", "4"), ("4", "2"), ("5", "5")])
    got = {r["customer_id"]: (r["layer_depth"], r["reachable_nodes"])
           for r in GP.layer_depth(e, _cust(spark, [1, 2, 5, 9])).collect()}
    assert got == {1: (3, 3), 2: (2, 2), 5: (0, 0), 9: (0, 0)}


def test_cycles(spark):
    # triangle 1->2->3->1, reciprocal pair 1<->4, self-loop 5
    e = _edges(spark, [("1", "2"), ("2", "3"), ("3", "1"), ("1", "4"), ("4", "1"), ("5", "5"), ("3", "6")])
    got = {r["customer_id"]: (r["num_cycles"], r["max_cycle_length"], r["cycle_total_amount"])
           for r in GP.circular_flows(e, _cust(spark, [1, 2, 4, 5, 6])).collect()}
    assert got[1] == (2, 3, 5.0)
    assert got[2] == (1, 3, 3.0)
    assert got[4] == (1, 2, 2.0)
    assert got[5] == (1, 1, 1.0)
    assert got[6] == (0, 0, 0.0)


def test_funnel_star(spark):
    e = _edges(spark, [("1", x) for x in "abcd"])
    r = GF.degrees_flows(e, _cust(spark, [1])).collect()[0]
    assert r["is_funnel_hub"] and r["out_degree"] == 4 and r["funnel_ratio"] == 4.0


def _random_edges(n, p, seed):
    import random
    rng = random.Random(seed)
    return [(f"{a}", f"{b}", float(rng.randint(1, 50))) for a in range(n) for b in range(n) if rng.random() < p]


def _cycles_ref(edges, max_len, max_cycles):
    """Per node the first cycles through it by (length, path from the least node on)."""
    out = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
    found = []

    def walk(path, w):
        for b, x in out.get(path[-1], {}).items():
            if b == path[0]:
                found.append((len(path), ">".join(path), path, w + x))
            elif b > path[0] and b not in path and len(path) < max_len:
                walk([*path, b], w + x)
    for a in out:
        walk([a], 0.0)
    per = {}
    for length, _, path, w in sorted(found):
        for v in path:
            rows = per.setdefault(v, [])
            if len(rows) < max_cycles:
                rows.append((length, w))
    return {v: (len(r), max(n for n, _ in r), sum(w for _, w in r)) for v, r in per.items()}


@pytest.mark.parametrize("n, p, max_len, max_cycles", [(12, 0.12, 8, 20), (12, 0.3, 8, 20), (30, 0.05, 8, 4), (9, 0.5, 5, 1), (20, 0.15, 3, 20)])
def test_cycles_equal_brute_force(spark, n, p, max_len, max_cycles):
    edges = _random_edges(n, p, seed=n + max_len)
    e = spark.createDataFrame(edges, "src string, dst string, weight double").repartition(3)
    got = {r["customer_id"]: (r["num_cycles"], r["max_cycle_length"], r["cycle_total_amount"])
           for r in GP.circular_flows(e, _cust(spark, range(n + 2)), max_len, max_cycles).collect()}
    want = _cycles_ref(edges, max_len, max_cycles)
    for v in range(n + 2):
        assert got[v] == pytest.approx(want.get(str(v), (0, 0, 0.0))), v


def test_short_cycles_without_paths(spark, monkeypatch):
    """Cycles of up to three edges join no paths; before, each path of two edges was written."""
    def closed(*_):
        raise AssertionError("paths joined")
    monkeypatch.setattr(GP, "_closed", closed)
    edges = _random_edges(10, 0.3, seed=2)
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    want = _cycles_ref(edges, 3, 20)
    for r in GP.circular_flows(e, _cust(spark, range(10)), max_len=3).collect():
        assert (r["num_cycles"], r["max_cycle_length"], r["cycle_total_amount"]) == pytest.approx(want.get(str(r["customer_id"]), (0, 0, 0.0)))


@pytest.mark.parametrize("batch_rows", [200_000_000, 90])
def test_layer_depth_equals_breadth_first_search(spark, batch_rows):
    n = 200  # four words of searches
    edges = _random_edges(n, 0.012, seed=3) + [(f"{n + i}", f"{n + i + 1}", 1.0) for i in range(15)]
    out = {}
    for a, b, _ in edges:
        out.setdefault(int(a), set()).add(int(b))
    want = {}
    for root in range(n + 17):
        seen, front, d = {root}, {root}, 0
        while front and d < 10:
            front = {b for a in front for b in out.get(a, ())} - seen
            if front:
                seen, d = seen | front, d + 1
        want[root] = (d, len(seen) - 1)
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r["customer_id"]: (r["layer_depth"], r["reachable_nodes"]) for r in GP.layer_depth(e, _cust(spark, range(n + 17)), batch_rows=batch_rows).collect()}
    assert got == want


def test_layer_depth_without_search_where_one_step_ends(spark, monkeypatch):
    """Customers who only meet outside counterparties need no search; one who meets a customer does."""
    pairs = [(str(i), f"s{j}") for i in range(100) for j in range(i % 7 + 1)] + [("3", "3")]
    want = {i: (1, i % 7 + 1) for i in range(100)} | {100: (0, 0)}
    searched = []
    reached = GP._reached
    monkeypatch.setattr(GP, "_reached", lambda e, start, cutoff: searched.append(start.count()) or reached(e, start, cutoff))
    got = lambda p: {r["customer_id"]: (r["layer_depth"], r["reachable_nodes"])
                     for r in GP.layer_depth(_edges(spark, p), _cust(spark, range(101))).collect()}
    assert got(pairs) == want and not searched
    assert got([*pairs, ("5", "6")]) == want | {5: (2, 8)} and searched == [1]


def test_hub_of_triangles(spark):
    """Ego signals against the definition, with a node that all others point to and from."""
    from driftwatch.operators.graph import ego as GG
    edges = {(a, b) for a, b, _ in _random_edges(16, 0.2, seed=8)} | {("0", str(i)) for i in range(16)} | {(str(i), "0") for i in range(1, 9)}
    got = {str(r["customer_id"]): r for r in GG.ego_signals(_edges(spark, sorted(edges)), _cust(spark, range(17))).collect()}
    for c in map(str, range(17)):
        s = {b for a, b in edges if a == c and b != c}
        inside = s | {c}
        und = {frozenset(e) for e in edges if e[0] != e[1] and set(e) <= inside}
        k = len(s)
        t = sum(c not in e for e in und)
        deg = {v: sum(v in e for e in und) for v in inside}
        tri = sum(all(frozenset(p) in und for p in ((x, y), (y, z), (x, z))) for x in inside for y in inside for z in inside if x < y < z)
        triads = sum(d * (d - 1) / 2 for d in deg.values())
        r = got[c]
        assert r["ego_size"] == k
        assert r["ego_density"] == pytest.approx(sum(set(e) <= inside for e in edges) / ((k + 1) * k) if k else 0.0)
        assert r["ego_clustering_coeff"] == pytest.approx(2 * t / (k * (k - 1)) if k >= 2 else 0.0)
        assert r["ego_triadic_closure"] == pytest.approx(3 * tri / triads if tri else 0.0)


def test_pairs_of_neighbours_are_not_shuffled(spark):
    """A triangle is found where an edge meets its end's list; before, each pair of neighbours was dealt by both nodes."""
    from driftwatch.operators.graph import ego as GG
    edges = _random_edges(16, 0.3, seed=5)
    found = GG.triangles(GG.ordered_edges(_edges(spark, [e[:2] for e in edges]))[0])
    und = {frozenset(e[:2]) for e in edges if e[0] != e[1]}
    nodes = sorted({x for e in und for x in e})
    assert found.count() == sum({frozenset((a, b)), frozenset((a, c)), frozenset((b, c))} <= und for a in nodes for b in nodes for c in nodes if a < b < c)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "(y#" in plan.split("Join Inner, ")[1].split("\n")[0] and "AND" not in plan.split("Join Inner, ")[1].split("\n")[0]
