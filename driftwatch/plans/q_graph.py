"""Registered graph queries (G01–G06, G14, G19) and their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions.exprs import attach_scalars

from driftwatch.operators.graph import edges as GE
from driftwatch.operators.graph import flows as GF
from driftwatch.operators.graph import paths as GP
from driftwatch.plans.common import prep, rounded
from driftwatch.plans.oracle_views import with_views
from driftwatch.plans.stages import view as V
from driftwatch.sources import tables as TB


def _acct(spark, sf):
    return GE.build_edges(TB.account_txns(spark, sf, V(spark, sf, "tx_orders")))


def q_g01_build_edges(spark, sf):
    prep(spark)
    return rounded(GE.build_edges(TB.supplier_txns(spark, sf, V(spark, sf, "tx_orders"))))


def q_g01_build_edges_native(spark, sf):
    prep(spark)
    return rounded(GE.build_edges(V(spark, sf, "tx_orders")))


def q_g02_nodes(spark, sf):
    prep(spark)
    return GE.build_nodes(_acct(spark, sf), V(spark, sf, "customers_v"))


def q_g03_degrees_flows(spark, sf):
    prep(spark)
    return rounded(GF.degrees_flows(_acct(spark, sf), V(spark, sf, "customers_v")))


def q_g03_degrees_flows_native(spark, sf):
    prep(spark)
    return rounded(GF.degrees_flows(GE.build_edges(V(spark, sf, "tx_orders")), V(spark, sf, "customers_v")))


def q_g04_circular_flows(spark, sf):
    prep(spark)
    return rounded(GP.circular_flows(_acct(spark, sf), V(spark, sf, "customers_v")))


def q_g04_circular_flows_len3(spark, sf):
    prep(spark)
    return rounded(GP.circular_flows(_acct(spark, sf), V(spark, sf, "customers_v"), max_len=3))


def q_g05_layer_depth(spark, sf):
    prep(spark)
    return GP.layer_depth(_acct(spark, sf), V(spark, sf, "customers_v"))


def q_g06_flow_velocity(spark, sf):
    prep(spark)
    return rounded(GF.flow_velocity(V(spark, sf, "tx_orders"), V(spark, sf, "customers_v")))


def q_g06_flow_velocity_events(spark, sf):
    prep(spark)
    return rounded(GF.flow_velocity(V(spark, sf, "tx_events")))


def q_g14_structural_risk(spark, sf):
    prep(spark)
    return GF.structurally_risky(_acct(spark, sf))


def q_g19_top_counterparties(spark, sf):
    prep(spark)
    return rounded(GF.top_counterparties(V(spark, sf, "tx_orders")))


QUERIES = {
    "g01_build_edges": q_g01_build_edges,
    "g01_build_edges_native": q_g01_build_edges_native,
    "g02_nodes": q_g02_nodes,
    "g03_degrees_flows": q_g03_degrees_flows,
    "g03_degrees_flows_native": q_g03_degrees_flows_native,
    "g04_circular_flows": q_g04_circular_flows,
    "g04_circular_flows_len3": q_g04_circular_flows_len3,
    "g05_layer_depth": q_g05_layer_depth,
    "g06_flow_velocity": q_g06_flow_velocity,
    "g06_flow_velocity_events": q_g06_flow_velocity_events,
    "g14_structural_risk": q_g14_structural_risk,
    "g19_top_counterparties": q_g19_top_counterparties,
}

# ----------------------------------------------------------------- DuckDB side
H = 3600000000


def edges_cte(src: str, p: str) -> str:
    return f"""
{p}edges AS (
  SELECT CAST(customer_id AS VARCHAR) AS src, counterparty AS dst, sum(amount) AS weight,
         CAST(count(*) AS BIGINT) AS "count", min(ts_us) AS first_us, max(ts_us) AS last_us
  FROM {src} WHERE counterparty IS NOT NULL AND counterparty NOT IN ('', 'None', 'nan') GROUP BY 1, 2
)"""


def flows_cte(p: str) -> str:
    """needs {p}edges; ends in {p}flows per customer of customers_v."""
    return f"""
{p}outd AS (SELECT src AS id, count(*) AS out_degree, sum(weight) AS total_outflow FROM {p}edges GROUP BY 1),
{p}ind AS (SELECT dst AS id, count(*) AS in_degree, sum(weight) AS total_inflow FROM {p}edges GROUP BY 1),
{p}deg AS (
  SELECT coalesce(o.id, i.id) AS id, CAST(coalesce(in_degree, 0) AS BIGINT) AS in_degree,
         CAST(coalesce(out_degree, 0) AS BIGINT) AS out_degree,
         coalesce(total_inflow, 0) AS total_inflow, coalesce(total_outflow, 0) AS total_outflow
  FROM {p}outd o FULL JOIN {p}ind i ON o.id = i.id
),
{p}flows AS (
  SELECT c.customer_id,
    coalesce((in_degree >= 4 AND out_degree <= 2) OR (out_degree >= 4 AND in_degree <= 2), false) AS is_funnel_hub,
    coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree,
    CASE WHEN d.id IS NULL THEN 0.0 ELSE greatest(in_degree, out_degree) / (least(in_degree, out_degree) + 1) END AS funnel_ratio,
    coalesce(total_inflow, 0) AS total_inflow, coalesce(total_outflow, 0) AS total_outflow
  FROM customers_v c LEFT JOIN {p}deg d ON CAST(c.customer_id AS VARCHAR) = d.id
)"""


def depth_cte(p: str, cutoff: int = 10) -> str:
    """needs {p}edges; ends in {p}depth per customer."""
    return f"""
{p}e2 AS (SELECT DISTINCT src, dst FROM {p}edges WHERE src <> dst),
{p}bfs AS (
  WITH RECURSIVE r(root, node, d) USING KEY (root, node) AS (
    SELECT src, dst, 1 FROM {p}e2 WHERE src IN (SELECT CAST(customer_id AS VARCHAR) FROM customers_v)
    UNION
    SELECT r.root, e.dst, min(r.d) + 1 FROM r JOIN {p}e2 e ON r.node = e.src
    WHERE r.d < {cutoff} AND e.dst <> r.root
      AND NOT EXISTS (SELECT 1 FROM recurring.r s WHERE s.root = r.root AND s.node = e.dst)
    GROUP BY 1, 2
  )
  SELECT root, node, d FROM r
),
{p}dper AS (SELECT root, max(d) AS layer_depth, count(*) AS reachable_nodes FROM {p}bfs GROUP BY 1),
{p}depth AS (
  SELECT c.customer_id, CAST(coalesce(layer_depth, 0) AS BIGINT) AS layer_depth,
         CAST(coalesce(reachable_nodes, 0) AS BIGINT) AS reachable_nodes
  FROM customers_v c LEFT JOIN {p}dper d ON CAST(c.customer_id AS VARCHAR) = d.root
)"""


def velocity_cte(src: str, base: str, p: str) -> str:
    """ends in {p}vel per customer of ``base`` (a relation with customer_id)."""
    return f"""
{p}dep AS (SELECT customer_id, transaction_id, ts_us FROM {src} WHERE transaction_type = 'deposit'),
{p}wd AS (SELECT customer_id, ts_us FROM {src} WHERE transaction_type = 'withdrawal'),
{p}m AS (
  SELECT d.customer_id, d.transaction_id, (min(w.ts_us) - d.ts_us) / {H}.0 AS h
  FROM {p}dep d JOIN {p}wd w ON d.customer_id = w.customer_id AND w.ts_us > d.ts_us
  GROUP BY d.customer_id, d.transaction_id, d.ts_us
),
{p}agg AS (SELECT customer_id, avg(h) AS avg_h, count(*) FILTER (WHERE h < 72) AS rapid FROM {p}m GROUP BY 1),
{p}n AS (SELECT customer_id, count(*) AS n FROM {src} GROUP BY 1),
{p}vel AS (
  SELECT b.customer_id,
    CASE WHEN n.n >= 2 AND a.avg_h IS NOT NULL THEN 1.0 / (a.avg_h + 1.0) ELSE 0.0 END AS flow_velocity,
    CASE WHEN n.n >= 2 AND a.avg_h IS NOT NULL THEN a.avg_h ELSE 999999.0 END AS avg_retention_hours,
    CAST(CASE WHEN n.n >= 2 AND a.avg_h IS NOT NULL THEN a.rapid ELSE 0 END AS BIGINT) AS rapid_passthrough_count
  FROM {base} b LEFT JOIN {p}n n USING (customer_id) LEFT JOIN {p}agg a USING (customer_id)
)"""


def cycles3_cte(p: str) -> str:
    """needs {p}edges; cycles of length ≤ 3 rooted at their least node; ends in {p}circ."""
    return f"""
{p}ce AS (SELECT src, dst, weight FROM {p}edges),
{p}cyc AS (
  SELECT [src] AS path, weight AS w FROM {p}ce WHERE src = dst
  UNION ALL
  SELECT [a.src, a.dst], a.weight + b.weight FROM {p}ce a JOIN {p}ce b ON a.dst = b.src AND b.dst = a.src
  WHERE a.src < a.dst
  UNION ALL
  SELECT [a.src, a.dst, b.dst], a.weight + b.weight + c.weight
  FROM {p}ce a JOIN {p}ce b ON a.dst = b.src JOIN {p}ce c ON b.dst = c.src AND c.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst
),
{p}mem AS (SELECT unnest(path) AS id, len(path) AS ln, array_to_string(path, '>') AS k, w FROM {p}cyc),
{p}top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ln, k) AS r FROM {p}mem),
{p}cper AS (SELECT id, count(*) AS num_cycles, max(ln) AS mx, sum(w) AS tot FROM {p}top WHERE r <= 20 GROUP BY 1),
{p}circ AS (
  SELECT c.customer_id, (cp.num_cycles IS NOT NULL) AS has_circular_flow,
         CAST(coalesce(cp.num_cycles, 0) AS BIGINT) AS num_cycles,
         CAST(coalesce(cp.mx, 0) AS BIGINT) AS max_cycle_length,
         coalesce(cp.tot, 0.0) AS cycle_total_amount
  FROM customers_v c LEFT JOIN {p}cper cp ON CAST(c.customer_id AS VARCHAR) = cp.id
)"""


FLOW_OUT = "customer_id, is_funnel_hub, in_degree, out_degree, round(funnel_ratio, 6) AS funnel_ratio, round(total_inflow, 6) AS total_inflow, round(total_outflow, 6) AS total_outflow"
VEL_OUT = "customer_id, round(flow_velocity, 6) AS flow_velocity, round(avg_retention_hours, 6) AS avg_retention_hours, rapid_passthrough_count"
EDGE_OUT = 'src, dst, round(weight, 6) AS weight, "count", first_us, last_us'

ORACLES = {
    "g01_build_edges": with_views("," + edges_cte("supplier_txns", "g_") + f"\nSELECT {EDGE_OUT} FROM g_edges"),
    "g01_build_edges_native": with_views("," + edges_cte("tx_orders", "g_") + f"\nSELECT {EDGE_OUT} FROM g_edges"),
    "g02_nodes": with_views("," + edges_cte("account_txns", "g_") + """,
ends AS (SELECT src AS id, 2 AS t FROM g_edges UNION ALL SELECT dst, 1 FROM g_edges
         UNION ALL SELECT CAST(customer_id AS VARCHAR), 2 FROM customers_v)
SELECT id, CASE WHEN max(t) = 2 THEN 'customer' ELSE 'counterparty' END AS node_type FROM ends GROUP BY id
"""),
    "g03_degrees_flows": with_views("," + edges_cte("account_txns", "g_") + "," + flows_cte("g_")
                                    + f"\nSELECT {FLOW_OUT} FROM g_flows"),
    "g03_degrees_flows_native": with_views("," + edges_cte("tx_orders", "g_") + "," + flows_cte("g_")
                                           + f"\nSELECT {FLOW_OUT} FROM g_flows"),
    "g04_circular_flows_len3": with_views("," + edges_cte("account_txns", "g_") + "," + cycles3_cte("g_") + """
SELECT customer_id, has_circular_flow, num_cycles, max_cycle_length, round(cycle_total_amount, 6) AS cycle_total_amount FROM g_circ
"""),
    "g05_layer_depth": with_views("," + edges_cte("account_txns", "g_") + "," + depth_cte("g_")
                                  + "\nSELECT * FROM g_depth"),
    "g06_flow_velocity": with_views("," + velocity_cte("tx_orders", "customers_v", "v_") + f"\nSELECT {VEL_OUT} FROM v_vel"),
    "g06_flow_velocity_events": with_views(", ev_ids AS (SELECT DISTINCT customer_id FROM tx_events),"
                                           + velocity_cte("tx_events", "ev_ids", "v_") + f"\nSELECT {VEL_OUT} FROM v_vel"),
    "g14_structural_risk": with_views("," + edges_cte("account_txns", "g_") + "," + flows_cte("g_") + """
SELECT id, ((in_degree >= 4 AND out_degree <= 2) OR (out_degree >= 4 AND in_degree <= 2) OR in_degree + out_degree >= 12) AS is_risky
FROM g_deg
"""),
    "g19_top_counterparties": with_views(""",
v AS (SELECT * FROM tx_orders WHERE counterparty IS NOT NULL AND counterparty <> ''),
g AS (
  SELECT customer_id, substr(counterparty, 1, 20) AS counterparty,
    sum(CASE WHEN transaction_type = 'deposit' THEN amount ELSE 0 END) AS inflow,
    sum(CASE WHEN transaction_type <> 'deposit' THEN amount ELSE 0 END) AS outflow,
    CAST(count(*) AS BIGINT) AS txn_count,
    arg_min(country, (ts_us, transaction_id)) AS country,
    arg_min(method, (ts_us, transaction_id)) AS method
  FROM v GROUP BY 1, 2
),
r AS (SELECT *, inflow + outflow AS volume,
             row_number() OVER (PARTITION BY customer_id ORDER BY inflow + outflow DESC, counterparty) AS rank FROM g)
SELECT customer_id, counterparty, round(inflow, 6) AS inflow, round(outflow, 6) AS outflow, txn_count, country, method,
       round(volume, 6) AS volume, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 30
"""),
}


# ------------------------------------------------------------ G15–G17
from driftwatch.operators.graph import ego as GG  # noqa: E402
from driftwatch.operators.graph import temporal as GT  # noqa: E402

EV_WINDOW_DAYS, EV_PERIODS = 5, 6   # FIXTURES §2: G15 on tx_events at 5 days × 6


def q_g15_temporal_snapshots(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_events")
    snap = GT.temporal_snapshots(t, EV_WINDOW_DAYS, EV_PERIODS)
    return GT.dense_snapshots(snap, GE.graph_nodes(GE.build_edges(t)), EV_PERIODS)


def q_g16_temporal_signals(spark, sf):
    prep(spark)
    t = V(spark, sf, "tx_events")
    users = t.select("customer_id").distinct()
    return rounded(GT.temporal_signals(t, None, users, EV_WINDOW_DAYS, EV_PERIODS))


def q_g16_temporal_signals_orders(spark, sf):
    prep(spark)
    return rounded(GT.temporal_signals(V(spark, sf, "tx_orders"), None, V(spark, sf, "customers_v"), 180, 6))


def q_g17_ego_signals(spark, sf):
    prep(spark)
    return rounded(GG.ego_signals(_acct(spark, sf), V(spark, sf, "customers_v")))


QUERIES.update({
    "g15_temporal_snapshots": q_g15_temporal_snapshots,
    "g16_temporal_signals": q_g16_temporal_signals,
    "g16_temporal_signals_orders": q_g16_temporal_signals_orders,
    "g17_ego_signals": q_g17_ego_signals,
})


def snapshots_cte(src: str, w_days: int, periods: int, p: str) -> str:
    w = w_days * 86400000000
    return f"""
{p}v AS (SELECT CAST(customer_id AS VARCHAR) AS src, counterparty AS dst, ts_us FROM {src}
        WHERE counterparty IS NOT NULL AND counterparty NOT IN ('', 'None', 'nan')),
{p}mx AS (SELECT max(ts_us) AS m FROM {p}v),
{p}e0 AS (SELECT DISTINCT src, dst, CAST({periods - 1} - (ceil((m - ts_us) / {w}) - 1) AS INTEGER) AS period
          FROM {p}v, {p}mx WHERE ts_us < m),
{p}e AS (SELECT * FROM {p}e0 WHERE period >= 0 AND period < {periods}),
{p}nw AS (SELECT * FROM {p}e x WHERE NOT EXISTS
          (SELECT 1 FROM {p}e y WHERE y.src = x.src AND y.dst = x.dst AND y.period = x.period - 1)),
{p}deg AS (SELECT id, period, count(*) AS degree FROM
           (SELECT src AS id, period FROM {p}e UNION ALL SELECT dst, period FROM {p}e) GROUP BY 1, 2),
{p}nn AS (SELECT id, period, count(*) AS new_edges FROM
          (SELECT src AS id, period FROM {p}nw UNION ALL SELECT dst, period FROM {p}nw) GROUP BY 1, 2),
{p}snap AS (SELECT coalesce(d.id, n.id) AS id, coalesce(d.period, n.period) AS period,
                   coalesce(degree, 0) AS degree, coalesce(new_edges, 0) AS new_edges
            FROM {p}deg d FULL JOIN {p}nn n ON d.id = n.id AND d.period = n.period)"""


def temporal_sig_cte(p: str, periods: int) -> str:
    ps = range(periods)
    piv = ", ".join(f"CAST(coalesce(max(degree) FILTER (WHERE period = {i}), 0) AS DOUBLE) AS d{i}, "
                    f"CAST(coalesce(max(new_edges) FILTER (WHERE period = {i}), 0) AS DOUBLE) AS n{i}" for i in ps)
    xbar = (periods - 1) / 2
    sxx = sum((i - xbar) ** 2 for i in ps)
    slope = " + ".join(f"({(i - xbar) / sxx!r}) * d{i}" for i in ps)
    mean_n = "(" + " + ".join(f"n{i}" for i in ps) + f") / {periods}"
    std_n = "sqrt((" + " + ".join(f"(n{i} - {mean_n}) * (n{i} - {mean_n})" for i in ps) + f") / {periods})"
    mx = "greatest(" + ", ".join(f"d{i} - d{i - 1}" for i in list(ps)[1:]) + ")"
    whens = []
    for i in list(ps)[1:]:
        below_any = " OR ".join(f"d{j} <= 3" for j in range(i))
        last = "CASE " + " ".join(f"WHEN d{j} <= 3 THEN {i - j}" for j in reversed(range(i))) + " END"
        whens.append(f"WHEN d{i} >= 8 AND ({below_any}) THEN {last}")
    hub = "CASE " + " ".join(whens) + " ELSE 0 END"
    act = "greatest(" + ", ".join(f"d{i}" for i in ps) + ") > 0"
    return f"""
{p}piv AS (SELECT id, {piv} FROM {p}snap GROUP BY id),
{p}sig AS (
  SELECT id,
    CAST(CASE WHEN {act} THEN n{periods - 1} ELSE 0 END AS BIGINT) AS new_counterparties_last_window,
    CASE WHEN {act} THEN {mean_n} ELSE 0 END AS avg_new_counterparties_per_window,
    CAST(CASE WHEN {act} THEN {mx} ELSE 0 END AS BIGINT) AS max_degree_change,
    CASE WHEN {act} THEN {slope} ELSE 0 END AS degree_trend_slope,
    CAST(CASE WHEN {act} THEN {hub} ELSE 0 END AS BIGINT) AS hub_emergence_speed,
    CASE WHEN {act} THEN {std_n} ELSE 0 END AS edge_volatility
  FROM {p}piv)"""


TEMP_OUT = ("customer_id, coalesce(new_counterparties_last_window, 0) AS new_counterparties_last_window, "
            "round(coalesce(avg_new_counterparties_per_window, 0), 6) AS avg_new_counterparties_per_window, "
            "coalesce(max_degree_change, 0) AS max_degree_change, round(coalesce(degree_trend_slope, 0), 6) AS degree_trend_slope, "
            "coalesce(hub_emergence_speed, 0) AS hub_emergence_speed, round(coalesce(edge_volatility, 0), 6) AS edge_volatility")

EGO_SQL = """
x_e AS (SELECT DISTINCT src, dst FROM g_edges),
x_succ AS (SELECT src AS c, dst AS u FROM x_e WHERE src <> dst),
x_mem AS (SELECT c, u AS x FROM x_succ UNION SELECT DISTINCT c, c FROM x_succ),
x_k AS (SELECT c, count(*) AS k FROM x_succ GROUP BY 1),
x_m AS (SELECT m1.c, count(*) AS m FROM x_mem m1 JOIN x_e e ON e.src = m1.x
        JOIN x_mem m2 ON m2.c = m1.c AND m2.x = e.dst GROUP BY 1),
x_und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM x_e WHERE src <> dst),
x_T AS (SELECT s1.c, count(*) AS t FROM x_succ s1 JOIN x_und ON x_und.a = s1.u
        JOIN x_succ s2 ON s2.c = s1.c AND s2.u = x_und.b GROUP BY 1),
x_deg AS (SELECT m1.c, m1.x, count(*) AS d FROM x_mem m1 JOIN x_und ON x_und.a = m1.x OR x_und.b = m1.x
          JOIN x_mem m2 ON m2.c = m1.c AND m2.x = (CASE WHEN x_und.a = m1.x THEN x_und.b ELSE x_und.a END)
          GROUP BY 1, 2),
x_triads AS (SELECT c, sum(d * (d - 1) / 2) AS triads FROM x_deg GROUP BY 1),
x_tri AS (SELECT m1.c, count(*) AS tri FROM x_mem m1 JOIN x_mem m2 ON m2.c = m1.c AND m2.x > m1.x
          JOIN x_mem m3 ON m3.c = m1.c AND m3.x > m2.x
          JOIN x_und u1 ON u1.a = m1.x AND u1.b = m2.x
          JOIN x_und u2 ON u2.a = m2.x AND u2.b = m3.x
          JOIN x_und u3 ON u3.a = m1.x AND u3.b = m3.x GROUP BY 1),
x_sig AS (
  SELECT k.c, k.k, coalesce(m.m, 0) / ((k.k + 1) * k.k) AS ego_density,
    CASE WHEN k.k >= 2 THEN 2 * coalesce(t.t, 0) / (k.k * (k.k - 1)) ELSE 0 END AS ego_clustering_coeff,
    CASE WHEN k.k + 1 >= 3 AND coalesce(tr.tri, 0) > 0 THEN 3 * tr.tri / td.triads ELSE 0 END AS ego_triadic_closure
  FROM x_k k LEFT JOIN x_m m USING (c) LEFT JOIN x_T t USING (c) LEFT JOIN x_tri tr USING (c) LEFT JOIN x_triads td USING (c)
)
SELECT cv.customer_id, round(coalesce(ego_density, 0), 6) AS ego_density,
  round(coalesce(ego_clustering_coeff, 0), 6) AS ego_clustering_coeff,
  round(coalesce(ego_triadic_closure, 0), 6) AS ego_triadic_closure, CAST(coalesce(k, 0) AS BIGINT) AS ego_size
FROM customers_v cv LEFT JOIN x_sig ON CAST(cv.customer_id AS VARCHAR) = x_sig.c
"""

ORACLES.update({
    "g15_temporal_snapshots": with_views("," + edges_cte("tx_events", "g_") + ","
                                         + snapshots_cte("tx_events", EV_WINDOW_DAYS, EV_PERIODS, "t_") + """,
nodes AS (SELECT src AS id FROM g_edges UNION SELECT dst FROM g_edges),
grid AS (SELECT id, CAST(unnest(range(0, 6)) AS INTEGER) AS period FROM nodes)
SELECT g.id, g.period, CAST(coalesce(s.degree, 0) AS BIGINT) AS degree, CAST(coalesce(s.new_edges, 0) AS BIGINT) AS new_edges
FROM grid g LEFT JOIN t_snap s ON s.id = g.id AND s.period = g.period
"""),
    "g16_temporal_signals": with_views("," + snapshots_cte("tx_events", EV_WINDOW_DAYS, EV_PERIODS, "t_") + ","
                                       + temporal_sig_cte("t_", EV_PERIODS) + f""",
u AS (SELECT DISTINCT customer_id FROM tx_events)
SELECT {TEMP_OUT} FROM u LEFT JOIN t_sig ON CAST(u.customer_id AS VARCHAR) = t_sig.id
"""),
    "g16_temporal_signals_orders": with_views("," + snapshots_cte("tx_orders", 180, 6, "t_") + ","
                                              + temporal_sig_cte("t_", 6) + f"""
SELECT {TEMP_OUT} FROM customers_v u LEFT JOIN t_sig ON CAST(u.customer_id AS VARCHAR) = t_sig.id
"""),
    "g17_ego_signals": with_views("," + edges_cte("account_txns", "g_") + "," + EGO_SQL),
})


# ------------------------------------------------------------ G07–G13
from driftwatch.operators.graph import centrality as GC  # noqa: E402
from driftwatch.operators.graph import community as GM  # noqa: E402


def q_g07_pagerank(spark, sf):
    prep(spark)
    return rounded(GC.pagerank(_acct(spark, sf)))


def q_g08_betweenness(spark, sf):
    """Exact (n ≤ 300 pivots) weighted betweenness on the events graph."""
    prep(spark)
    return rounded(GC.betweenness(GE.build_edges(V(spark, sf, "tx_events"))))


def q_g08_betweenness_accounts(spark, sf):
    """G08 from 300 pivots on the account graph of all lines."""
    prep(spark)
    return rounded(GC.betweenness(_acct(spark, sf)))


def q_g09_hits(spark, sf):
    prep(spark)
    return rounded(GC.hits(GE.build_edges(V(spark, sf, "tx_orders"))))


def account_communities(spark, sf):
    """G10 stage output over all transfer lines: labels with the modularity, computed once per application."""
    from driftwatch.plans.stages import stage

    def build():
        lab, q = GM.communities(_acct(spark, sf))
        return attach_scalars(lab, q)
    return stage(spark, sf, "communities", build)


def q_g10_communities(spark, sf):
    prep(spark)
    return account_communities(spark, sf).withColumn("modularity", F.round("modularity", 6))


def q_g12_community_signals(spark, sf):
    prep(spark)
    e = _acct(spark, sf)
    c = V(spark, sf, "customers_v")
    risky = GM.resolve_risk_labels(c.withColumn("is_sar", F.col("is_suspicious")), e)
    return rounded(GM.community_signals(e, c, risky, labels=account_communities(spark, sf).select("id", "community")))


def q_g13_risk_labels(spark, sf):
    prep(spark)
    # numeric branch: 85th percentile of a per-customer score (total volume)
    c = V(spark, sf, "customers_v").join(
        V(spark, sf, "tx_orders").groupBy("customer_id").agg(F.sum("amount").alias("risk_score")), "customer_id")
    return GM.resolve_risk_labels(c, _acct(spark, sf))


QUERIES.update({
    "g07_pagerank": q_g07_pagerank,
    "g08_betweenness": q_g08_betweenness,
    "g08_betweenness_accounts": q_g08_betweenness_accounts,
    "g09_hits": q_g09_hits,
    "g10_communities": q_g10_communities,
    "g12_community_signals": q_g12_community_signals,
    "g13_risk_labels": q_g13_risk_labels,
})

ORACLES["g13_risk_labels"] = with_views(""",
rs AS (SELECT customer_id, sum(amount) AS risk_score FROM tx_orders GROUP BY 1),
c AS (SELECT cv.customer_id, rs.risk_score FROM customers_v cv JOIN rs USING (customer_id)),
t AS (SELECT quantile_cont(risk_score, 0.85) AS thr FROM c)
SELECT CAST(customer_id AS VARCHAR) AS id, risk_score >= thr AS is_risky FROM c CROSS JOIN t
""")


def q_g18_all_graph_signals(spark, sf):
    """All 33 graph columns per user of the events graph (every user kept)."""
    prep(spark)
    from driftwatch.operators.graph import signals as GS
    t = V(spark, sf, "tx_events")
    users = t.select("customer_id").distinct()
    return rounded(GS.all_graph_signals(t, users, temporal_window_days=EV_WINDOW_DAYS, temporal_periods=EV_PERIODS))


QUERIES["g18_all_graph_signals"] = q_g18_all_graph_signals


# keys from when the others read a part of the lines
for _key in ("g02_nodes", "g03_degrees_flows", "g14_structural_risk"):
    QUERIES[_key + "_all"], ORACLES[_key + "_all"] = QUERIES[_key], ORACLES[_key]
