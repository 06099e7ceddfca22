"""The 33 graph columns per customer (every customer kept), and the
network subset the stability index needs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.graph import edges as GE
from driftwatch.operators.graph import flows as GF
from driftwatch.operators.graph import paths as GP

K = "customer_id"

NETWORK_COLS = ["has_circular_flow", "num_cycles", "max_cycle_length", "cycle_total_amount",
                "is_funnel_hub", "in_degree", "out_degree", "funnel_ratio", "total_inflow",
                "total_outflow", "layer_depth", "reachable_nodes", "flow_velocity",
                "avg_retention_hours", "rapid_passthrough_count"]


def network_signals(txns: DataFrame, customers: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """G03 + G04 + G05 + G06 per customer (15 columns).  The edge table feeds
    three operators, so it is computed once and checkpointed."""
    from driftwatch.session import cut_lineage
    e = cut_lineage(edges if edges is not None else GE.build_edges(txns))
    c = customers.select(K)
    circ = GP.circular_flows(e, c)
    flows = GF.degrees_flows(e, c)
    depth = GP.layer_depth(e, c)
    vel = GF.flow_velocity(txns, c)
    return circ.join(flows, K).join(depth, K).join(vel, K).select(K, *NETWORK_COLS)


def all_graph_signals(txns: DataFrame, customers: DataFrame, risk_labels: DataFrame | None = None,
                      temporal_window_days: int = 30, temporal_periods: int = 6) -> DataFrame:
    """Network (15) + centrality (4) + community (4) + temporal (6) + ego (4)."""
    from driftwatch.operators.graph import centrality as GC
    from driftwatch.operators.graph import community as GM
    from driftwatch.operators.graph import ego as GG
    from driftwatch.operators.graph import temporal as GT
    from driftwatch.session import cut_lineage
    e = cut_lineage(GE.build_edges(txns))
    c = customers.select(K)
    base = network_signals(txns, customers, e)
    cen = GC.centrality_signals(e, c)
    com = GM.community_signals(e, c, risk_labels)
    tmp = GT.temporal_signals(txns, e, c, temporal_window_days, temporal_periods)
    ego = GG.ego_signals(e, c)
    return base.join(cen, K).join(com, K).join(tmp, K).join(ego, K)
