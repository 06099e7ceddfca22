"""DuckDB text of the canonical views, used as CTEs by the oracle queries.

Written independently of the Spark code in ``sources.tables`` (same rules,
different engine), so a mismatch in the driver's check points at a real bug.
Constants come from ``functions.dims``.
"""
from __future__ import annotations

from driftwatch.functions import dims


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _case_map(expr: str, mapping: dict, default: str, raw: bool = False) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {v if raw or not isinstance(v, str) else _q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def views() -> str:
    nation_country = _list(dims.NATION_COUNTRY)
    methods = _list(dims.METHODS)
    exchanges = _list(dims.CRYPTO_EXCHANGES)
    assets = _list(dims.CRYPTO_ASSETS)
    cur_of = _case_map("{c}", dims.COUNTRY_CURRENCY_MAP, _q(dims.DEFAULT_CURRENCY))
    fx = _case_map("{c}", {k: f"CAST({v} AS DOUBLE)" for k, v in dims.FX_RATES.items()}, "CAST(1.0 AS DOUBLE)", raw=True)
    crypto_rate = _case_map("{c}", {k: f"CAST({v} AS DOUBLE)" for k, v in dims.CRYPTO_RATES_USD.items()}, "CAST(1.0 AS DOUBLE)", raw=True)
    gray = _list(dims.GRAY_AREA_PROFILES)
    ev_country = _list(dims.EVENT_COUNTRY)
    dep_types = ", ".join(_q(t) for t in dims.EVENT_DEPOSIT_TYPES)
    return f"""
tx_base AS (
  SELECT l.*, o.o_custkey, s.s_name, s.s_nationkey,
         ({nation_country})[s.s_nationkey + 1] AS country0,
         (l.l_partkey % 6 = 5) AS is_crypto,
         CASE WHEN l.l_partkey % 6 = 5 THEN ({assets})[(l.l_suppkey % 3) + 1] END AS asset0,
         (CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT)) + 50) // 100 AS cents0
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
tx_c AS (
  SELECT *,
         CASE WHEN l_partkey % 20 = 0 THEN ((cents0 + 5000) // 10000) * 10000 ELSE cents0 END AS cents,
         CASE asset0 WHEN 'BTC' THEN 65000 WHEN 'ETH' THEN 3400 ELSE 1 END AS rate_int,
         epoch_us(l_shipdate) + (l_partkey % 24) * 3600000000 + (l_suppkey % 60) * 60000000 AS ts_us0
  FROM tx_base
),
tx_orders AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
              CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS transaction_id,
    o_custkey AS customer_id,
    make_timestamp(ts_us0) AS transaction_date,
    ts_us0 AS ts_us,
    CASE WHEN l_linestatus = 'O' THEN 'deposit' ELSE 'withdrawal' END AS transaction_type,
    CASE WHEN is_crypto THEN CAST((cents * 1000000 + rate_int // 2) // rate_int AS DOUBLE) / 1e8
         ELSE CAST(cents AS DOUBLE) / 100 END AS amount,
    CASE WHEN is_crypto THEN asset0 ELSE {cur_of.format(c='country0')} END AS currency,
    CASE WHEN is_crypto THEN {crypto_rate.format(c='asset0')}
         ELSE {fx.format(c=cur_of.format(c='country0'))} END AS usd_rate,
    ({methods})[(l_partkey % 6) + 1] AS method,
    CASE WHEN is_crypto THEN ({exchanges})[(l_suppkey % 10) + 1] ELSE 'branch_' || CAST(l_suppkey % 20 AS VARCHAR) END AS location,
    CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 13 = 1 THEN '' ELSE s_name END AS counterparty,
    country0 AS country,
    asset0 AS crypto_asset,
    l_partkey AS src_partkey, l_suppkey AS src_suppkey, l_linenumber AS src_linenumber,
    l_quantity AS src_quantity, l_extendedprice AS src_price
  FROM tx_c
),
tx_events AS (
  SELECT
    CAST(event_id AS VARCHAR) AS transaction_id,
    user_id AS customer_id,
    ts AS transaction_date,
    epoch_us(ts) AS ts_us,
    CASE WHEN event_type IN ({dep_types}) THEN 'deposit' ELSE 'withdrawal' END AS transaction_type,
    round(value * 100, 2) AS amount,
    'USD' AS currency,
    CAST(1.0 AS DOUBLE) AS usd_rate,
    ({methods})[(event_id % 6) + 1] AS method,
    'branch_' || CAST(event_id % 20 AS VARCHAR) AS location,
    CASE WHEN event_type <> 'error' THEN 'cp' || json_extract_string(props, '$.k') END AS counterparty,
    ({ev_country})[(event_id % 7) + 1] AS country,
    CAST(NULL AS VARCHAR) AS crypto_asset
  FROM events
),
planted AS (
  SELECT o.o_custkey AS c_custkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_extendedprice >= {dims.STRUCTURING_LO} AND l.l_extendedprice < {dims.STRUCTURING_HI}
  GROUP BY o.o_custkey HAVING count(*) >= 3
),
customers_v AS (
  SELECT
    c.c_custkey AS customer_id,
    c.c_name AS name,
    CASE WHEN c.c_custkey % 10 < 3 THEN 'business' ELSE 'individual' END AS customer_type,
    20000.0::DOUBLE + 10.0::DOUBLE * (c.c_acctbal + 1000.0::DOUBLE) AS annual_income,
    CAST(DATE '1994-12-31' - CAST(c.c_custkey % 3650 AS INTEGER) AS DATE) AS account_open_date,
    (p.c_custkey IS NOT NULL) AS is_suspicious,
    CASE WHEN p.c_custkey IS NOT NULL THEN 'structuring' END AS typology,
    (p.c_custkey IS NULL AND c.c_custkey % 20 = 7) AS is_gray_area,
    CASE WHEN p.c_custkey IS NULL AND c.c_custkey % 20 = 7 THEN ({gray})[(c.c_custkey % 9) + 1] END AS gray_profile,
    'USA' AS country
  FROM customer c LEFT JOIN planted p ON c.c_custkey = p.c_custkey
),
account_txns AS (
  SELECT t.* REPLACE (CAST(t.src_partkey % (SELECT count(*) FROM customer) AS VARCHAR) AS counterparty)
  FROM tx_orders t
),
supplier_txns AS (
  SELECT t.* REPLACE ('s' || CAST(t.src_suppkey AS VARCHAR) AS counterparty)
  FROM tx_orders t
)
"""


def rr_sql(x: str) -> str:
    """Magnitude-tiered rounding (same tiers as ``plans.common.rounded``)."""
    xn = f"(CAST({x} AS DOUBLE) * CAST(1.000000000001 AS DOUBLE))"
    return (f"(CASE WHEN abs({x}) < 100 THEN round({xn}, 6) WHEN abs({x}) < 100000 THEN round({xn}, 4) "
            f"WHEN abs({x}) < 100000000 THEN round({xn}, 2) ELSE round({xn}, 0) END)")


def tier_rounding(sql: str) -> str:
    """Rewrite every ``round(<expr>, 6)`` of an oracle text into ``rr_sql``."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 6, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                last_comma = k
            k += 1
        inner = sql[j + 6:k]
        if last_comma >= 0 and sql[last_comma + 1:k].strip() == "6":
            expr = tier_rounding(sql[j + 6:last_comma])
            out.append(sql[i:j] + rr_sql("(" + expr + ")"))
        else:
            out.append(sql[i:j] + "round(" + tier_rounding(inner) + ")")
        i = k + 1


def with_views(body: str) -> str:
    """Prefix a query body with the fixture CTEs; the body starts with
    ``, more_cte AS (...)`` or directly with ``SELECT``."""
    return tier_rounding("WITH " + views().strip() + "\n" + body)
