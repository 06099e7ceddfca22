"""Reference dimensions and thresholds.

FIXED VALUES: the lists, maps and numbers below must equal the reference's
for results to match.  They are written out plainly, in their natural order.
Everything here is tiny and of a fixed size, so it is either inlined into
expressions (``create_map`` / ``CASE``) or broadcast as a literal frame.
"""

# ---------------------------------------------------------------- FIXED VALUES
TYPOLOGIES = [
    "structuring", "rapid_movement", "layering", "trade_based",
    "cash_intensive", "shell_company", "funnel_account",
    "third_party_payments", "round_tripping", "smurfing",
    "crypto_laundering",
]

HIGH_RISK_COUNTRIES = [
    "China", "Russia", "UAE", "Panama", "Cyprus", "Cayman Islands",
    "British Virgin Islands", "Seychelles", "Belize", "Malta",
    "Luxembourg", "Mauritius", "Hong Kong", "Singapore", "Switzerland",
]

FX_RATES = {"USD": 1.0, "EUR": 1.09, "AED": 0.2723, "INR": 0.01198}

CRYPTO_RATES_USD = {"BTC": 65000.0, "ETH": 3400.0, "USDT": 1.0}

COUNTRY_PPL = {
    "USA": 1.00, "UK": 0.82, "Germany": 0.80, "France": 0.79, "Italy": 0.72,
    "Spain": 0.68, "Portugal": 0.63, "Switzerland": 1.10, "UAE": 0.50,
    "Singapore": 0.84, "Hong Kong": 0.81, "Japan": 0.65, "China": 0.46,
    "India": 0.27, "Philippines": 0.30, "Vietnam": 0.29, "Nigeria": 0.28,
    "Mexico": 0.40, "Panama": 0.55, "Russia": 0.38, "Turkey": 0.32,
    "Cayman Islands": 0.60, "British Virgin Islands": 0.60, "Belize": 0.60,
    "Seychelles": 0.60, "Luxembourg": 0.85, "Malta": 0.70, "Mauritius": 0.45,
    "Cyprus": 0.68, "Canada": 0.87,
}
DEFAULT_PPL = 0.60

COUNTRY_CURRENCY_MAP = {
    "Germany": "EUR", "France": "EUR", "Italy": "EUR", "Spain": "EUR",
    "UK": "EUR", "Portugal": "EUR", "Switzerland": "EUR",
    "UAE": "AED",
    "India": "INR",
    "Philippines": "INR",
}
DEFAULT_CURRENCY = "USD"

CRYPTO_EXCHANGES = [
    "Binance", "Coinbase", "Kraken", "OKX",
    "Bybit", "Gemini", "KuCoin", "Huobi", "Bitfinex", "Bitstamp",
]

# exchange -> (risk_score, kyc_level, jurisdiction)
EXCHANGE_PROFILES = {
    "Binance": (0.55, "medium", "Cayman Islands"),
    "Coinbase": (0.15, "high", "USA"),
    "Kraken": (0.20, "high", "USA"),
    "OKX": (0.65, "low", "Seychelles"),
    "Bybit": (0.60, "low", "UAE"),
    "Gemini": (0.10, "high", "USA"),
    "KuCoin": (0.70, "low", "Seychelles"),
    "Huobi": (0.65, "medium", "Seychelles"),
    "Bitfinex": (0.50, "medium", "British Virgin Islands"),
    "Bitstamp": (0.15, "high", "Luxembourg"),
}
HIGH_RISK_EXCHANGE_MIN = 0.50
LOW_RISK_EXCHANGE_MAX = 0.25

ROLLING_WINDOW_DAYS = 30

BSI_CRITICAL = 25
BSI_HIGH_DRIFT = 50
BSI_MODERATE = 75

# level -> (check_interval_days, anomaly_threshold, recommended_action)
MONITORING_LEVELS = {
    "standard": (30, 0.7, "Behavioral consistency maintained. Low risk."),
    "enhanced": (7, 0.5, "Review transaction context and patterns."),
    "intensive": (1, 0.3, "Enhanced monitoring required. Lower anomaly thresholds."),
    "immediate": (0, 0.1, "Immediate investigation warranted. SAR review initiated."),
}
SUDDEN_DROP_POINTS = 20

GBT_PARAMS = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "seed": 42}
HIGH_RISK_THRESHOLD = 0.7

GRAY_AREA_PROFILES = [
    "international_business", "cash_restaurant", "freelancer_irregular",
    "real_estate_investor", "travel_enthusiast", "family_remittance",
    "seasonal_business", "day_trader", "crypto_investor",
]
GRAY_PROFILE_TO_TYPOLOGY = {
    "international_business": "layering",
    "cash_restaurant": "cash_intensive",
    "freelancer_irregular": "structuring",
    "real_estate_investor": "round_tripping",
    "travel_enthusiast": "rapid_movement",
    "family_remittance": "rapid_movement",
    "seasonal_business": "cash_intensive",
    "day_trader": "rapid_movement",
    "crypto_investor": "crypto_laundering",
}
GRAY_ALERT_SHARE = 0.6

# graph engine defaults
GRAPH_MAX_CYCLE_LENGTH = 8
GRAPH_MAX_CYCLES_PER_NODE = 20
GRAPH_TEMPORAL_WINDOW_DAYS = 30
GRAPH_TEMPORAL_PERIODS = 6
GRAPH_HUB_DEGREE = 8
GRAPH_HUB_LOW = 3
GRAPH_RAPID_PASSTHROUGH_HOURS = 72
GRAPH_LAYER_CUTOFF = 10
GRAPH_BETWEENNESS_K = 300

# structuring band
STRUCTURING_LO = 7000.0
STRUCTURING_HI = 10000.0

# linkage tiers
LINK_WINDOW_DAYS = 10
LINK_HIGH_MAX_DEV = 0.25
LINK_MEDIUM_MAX_DEV = 0.60

# evaluation thresholds
EVAL_THRESHOLDS = [25, 35, 50, 60, 75]
# ------------------------------------------------------------ END FIXED VALUES

# Fixture choices of this repository (not reference values): how the driver's
# TPC-H style tables are turned into bank-like views.  See FIXTURES.md §2.
METHODS = ["cash", "wire", "ach", "card", "check", "crypto_exchange"]
CRYPTO_ASSETS = ["BTC", "ETH", "USDT"]
# nation key 0..9 -> USA, 10..24 -> the next fifteen countries of COUNTRY_PPL
NATION_COUNTRY = ["USA"] * 10 + [
    "UK", "Germany", "France", "Italy", "Spain", "Portugal", "Switzerland",
    "UAE", "Singapore", "Hong Kong", "Japan", "China", "India", "Philippines",
    "Vietnam",
]
EVENT_DEPOSIT_TYPES = ["signup", "click", "error"]
# event_id % 7 -> country
EVENT_COUNTRY = ["USA", "USA", "USA", "USA", "USA", "UK", "China"]
ACCOUNT_AGE_REFERENCE = "2025-12-31"
CUSTOMER_REFERENCE_DATE = "2001-12-31"
