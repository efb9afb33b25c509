"""Fixed values of the data model.

Everything in this module is a fixed value: it has to be exactly this for the
results to be right (catalogues, bounds, thresholds, word lists, patterns).
Nothing here grows with the data, so anything built from it may be broadcast.
"""

from __future__ import annotations

# --- Indicator catalogue: code -> (name, category, standard unit, frequency) ---
INDICATORS = {
    "GDP_CURRENT_USD": ("GDP (Current USD)", "Economic Growth", "USD_BN", "ANNUAL"),
    "GDP_GROWTH": ("GDP Growth Rate", "Economic Growth", "PCT", "ANNUAL"),
    "CPI_INFLATION": ("CPI Inflation Rate", "Inflation", "PCT", "ANNUAL"),
    "UNEMPLOYMENT_RATE": ("Unemployment Rate", "Employment", "PCT", "ANNUAL"),
    "CURRENT_ACCOUNT_PCT_GDP": ("Current Account Balance (% GDP)", "Trade", "PCT_GDP", "ANNUAL"),
    "GOVT_DEBT_PCT_GDP": ("Government Debt (% GDP)", "Fiscal", "PCT_GDP", "ANNUAL"),
    "POPULATION": ("Population (Total)", "Demographics", "MILLIONS", "ANNUAL"),
    "EXPORTS_PCT_GDP": ("Exports of Goods and Services (% GDP)", "Trade", "PCT_GDP", "ANNUAL"),
    "IMPORTS_PCT_GDP": ("Imports of Goods and Services (% GDP)", "Trade", "PCT_GDP", "ANNUAL"),
    "GOVT_REVENUE_PCT_GDP": ("General Government Revenue (% GDP)", "Fiscal", "PCT_GDP", "ANNUAL"),
    "GOVT_EXPENDITURE_PCT_GDP": ("General Government Expenditure (% GDP)", "Fiscal", "PCT_GDP", "ANNUAL"),
}
TOTAL_INDICATORS = 11
# Codes a raw record may carry (an older, shorter list than the catalogue).
RAW_RECORD_INDICATORS = [
    "GDP_CURRENT_USD", "GDP_GROWTH", "CPI_INFLATION",
    "UNEMPLOYMENT_RATE", "CURRENT_ACCOUNT_PCT_GDP", "GOVT_DEBT_PCT_GDP",
]
MISSING_RAW_VALUES = ["", ".", "N/A", "null"]

# --- Countries ---
COUNTRIES = [
    "USA", "GBR", "DEU", "FRA", "JPN", "CHN", "IND", "BRA",
    "CAN", "AUS", "KOR", "MEX", "ITA", "ESP", "NLD",
    "SAU", "ZAF", "ARG", "IDN", "TUR",
]
COUNTRY_NAMES = {
    "USA": "United States", "GBR": "United Kingdom", "DEU": "Germany", "FRA": "France",
    "JPN": "Japan", "CHN": "China", "IND": "India", "BRA": "Brazil", "CAN": "Canada",
    "AUS": "Australia", "KOR": "South Korea", "MEX": "Mexico", "ITA": "Italy",
    "ESP": "Spain", "NLD": "Netherlands", "SAU": "Saudi Arabia", "ZAF": "South Africa",
    "ARG": "Argentina", "IDN": "Indonesia", "TUR": "Turkey",
}
# Names as they read inside a question sentence.
COUNTRY_PHRASES = {
    "ARG": "Argentina", "AUS": "Australia", "BRA": "Brazil", "CAN": "Canada",
    "CHN": "China", "DEU": "Germany", "ESP": "Spain", "FRA": "France",
    "GBR": "the United Kingdom", "IDN": "Indonesia", "IND": "India", "ITA": "Italy",
    "JPN": "Japan", "KOR": "South Korea", "LIC": "low-income countries", "MEX": "Mexico",
    "NLD": "the Netherlands", "SAU": "Saudi Arabia", "TUR": "Turkey",
    "USA": "the United States", "WLD": "the world", "ZAF": "South Africa",
}
COUNTRY_REGIONS = {
    "USA": "Americas", "CAN": "Americas", "MEX": "Americas", "BRA": "Americas", "ARG": "Americas",
    "GBR": "Europe", "DEU": "Europe", "FRA": "Europe", "ITA": "Europe", "ESP": "Europe", "NLD": "Europe",
    "JPN": "Asia-Pacific", "CHN": "Asia-Pacific", "IND": "Asia-Pacific",
    "KOR": "Asia-Pacific", "AUS": "Asia-Pacific", "IDN": "Asia-Pacific",
    "SAU": "Middle East & Africa", "ZAF": "Middle East & Africa", "TUR": "Middle East & Africa",
}
G7 = ["USA", "CAN", "GBR", "DEU", "FRA", "ITA", "JPN"]
UNIT_PHRASES = {"PCT": "%", "PCT_GDP": "% of GDP", "USD_BN": "billion USD", "MILLIONS": "million"}

# --- Per-source scale factors (absent pair = 1.0) ---
SOURCE_MULTIPLIERS = {
    ("WORLD_BANK", "GDP_CURRENT_USD"): 1e-9,
    ("WORLD_BANK", "POPULATION"): 1e-6,
    ("FRED", "GDP_CURRENT_USD"): 1.0,
    ("FRED", "POPULATION"): 1e-3,
    ("IMF", "GDP_CURRENT_USD"): 1.0,
    ("IMF", "POPULATION"): 1.0,
}
# Source dimension: code, name, url, type, reputation.
SOURCES = [
    ("WORLD_BANK", "World Bank Open Data", "https://api.worldbank.org/v2", "API", 95.0),
    ("IMF_WEO", "IMF World Economic Outlook", "https://www.imf.org/external/datamapper/api/v1", "API", 95.0),
    ("FRED", "Federal Reserve Economic Data (FRED)", "https://api.stlouisfed.org/fred", "API", 90.0),
    ("OECD", "OECD Statistics", "https://sdmx.oecd.org/public/rest", "API", 90.0),
    ("IMF_BLOG", "IMF Blog", "https://www.imf.org/en/Blogs", "HTML", 85.0),
    ("WB_PROSPECTS", "World Bank Global Economic Prospects",
     "https://www.worldbank.org/en/publication/global-economic-prospects", "HTML", 85.0),
]
CRAWLABLE_TYPES = ["HTML", "PDF"]

# --- Value parsing and data-quality scoring ---
FORECAST_WORDS_RAW = [
    "forecast", "projection", "estimate", "expected", "outlook",
    "projected", "estimated", "anticipated", "predicted",
]
UNIT_BOUNDS = {
    "PCT": (-100.0, 100.0), "PCT_GDP": (-200.0, 200.0),
    "USD_BN": (0.0, None), "INDEX": (0.0, None),
}
INDICATOR_BOUNDS = {
    "GDP_GROWTH": (-30.0, 30.0), "CPI_INFLATION": (-20.0, 1000.0),
    "UNEMPLOYMENT_RATE": (0.0, 100.0), "CURRENT_ACCOUNT_PCT_GDP": (-50.0, 50.0),
    "GOVT_DEBT_PCT_GDP": (0.0, 500.0),
}
MISSING_FIELD_TOKENS = ["", "None", "null", "N/A", ".."]
PCT_UNIT_WORDS = ["percent", "%", "pct", "percentage", "rate", "index"]
DQ_WEIGHTS = {"accuracy": 0.40, "completeness": 0.30, "timeliness": 0.20, "consistency": 0.10}
DQ_PROMOTE = 90.0
DQ_REVIEW = 70.0
REVIEW_SLA_HOURS = 4
STALE_YEARS = 5
SLOW_CRAWL_DAYS = 90
# Units whose bare absolute values are scaled down: (unit, threshold and divisor).
UNIT_SCALE_RULES = [("USD_BN", 1e9), ("MILLIONS", 1e6)]

# --- Four-layer validator (a second, different bounds table) ---
VALIDATOR_RANGES = {
    "GDP_GROWTH": (-50.0, 50.0), "CPI_INFLATION": (-20.0, 200.0),
    "UNEMPLOYMENT_RATE": (0.0, 100.0), "CURRENT_ACCOUNT_PCT_GDP": (-100.0, 100.0),
    "GOVT_DEBT_PCT_GDP": (0.0, 500.0), "EXPORTS_PCT_GDP": (0.0, 200.0),
    "IMPORTS_PCT_GDP": (0.0, 200.0), "POPULATION": (0.01, 20000.0),
    "GDP_CURRENT_USD": (0.0, 50000.0),
}
VALIDATOR_MAX_CHANGE_PCT = {"GDP_GROWTH": 50.0}
VALIDATOR_REFRESH_DAYS = {
    "GDP_CURRENT_USD": 365, "GDP_GROWTH": 365, "CPI_INFLATION": 30,
    "UNEMPLOYMENT_RATE": 30, "POPULATION": 365,
}
VALIDATOR_DEFAULT_DAYS = 90

# --- Freshness tiers ---
SLA_WINDOW_MINUTES = {"TIER1": 30, "TIER2": 240, "TIER3": 480}
SLA_TIERS = {
    "TIER1": ["GDP_GROWTH", "CPI_INFLATION", "UNEMPLOYMENT_RATE"],
    "TIER2": ["CURRENT_ACCOUNT_PCT_GDP", "GOVT_DEBT_PCT_GDP", "EXPORTS_PCT_GDP", "IMPORTS_PCT_GDP"],
    "TIER3": ["POPULATION", "GOVT_REVENUE_PCT_GDP", "GOVT_EXPENDITURE_PCT_GDP"],
}

# --- Gates ---
CONFIDENCE_ACCEPT = 0.85
CONFIDENCE_REVIEW = 0.70
EXTRACTION_MIN_CONFIDENCE = 0.4

# --- Accountability chain: level -> SLA hours (0 counts as 4), level names ---
LEVEL_SLA_HOURS = {1: 0, 2: 4, 3: 8, 4: 24, 5: 48}
LEVEL_NAMES = {
    1: "Data Ingestion (Auto)", 2: "Data Quality Analyst", 3: "Domain SME",
    4: "Data Governance Lead", 5: "Business Owner",
}

# --- Rate limits: role -> (per day, per minute) ---
RATE_LIMITS = {
    "PUBLIC": (10, 2), "EXTERNAL_BUSINESS": (1000, 10), "INTERNAL_ANALYST": (999999, 999),
    "ADMIN": (999999, 999), "DATA_GOVERNANCE": (999999, 999),
}
BLOCK_COOLDOWN_HOURS = [1, 4]
BLOCKS_UNTIL_PERMANENT = 3

# --- Costs ---
LLM_RATE_PER_1K = {"GROQ": 0.0, "GEMINI": 0.00015, "OPENROUTER": 0.001, "CEREBRAS": 0.0}
LLM_DEFAULT_RATE = 0.001
CRAWLER_RATE_PER_SECOND = 0.000001
STORAGE_RATE_PER_GB = 0.023
CRAWL_SESSION_SECONDS = 60.0
CRAWL_COST_CEILING = 10.0

# --- Retention days ---
RETENTION_DAYS = {"bronze": 730, "silver": 1095, "chat": 90, "privacy_log": 365}

# --- Governance policy defaults ---
POLICY_THRESHOLD_DEFAULTS = {
    "auto_accept_threshold": 0.85, "review_threshold_low": 0.70, "reject_below": 0.70,
}

# --- Privacy patterns: type -> pattern ---
PII_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "NATIONAL_ID": r"\b\d{3}[-]?\d{2}[-]?\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
# Order in which overlapping types are applied, widest token first.
PII_ORDER = ["EMAIL", "CREDIT_CARD", "IP_ADDRESS", "PHONE", "NATIONAL_ID"]

# --- Text safety ---
ADVICE_WORDS = [
    "buy", "sell", "invest", "portfolio", "stock pick", "short", "long position", "day trade",
    "trading position", "trade recommendation", "accumulate", "divest", "allocate capital",
    "allocating capital", "financial advice", "recommend buying", "recommend selling",
    "bullish on", "bearish on", "price target", "upside potential", "entry point", "exit strategy",
]
DOMAIN_WORDS = [
    "gdp", "inflation", "unemployment", "monetary policy", "fiscal", "interest rate",
    "central bank", "trade balance", "current account", "government debt", "cpi", "pmi",
    "recession", "economic growth", "exchange rate", "bop", "balance of payments",
    "sovereign debt", "bond yield", "budget deficit", "surplus", "import", "export", "forex",
    "currency", "quantitative easing", "tightening", "yield curve", "credit rating",
    "economic indicator",
]
DISCLAIMER_WORDS = [
    "forecast", "projected", "project", "projects", "expected",
    "estimate", "projection", "outlook", "predicted",
]
ADVICE_REFUSAL = (
    "I can provide macroeconomic data and analysis, but I'm not able to offer "
    "investment advice or recommendations. Please consult a qualified financial advisor."
)
SCOPE_REFUSAL = (
    "I'm specialized in macroeconomic data and analysis. Your question appears to be "
    "outside this domain. I can help with GDP, inflation, trade data, monetary policy, "
    "and related macroeconomic topics."
)
DISCLAIMER = (
    "\n\n_Disclaimer: Forecasts are based on published sources and historical models. "
    "Actual results may differ materially._"
)
# Citation markers looked for by the output validator (case-sensitive).
CITATION_MARKERS = [
    r"\[Source:", r"\[Sources:", r"Source:\s", r"https?://",
    r"\(IMF\)", r"\(World Bank\)", r"\(FRED\)", r"\(OECD\)",
]
# Citation styles looked for by the response formatter.
CITATION_STYLES = [
    r"(?i)\[Sources?:[^\]]+\]",
    r"(?i)\[(World Bank|IMF|OECD|FRED|Eurostat)[^\]]*\]",
    r"\d[\d.,]*\s+\w+\s+\[([\w\s,]+)\]",
    r"https?://\S+",
    r"(?i)\bSource(?:s)?:",
    r"(?i)\b(World Bank|IMF|OECD|FRED|Eurostat|United Nations|CIA World Factbook)\b",
]
INLINE_CITATION = r"(?i)\[Source:\s*([^,\]]+),\s*([^\]]+)\]"
NUMBER_GROUPED = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"
NUMBER_PLAIN = r"-?\d+(?:\.\d+)?"
NUMBER_CLAIM = r"\b(\d+\.?\d*)\s*(%|percent|billion|trillion|million)?\b"
MIN_RESPONSE_CHARS = 50
MAX_RESPONSE_CHARS = 4000
GROUNDING_TOLERANCE = 0.05

# --- Page parsing ---
ANCHOR = r"""(?is)<a[^>]+href=["']([^"'#?][^"']*)["'][^>]*>(.*?)</a>"""
SCRIPT_BLOCK = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
TAG = r"<[^>]+>"
ARTICLE_URLS = [
    r"/[Bb]logs?/[Aa]rticles?/\d{4}/", r"/[Pp]ublications?/[A-Z]", r"/\d{4}/\d{2}/\d{2}/",
    r"/press-release/\d{4}/", r"/[Oo]utlook/", r"/publ/qtr", r"/en/doc/",
]
LINKS_PER_PAGE = 25
LINK_TITLE_MIN = 8
LINK_TITLE_MAX = 120

# --- Raw-record patterns ---
ISO3 = r"^[A-Z]{3}$"
PERIOD = r"^(\d{4}|\d{4}-\d{2}|\d{4}-Q[1-4]|\d{4}-\d{2}-\d{2})$"

# --- Explanations ---
DIMENSION_LABELS = {
    "accuracy": "Accuracy", "completeness": "Completeness",
    "timeliness": "Timeliness", "consistency": "Consistency",
}
REASON_SENTENCES = {
    "value_not_parseable": "The raw value could not be parsed as a number.",
    "missing_indicator_code": "Required field: indicator code was missing.",
    "missing_country_code": "Required field: country code was missing.",
    "missing_period": "Required field: reporting period was missing.",
    "missing_raw_value": "Required field: raw value was missing.",
    "missing_standard_unit": "Standard unit was not assigned during normalisation.",
    "period_format_unrecognized":
        "Reporting period format could not be interpreted for timeliness scoring.",
}

# --- Summaries ---
SECTOR_INDICATORS = {
    "Monetary Conditions": ["CPI_INFLATION", "GDP_GROWTH"],
    "Fiscal Position": ["GOVT_DEBT_PCT_GDP", "GDP_CURRENT_USD"],
    "External Balance": ["CURRENT_ACCOUNT_PCT_GDP", "GDP_GROWTH"],
    "Labour Market": ["UNEMPLOYMENT_RATE", "GDP_GROWTH"],
    "Full Macro Overview": [
        "GDP_GROWTH", "CPI_INFLATION", "UNEMPLOYMENT_RATE",
        "CURRENT_ACCOUNT_PCT_GDP", "GOVT_DEBT_PCT_GDP",
    ],
}
SUMMARY_RECORD_LIMIT = 50
SUMMARY_TTL_HOURS = 24

# --- Forecast and anomaly model ---
BAND_Z = 1.96
# Band of the robust model, in median absolute deviations.
ROBUST_WIDTH = 4.5
FORECAST_MIN_POINTS = 5
ANOMALY_MIN_POINTS = 10
TEST_POINTS = 5
TRAIN_POINTS = 20
MIN_TRAIN_POINTS = 5
IQR_FENCE = 10.0
MAX_OUTLIER_SHARE = 0.30
FORECAST_DQ = 95.0

# --- Evaluation ---
QUESTION_TARGETS = {
    "point_lookup": 120, "comparison": 40, "superlative_high": 20,
    "superlative_low": 20, "trend": 40,
}
TREND_GAP_YEARS = 5
ANSWER_REL_TOL = 0.02
ANSWER_ABS_TOL = 0.1

IMF_CODES = {
    "GDP_CURRENT_USD": "NGDPD", "GDP_GROWTH": "NGDP_RPCH", "CPI_INFLATION": "PCPIPCH",
    "UNEMPLOYMENT_RATE": "LUR", "CURRENT_ACCOUNT_PCT_GDP": "BCA_NGDPD",
    "GOVT_DEBT_PCT_GDP": "GGXWDG_NGDP", "POPULATION": "LP",
    "GOVT_REVENUE_PCT_GDP": "GGR_NGDP", "GOVT_EXPENDITURE_PCT_GDP": "GGX_NGDP",
}

# --- Trust explanation wording ---
TRUST_LABELS = {
    "high": "Auto-promoted (DQ ≥ 90%)", "medium": "Review band (70%–90%)",
    "low": "Below review threshold (< 70%)", "unknown": "Quality score unavailable",
}
TRUST_MODEL = "(accuracy 40% + completeness 30% + timeliness 20% + consistency 10%)."
TRUST_HIGH = (
    "Met the auto-promote threshold (≥ 90%) and was published to the Gold layer without human review."
)
TRUST_MEDIUM = "Score is in the human-review band (70%–90%). Verify before high-stakes use."
TRUST_LOW = "Score is below the review threshold and should not be treated as production-ready."
