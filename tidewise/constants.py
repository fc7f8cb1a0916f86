"""Fixed values. Everything here must equal published domain values for results to be right."""

from __future__ import annotations

TRADING_DAYS = 252
RISK_FREE = 0.04
RETURN_PERIODS = (1, 5, 21, 63, 252)
PERIOD_DAYS = {"1M": 30, "3M": 90, "1Y": 365, "ALL": 1825}

# fixed values: sector funds, ticker -> sector name
SECTOR_ETFS = {
    "XLK": "Technology",
    "XLV": "Healthcare",
    "XLE": "Energy",
    "XLF": "Financials",
    "XLI": "Industrials",
    "XLY": "Consumer_Discretionary",
    "XLP": "Consumer_Staples",
    "XLU": "Utilities",
    "XLB": "Materials",
    "XLRE": "Real_Estate",
    "XLC": "Communication_Services",
}
SECTOR_KEYS = tuple(name.lower() for name in SECTOR_ETFS.values())

# fixed values: macro series id -> name
MACRO_SERIES = {
    "FEDFUNDS": "Fed_Funds_Rate",
    "CPIAUCSL": "CPI",
    "GDP": "GDP",
    "UNRATE": "Unemployment_Rate",
    "DGS10": "Treasury_10Y_Yield",
    "DGS2": "Treasury_2Y_Yield",
    "T10Y2Y": "Yield_Curve_Spread",
    "DCOILWTICO": "Oil_WTI",
    "GOLDAMGBD228NLBM": "Gold_Price",
    "UMCSENT": "Consumer_Sentiment",
    "INDPRO": "Industrial_Production",
    "HOUST": "Housing_Starts",
    "M2SL": "M2_Money_Supply",
}

# fixed values: market index names in column order
MARKET_INDICES = ("SP500", "VIX", "Treasury_10Y", "Treasury_30Y", "Treasury_3M")

FACTORS = ("interest_rates", "inflation", "gdp_growth", "unemployment", "vix", "oil_price", "dollar_index")

# fixed values: default coefficients, sector x factor (columns in FACTORS order)
SENSITIVITY = {
    "technology": (-0.8, -0.3, 0.6, -0.4, -0.5, -0.2, -0.3),
    "healthcare": (-0.2, 0.1, 0.3, 0.2, -0.2, -0.1, -0.1),
    "energy": (0.1, 0.4, 0.5, -0.3, -0.3, 0.8, -0.4),
    "financials": (0.5, -0.2, 0.6, -0.5, -0.4, 0.1, 0.2),
    "industrials": (-0.3, -0.2, 0.7, -0.4, -0.3, -0.3, -0.2),
    "consumer_discretionary": (-0.4, -0.4, 0.8, -0.6, -0.4, -0.2, -0.1),
    "consumer_staples": (-0.1, 0.2, 0.2, 0.1, 0.1, -0.1, -0.1),
    "utilities": (-0.6, 0.1, 0.1, 0.2, 0.2, -0.1, 0.0),
    "materials": (-0.2, 0.3, 0.6, -0.3, -0.3, 0.3, -0.5),
    "real_estate": (-0.7, -0.3, 0.4, -0.3, -0.2, 0.0, -0.1),
    "communication_services": (-0.5, -0.2, 0.5, -0.3, -0.4, -0.1, -0.2),
}

# fixed values: preset scenarios, factor changes
PRESETS = {
    "fed_hawkish": {"interest_rates": 0.02, "inflation": 0.01, "gdp_growth": -0.005},
    "recession": {"gdp_growth": -0.03, "interest_rates": -0.01, "unemployment": 0.02},
    "stagflation": {"inflation": 0.04, "gdp_growth": -0.01, "unemployment": 0.01},
    "oil_shock": {"oil_price": 0.5, "inflation": 0.02},
    "tech_correction": {"interest_rates": 0.015, "vix": 10.0},
    "bull_market": {"gdp_growth": 0.04, "interest_rates": 0.005, "unemployment": -0.01},
}

# fixed values: market regimes, factor changes
REGIME_SHOCKS = {
    "rate_hike": {"interest_rates": 0.02, "inflation": 0.01},
    "inflation_spike": {"inflation": 0.04, "gdp_growth": -0.005},
    "recession": {"gdp_growth": -0.03, "unemployment": 0.02},
    "bull_market": {"gdp_growth": 0.04, "vix": -0.25},
}

# fixed values: allocation advice by regime (risk level, equity, bond, cash, strategy)
REGIME_ADVICE = {
    "bull": ("high", 0.80, 0.15, 0.05, "Growth-oriented with high equity exposure"),
    "sideways": ("moderate", 0.60, 0.30, 0.10, "Balanced approach focusing on quality and dividends"),
    "bear": ("low", 0.40, 0.40, 0.20, "Defensive positioning with focus on capital preservation"),
    "crisis": ("minimal", 0.25, 0.35, 0.40, "Capital preservation with maximum defensive allocation"),
}

# fixed values: sector tilts by regime
REGIME_TILTS = {
    "bull": {
        "Technology": "overweight",
        "Consumer_Discretionary": "overweight",
        "Financials": "overweight",
        "Utilities": "underweight",
        "Consumer_Staples": "underweight",
    },
    "sideways": {
        "Healthcare": "overweight",
        "Consumer_Staples": "overweight",
        "Technology": "neutral",
        "Financials": "neutral",
    },
    "bear": {
        "Consumer_Staples": "overweight",
        "Utilities": "overweight",
        "Healthcare": "overweight",
        "Technology": "underweight",
        "Consumer_Discretionary": "underweight",
    },
    "crisis": {
        "Consumer_Staples": "overweight",
        "Utilities": "overweight",
        "Healthcare": "overweight",
        "Energy": "underweight",
        "Financials": "underweight",
        "Technology": "underweight",
    },
}

# fixed values: outcome aliases
OUTCOME_ALIASES = {
    "tech": "technology",
    "tech_returns": "technology",
    "health": "healthcare",
    "finance": "financials",
    "industrial": "industrials",
    "consumer": "consumer_discretionary",
    "utility": "utilities",
    "material": "materials",
    "realestate": "real_estate",
    "communication": "communication_services",
}

# fixed values: macro change column -> factor; the later of two columns for one factor wins
MACRO_TO_FACTOR = (
    ("Fed_Funds_Rate_Change", "interest_rates"),
    ("CPI_Change", "inflation"),
    ("GDP_Change", "gdp_growth"),
    ("Unemployment_Rate_Change", "unemployment"),
    ("VIX_Change", "vix"),
    ("Oil_WTI_Change", "oil_price"),
    ("Treasury_10Y_Yield_Change", "interest_rates"),
)

# fixed values: candidate columns for a treatment or outcome name, in order of preference
COLUMN_CANDIDATES = {
    "interest_rates": ("Fed_Funds_Rate_Change", "Treasury_10Y_Yield_Change"),
    "inflation": ("CPI_Change",),
    "gdp_growth": ("GDP_Change",),
    "unemployment": ("Unemployment_Rate_Change",),
    "vix": ("VIX_Change", "VIX"),
    "oil_price": ("Oil_WTI_Change",),
    "dollar_index": ("DXY_Change", "Dollar_Index_Change", "Treasury_10Y_Yield_Change"),
}
