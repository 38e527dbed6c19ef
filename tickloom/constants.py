"""Fixed values that results depend on."""

# Finance conventions.
RISK_FREE_ANNUAL = 0.05
TRADING_DAYS = 252
RISK_FREE_DAILY = RISK_FREE_ANNUAL / TRADING_DAYS
INITIAL_CAPITAL = 10_000.0
TRANSACTION_COST = 0.001
BENCHMARK = "ECONOMY"

# Forecast data preparation.
SEQUENCE_LENGTH = 90
TRAIN_SPLIT = 0.70
VAL_SPLIT = 0.15

# Comparison.
MIN_ROWS = 30

# Regime id -> (name, colour, description).
REGIME_PROFILES = {
    0: ("Trending Bull", "#00ff88", "Strong uptrend with aligned momentum. Historical bias is bullish."),
    1: ("Overbought / Exhaustion", "#ffaa00", "Extended rally. RSI elevated and momentum diverging — pullback risk."),
    2: ("Sideways / Choppy", "#888888", "No clear directional bias. Trend-following strategies underperform."),
    3: ("Recovery / Bounce", "#00aaff", "Recovering from oversold condition. Mean-reversion setup forming."),
    4: ("Downtrend / Bear", "#ff3366", "Clear downtrend in progress. Momentum is bearish."),
    5: ("High Volatility / Stress", "#ff6600", "Elevated fear and regime instability. Reduce risk exposure."),
}

# Short regime names used by the transition matrix and the confidence table.
REGIME_SHORT_NAMES = ["Trending Bull", "Overbought", "Sideways", "Recovery", "Bear", "High Vol"]

# Sentiment -> regime tag of the sector heat map.
SECTOR_REGIME_TAGS = {
    "Bullish": "Momentum Breakout",
    "Neutral": "Overbought Sideways",
    "Bearish": "Cyclical Pullback",
}

# Condition alert levels.
ALERT_LEVELS = {
    "GREEN": ("Favorable Conditions", "#00ff88", "Regime and indicators aligned positively."),
    "RED": ("Elevated Risk", "#ff3366", "High risk conditions. Historical odds favor caution."),
    "YELLOW": ("Watch / Wait", "#ffaa00", "Mixed signals. Wait for clearer confirmation."),
}

# Finance sentiment lexicon, term -> valence.
FINANCE_LEXICON = {
    "bullish": 3.0, "breakout": 2.5, "outperform": 2.5, "upgrade": 2.5, "beat": 2.0,
    "record": 2.0, "surge": 2.5, "rally": 2.5, "momentum": 1.5, "recovery": 2.0,
    "rebound": 2.0, "growth": 1.5, "dividend": 1.5, "buyback": 1.5, "acquisition": 1.0,
    "bearish": -3.0, "selloff": -3.0, "crash": -3.5, "recession": -3.0, "downgrade": -2.5,
    "miss": -2.0, "decline": -1.5, "layoffs": -2.5, "bankruptcy": -4.0, "default": -3.5,
    "fraud": -4.0, "investigation": -2.5, "warning": -2.0, "volatility": -1.0,
    "uncertainty": -1.5, "downside": -2.0, "headwinds": -2.0, "disappointing": -2.5,
    "stable": 0.5, "resilient": 1.0, "confident": 1.0, "concerns": -1.0, "risks": -0.5,
    "challenges": -0.5,
}

# Fixed values of the published sentiment rules (VADER): words that negate (any word with "n't" does too), words that
# raise or lower what follows, and the factors.
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "despite", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt",
    "mightnt", "mustnt", "neednt", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "rarely", "seldom",
    "shant", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt",
]
BOOSTERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply", "enormous", "enormously",
    "entirely", "especially", "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "fully", "greatly", "highly", "hugely",
    "incredible", "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably",
    "so", "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously", "unbelievably", "unusually", "utter", "utterly",
    "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce",
    "scarcely", "slight", "slightly", "somewhat", "sorta",
]
BOOST, CAPITALS, NEGATED, BEFORE_BUT, AFTER_BUT = 0.293, 0.733, -0.74, 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96

# Latency histogram bounds in seconds.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# Walk-forward (bull weight, neutral weight) candidates, in the order they are tried.
WALK_FORWARD_GRID = [(1.0, 0.5), (0.8, 0.4), (0.6, 0.3)]

# Failure window and call limits.
BREAKER_WINDOW = 20
BREAKER_THRESHOLD = 0.5
CALLS_PER_WINDOW = 30
CALL_WINDOW_SECONDS = 60.0

REGIME_FEATURES = ["rsi_dev", "macd_hist_norm", "ema_slope", "vol20", "ret10"]

# Model input columns, in order.
FEATURE_COLS = [
    "open", "high", "low", "close", "volume", "rsi14", "ema20",
    "macd", "macd_signal", "macd_hist", "day_of_week", "log_return",
]

# Market brief texts, printf style; arguments are named beside each.
BRIEF_HEADLINE = (  # ticker, bias, regime, confidence in percent
    "AI Intelligence Brief: %s demonstrates a %s bias under %s regime conditions with %.1f%% confidence."
)
BRIEF_SUMMARY = (  # ticker, price, month return, volatility, regime, RSI, direction
    "Asset %s is currently trading at $%.2f, exhibiting a 30-day return of %+.2f%% with 20-day annualized "
    "volatility at %.1f%%. The quantitative engine classifies the dominant market state as '%s', where momentum "
    "indicators (RSI: %.1f) support a %s directional forecast over a 20-day horizon."
)
BRIEF_TAKEAWAYS = [
    "Market Regime: %s — Historical win-rate in this regime is %d%%.",  # regime, rate
    "Technical Driver: RSI at %.1f indicates %s.",  # RSI, momentum
    "Risk Assessment: Annualized volatility of %.1f%% suggests %s.",  # volatility, tail
    "Tactical Recommendation: Rebalance allocation toward %s positioning with a trailing stop at %.2f.",  # direction, stop
]
BRIEF_MOMENTUM = ("overbought momentum", "oversold recovery", "neutral equilibrium")
BRIEF_TAIL = ("elevated tail risk", "controlled variance")

# Names of the attribution drivers.
DRIVERS = ["RSI (14-Day)", "20-Day Volatility", "EMA 20/50 Slope", "Regime Vector Distance", "MACD Histogram"]
