"""Table contracts (Spark types) and the fixed values the engine must share with the reference."""

from __future__ import annotations

from pyspark.sql import types as T

D20_8 = T.DecimalType(20, 8)
D10_4 = T.DecimalType(10, 4)

SYMBOLS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("exchange", T.StringType(), False),
    T.StructField("asset_type", T.StringType(), False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("sector", T.StringType(), True),
    T.StructField("industry", T.StringType(), True),
    T.StructField("market_cap", T.LongType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

# Compute columns are double; the decimal(20,8) contract applies at the storage edge
# (see ``operators.merge.to_storage``).
MARKET_DATA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("symbol_id", T.IntegerType(), False),
    T.StructField("t_stamp", T.TimestampType(), False),
    T.StructField("open", T.DoubleType(), False),
    T.StructField("high", T.DoubleType(), False),
    T.StructField("low", T.DoubleType(), False),
    T.StructField("close", T.DoubleType(), False),
    T.StructField("volume", T.LongType(), False),
    T.StructField("adjusted_close", T.DoubleType(), True),
    T.StructField("time_frame", T.StringType(), False),
    T.StructField("data_source", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

REAL_TIME_PRICES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("symbol_id", T.IntegerType(), False),
    T.StructField("price", T.DoubleType(), False),
    T.StructField("bid", T.DoubleType(), True),
    T.StructField("ask", T.DoubleType(), True),
    T.StructField("volume_24h", T.LongType(), True),
    T.StructField("change_24h", T.DoubleType(), True),
    T.StructField("change_percent_24h", T.DoubleType(), True),
    T.StructField("market_cap", T.LongType(), True),
    T.StructField("data_source", T.StringType(), False),
    T.StructField("last_updated", T.TimestampType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

INDICATOR_COLUMNS = [
    "sma_5", "sma_10", "sma_20", "sma_50", "sma_200", "ema_12", "ema_26",
    "rsi_14", "macd", "macd_signal", "macd_histogram", "stoch_k", "stoch_d",
    "bollinger_upper", "bollinger_middle", "bollinger_lower", "atr_14",
    "volume_sma_20", "obv", "adx", "cci", "williams_r",
]
# Storage precision of each indicator column (decimal(10,4) for bounded oscillators).
INDICATOR_D10_4 = {"rsi_14", "stoch_k", "stoch_d", "adx", "williams_r"}

TECHNICAL_INDICATORS = T.StructType(
    [T.StructField("id", T.LongType(), False),
     T.StructField("symbol_id", T.IntegerType(), False),
     T.StructField("timestamp", T.TimestampType(), False),
     T.StructField("time_frame", T.StringType(), False)]
    + [T.StructField(c, T.LongType() if c == "volume_sma_20" else T.DoubleType(), True)
       for c in INDICATOR_COLUMNS]
    + [T.StructField("created_at", T.TimestampType(), True)]
)

MARKET_SESSIONS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("exchange", T.StringType(), False),
    T.StructField("session_name", T.StringType(), False),
    T.StructField("timezone", T.StringType(), False),
    T.StructField("open_time", T.StringType(), False),   # HH:mm:ss (TIME)
    T.StructField("close_time", T.StringType(), False),
    T.StructField("is_active", T.BooleanType(), True),
])

DATA_SOURCES = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("base_url", T.StringType(), False),
    T.StructField("rate_limit_per_minute", T.IntegerType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

MARKET_STATUS = T.StructType([
    T.StructField("exchange", T.StringType(), False),
    T.StructField("is_open", T.BooleanType(), False),
    T.StructField("next_open", T.TimestampType(), True),
    T.StructField("next_close", T.TimestampType(), True),
    T.StructField("last_updated", T.TimestampType(), True),
])

# Declared key of each table (UNIQUE / PRIMARY KEY constraints).
KEYS = {
    "symbols": [["id"], ["symbol"]],
    "market_data": [["symbol_id", "t_stamp", "time_frame", "data_source"]],
    "real_time_prices": [["symbol_id", "data_source"]],
    "technical_indicators": [["symbol_id", "timestamp", "time_frame"]],
    "market_status": [["exchange"]],
    "data_sources": [["name"]],
}

# NOT NULL columns (without the surrogate ids).
NOT_NULL = {
    "symbols": ["symbol", "name", "exchange", "asset_type", "currency"],
    "market_data": ["symbol_id", "t_stamp", "open", "high", "low", "close", "volume", "time_frame", "data_source"],
    "real_time_prices": ["symbol_id", "price", "data_source"],
    "technical_indicators": ["symbol_id", "timestamp", "time_frame"],
    "market_sessions": ["exchange", "session_name", "timezone", "open_time", "close_time"],
    "market_status": ["exchange", "is_open"],
    "data_sources": ["name", "base_url"],
}

# ---------------------------------------------------------------------------
# Fixed values shared with the reference (must stay equal for equal results).
# ---------------------------------------------------------------------------

# Text length limits of the symbols table (VARCHAR(n)).
SYMBOL_LENGTHS = {"symbol": 20, "name": 255, "exchange": 50, "asset_type": 20,
                  "currency": 10, "sector": 100, "industry": 100}

# Accepted candle time frames (API pattern) and their exchange interval in minutes;
# unknown time frames fall back to 60 minutes. "1M" is the exchange's approximate value.
TIMEFRAMES = ["1m", "5m", "15m", "30m", "1h", "4h", "1d", "1w", "1M"]
TIMEFRAME_PATTERN = "^(1m|5m|15m|30m|1h|4h|1d|1w|1M)$"
TIMEFRAME_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240,
                     "1d": 1440, "1w": 10080, "1M": 21600}
TIMEFRAME_DEFAULT_MINUTES = 60

# Asset types and pair statuses.
ASSET_TYPES = ["stock", "crypto", "forex", "commodity", "index"]
PAIR_STATUSES = ["online", "cancel_only", "post_only", "limit_only"]

# Pair-name normalisation: exact-match replacements after removing "/" and "-" and upper-casing.
PAIR_NORMALIZE_MAP = {"BTC": "XBT", "BTCUSD": "XBTUSD", "BTCUSDT": "XBTUSDT",
                      "ETHUSD": "ETHUSD", "ETHUSDT": "ETHUSDT"}

# Exchange pair -> database symbol.
PAIR_SYMBOL_MAP = {
    "XBTUSD": "BTC/USD", "XBTUSDT": "BTC/USDT", "ETHUSD": "ETH/USD", "ETHUSDT": "ETH/USDT",
    "ADAUSD": "ADA/USD", "ADAUSDT": "ADA/USDT", "SOLUSD": "SOL/USD", "SOLUSDT": "SOL/USDT",
    "DOTUSD": "DOT/USD", "DOTUSDT": "DOT/USDT", "MATICUSD": "MATIC/USD", "MATICUSDT": "MATIC/USDT",
    "LINKUSD": "LINK/USD", "LINKUSDT": "LINK/USDT", "AVAXUSD": "AVAX/USD", "AVAXUSDT": "AVAX/USDT",
    "ATOMUSD": "ATOM/USD", "ATOMUSDT": "ATOM/USDT", "ALGOUSD": "ALGO/USD", "ALGOUSDT": "ALGO/USDT",
}

# Quote suffixes tried, in this order, when splitting an inferred symbol longer than 6 chars.
SYMBOL_QUOTES = ["USD", "USDT", "EUR", "GBP"]

# Search aliases: a term containing "doge" also searches "xdg"; "btc" (without "xbt") also "xbt".
SEARCH_ALIASES = [("doge", None, "xdg"), ("btc", "xbt", "xbt")]

# Exchange defaults of ingested pairs.
EXCHANGE_NAME = "Kraken"
EXCHANGE_SOURCE = "kraken"
PAIR_CACHE_SECONDS = 3600

# Seed rows: data sources (name, base_url, rate limit per minute, active).
SEED_DATA_SOURCES = [
    ("alpha_vantage", "https://www.alphavantage.co/query", 5, True),
    ("yahoo_finance", "https://query1.finance.yahoo.com/v8/finance/chart", 100, True),
    ("binance", "https://api.binance.com/api/v3", 1200, True),
    ("coinbase", "https://api.exchange.coinbase.com", 10, True),
    ("polygon", "https://api.polygon.io/v2", 5, True),
    ("finnhub", "https://finnhub.io/api/v1", 60, True),
]

# Seed rows: market sessions (exchange, session name, time zone, open, close, active).
SEED_SESSIONS = [
    ("NYSE", "Regular Trading", "America/New_York", "09:30:00", "16:00:00", True),
    ("NASDAQ", "Regular Trading", "America/New_York", "09:30:00", "16:00:00", True),
    ("LSE", "Regular Trading", "Europe/London", "08:00:00", "16:30:00", True),
    ("TSE", "Regular Trading", "Asia/Tokyo", "09:00:00", "15:00:00", True),
    ("HKEX", "Regular Trading", "Asia/Hong_Kong", "09:30:00", "16:00:00", True),
    ("BINANCE", "24/7 Trading", "UTC", "00:00:00", "23:59:59", True),
    ("COINBASE", "24/7 Trading", "UTC", "00:00:00", "23:59:59", True),
]
SESSION_EXCHANGES = [s[0] for s in SEED_SESSIONS]

# Seed rows: market statuses (exchange, open, hours until the next open, trading hours after it).
SEED_MARKET_STATUS = [
    ("NYSE", False, 24.0, 6.5),
    ("NASDAQ", False, 24.0, 6.5),
    ("LSE", False, 24.0, 8.5),
    ("TSE", False, 24.0, 6.0),
    ("HKEX", False, 24.0, 6.5),
    ("XETRA", False, 24.0, 8.0),
    ("EPA", False, 24.0, 8.0),
    ("BINANCE", True, None, None),
    ("COINBASE", True, None, None),
]

# Seed rows: symbols (symbol, name, exchange, asset type, currency, sector, industry, market cap).
SEED_SYMBOLS = [
    ("AAPL", "Apple Inc.", "NASDAQ", "stock", "USD", "Technology", "Consumer Electronics", 3000000000000),
    ("MSFT", "Microsoft Corporation", "NASDAQ", "stock", "USD", "Technology", "Software", 2800000000000),
    ("GOOGL", "Alphabet Inc. Class A", "NASDAQ", "stock", "USD", "Technology", "Internet", 1800000000000),
    ("AMZN", "Amazon.com Inc.", "NASDAQ", "stock", "USD", "Consumer Discretionary", "E-commerce", 1500000000000),
    ("TSLA", "Tesla Inc.", "NASDAQ", "stock", "USD", "Consumer Discretionary", "Electric Vehicles", 800000000000),
    ("META", "Meta Platforms Inc.", "NASDAQ", "stock", "USD", "Technology", "Social Media", 700000000000),
    ("NVDA", "NVIDIA Corporation", "NASDAQ", "stock", "USD", "Technology", "Semiconductors", 1200000000000),
    ("BRK.A", "Berkshire Hathaway Inc. Class A", "NYSE", "stock", "USD", "Financial Services", "Insurance", 800000000000),
    ("JPM", "JPMorgan Chase & Co.", "NYSE", "stock", "USD", "Financial Services", "Banking", 400000000000),
    ("JNJ", "Johnson & Johnson", "NYSE", "stock", "USD", "Healthcare", "Pharmaceuticals", 400000000000),
    ("V", "Visa Inc.", "NYSE", "stock", "USD", "Financial Services", "Payment Processing", 500000000000),
    ("PG", "Procter & Gamble Co.", "NYSE", "stock", "USD", "Consumer Staples", "Household Products", 350000000000),
    ("UNH", "UnitedHealth Group Inc.", "NYSE", "stock", "USD", "Healthcare", "Health Insurance", 450000000000),
    ("HD", "Home Depot Inc.", "NYSE", "stock", "USD", "Consumer Discretionary", "Retail", 300000000000),
    ("MA", "Mastercard Inc.", "NYSE", "stock", "USD", "Financial Services", "Payment Processing", 400000000000),
    ("BTC", "Bitcoin", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("ETH", "Ethereum", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("BNB", "Binance Coin", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("ADA", "Cardano", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("SOL", "Solana", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("XRP", "Ripple", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("DOT", "Polkadot", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("DOGE", "Dogecoin", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("AVAX", "Avalanche", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("MATIC", "Polygon", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("LINK", "Chainlink", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("UNI", "Uniswap", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("LTC", "Litecoin", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("BCH", "Bitcoin Cash", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("ATOM", "Cosmos", "BINANCE", "crypto", "USD", "Cryptocurrency", "Digital Currency", None),
    ("EURUSD", "Euro / US Dollar", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("GBPUSD", "British Pound / US Dollar", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("USDJPY", "US Dollar / Japanese Yen", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("USDCHF", "US Dollar / Swiss Franc", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("AUDUSD", "Australian Dollar / US Dollar", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("USDCAD", "US Dollar / Canadian Dollar", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("NZDUSD", "New Zealand Dollar / US Dollar", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("EURGBP", "Euro / British Pound", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("EURJPY", "Euro / Japanese Yen", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("GBPJPY", "British Pound / Japanese Yen", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("EURCHF", "Euro / Swiss Franc", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("AUDJPY", "Australian Dollar / Japanese Yen", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("GBPCHF", "British Pound / Swiss Franc", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("EURCAD", "Euro / Canadian Dollar", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("AUDCAD", "Australian Dollar / Canadian Dollar", "FOREX", "forex", "USD", "Foreign Exchange", "Currency Pair", None),
    ("SPX", "S&P 500 Index", "NYSE", "index", "USD", "Market Index", "Broad Market", None),
    ("DJI", "Dow Jones Industrial Average", "NYSE", "index", "USD", "Market Index", "Broad Market", None),
    ("IXIC", "NASDAQ Composite", "NASDAQ", "index", "USD", "Market Index", "Technology", None),
    ("RUT", "Russell 2000 Index", "NYSE", "index", "USD", "Market Index", "Small Cap", None),
    ("VIX", "CBOE Volatility Index", "CBOE", "index", "USD", "Market Index", "Volatility", None),
    ("FTSE", "FTSE 100 Index", "LSE", "index", "GBP", "Market Index", "Broad Market", None),
    ("N225", "Nikkei 225 Index", "TSE", "index", "JPY", "Market Index", "Broad Market", None),
    ("HSI", "Hang Seng Index", "HKEX", "index", "HKD", "Market Index", "Broad Market", None),
    ("DAX", "DAX Index", "XETRA", "index", "EUR", "Market Index", "Broad Market", None),
    ("CAC", "CAC 40 Index", "EPA", "index", "EUR", "Market Index", "Broad Market", None),
]
