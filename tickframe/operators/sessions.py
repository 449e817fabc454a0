"""Trading sessions: ticks inside a session (J11) and market status at an instant.

Sessions are a seed dimension (one row per exchange session, a few dozen at most), joined
by exchange; the session window is a residual predicate on the local time of day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _sod(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _sod_text(t: Column) -> Column:
    parts = F.split(t, ":")
    return (F.get(parts, 0).cast("int") * 3600 + F.get(parts, 1).cast("int") * 60
            + F.get(parts, 2).cast("int"))


def _local_at(day: Column, hhmmss: Column, tz: Column) -> Column:
    """UTC instant of wall-clock ``day hh:mm:ss`` in zone ``tz``."""
    wall = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), hhmmss).cast("timestamp")
    return F.to_utc_timestamp(wall, tz)


def ticks_in_session(ticks: DataFrame, symbols: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each tick of a known symbol with its exchange-local time and whether it falls in
    the exchange's session (open <= local time of day <= close, second resolution)."""
    s = symbols.select(F.col("id").alias("symbol_id"), "exchange")
    ses = sessions.filter(F.col("is_active")).select("exchange", "timezone", "open_time", "close_time")
    j = ticks.join(s, "symbol_id").join(ses, "exchange")
    local = F.from_utc_timestamp(F.col("ts"), F.col("timezone"))
    sod = _sod(local)
    return j.select("id", "symbol_id", "exchange", "ts",
                    F.date_format(local, "HH:mm:ss").alias("local_time"),
                    ((sod >= _sod_text(F.col("open_time"))) & (sod <= _sod_text(F.col("close_time")))).alias("in_session"))


def status_at(instants: DataFrame, sessions: DataFrame, at_col: str = "as_of") -> DataFrame:
    """Q6: for each (exchange, instant) row and the exchange's active session: is_open,
    next_open, next_close (UTC). An equi-join on exchange, no cross product.

    next_open: today's open if still ahead, else tomorrow's; next_close: today's close unless
    it has passed, else tomorrow's (local calendar, DST-aware via the zone rules).
    """
    ses = sessions.filter(F.col("is_active")).select("exchange", "timezone", "open_time", "close_time")
    j = instants.join(ses, "exchange")
    return j.select("exchange", F.col(at_col).alias(at_col), *_status_cols(F.col(at_col)))


def exchange_activity(ticks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ticks tagged with the exchange of their symbol (known symbols only)."""
    s = symbols.select(F.col("id").alias("symbol_id"), "exchange")
    return ticks.join(s, "symbol_id")


def market_status(ticks: DataFrame, symbols: DataFrame, sessions: DataFrame, exchange: str | None = None) -> DataFrame:
    """Status of each exchange as of its latest tick, ordered by exchange."""
    last = exchange_activity(ticks, symbols).groupBy("exchange").agg(F.max("ts").alias("as_of"))
    if exchange is not None:
        last = last.filter(F.col("exchange") == exchange)
    st = status_at(last, sessions)
    return st.select("exchange", "is_open", "next_open", "next_close", F.col("as_of").alias("last_updated")).orderBy("exchange")


def _status_cols(at: Column) -> list[Column]:
    tz = F.col("timezone")
    local = F.from_utc_timestamp(at, tz)
    sod = _sod(local)
    o, c = _sod_text(F.col("open_time")), _sod_text(F.col("close_time"))
    day = F.to_date(local)
    nxt = F.date_add(day, 1)
    is_open = (sod >= o) & (sod <= c)
    next_open = F.when(sod < o, _local_at(day, F.col("open_time"), tz)).otherwise(_local_at(nxt, F.col("open_time"), tz))
    next_close = F.when(sod <= c, _local_at(day, F.col("close_time"), tz)).otherwise(_local_at(nxt, F.col("close_time"), tz))
    return [is_open.alias("is_open"), next_open.alias("next_open"), next_close.alias("next_close")]
