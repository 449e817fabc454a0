"""Pair and symbol text functions (F1-F4, F12, F14, P9, P13) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _map_lit(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_pair(c: Column) -> Column:
    """drop "/" and "-", upper-case, then the exact-match replacements."""
    cleaned = F.upper(F.regexp_replace(c, "[/-]", ""))
    return F.coalesce(F.try_element_at(_map_lit(S.PAIR_NORMALIZE_MAP), cleaned), cleaned)


def pair_to_symbol(c: Column) -> Column:
    """exchange pair -> database symbol, identity when unmapped."""
    return F.coalesce(F.try_element_at(_map_lit(S.PAIR_SYMBOL_MAP), c), c)


def infer_symbol(normalized: Column) -> Column:
    """XBT... -> BTC... (every XBT replaced); then, when there is no "/" and the text is
    longer than 6 chars, split off the first matching quote suffix (USD, USDT, EUR, GBP)."""
    s = F.when(normalized.startswith("XBT"), F.replace(normalized, F.lit("XBT"), F.lit("BTC"))).otherwise(normalized)
    quoted = F.regexp_replace(s, "(" + "|".join(S.SYMBOL_QUOTES) + ")$", "/$1")  # no text ends with two of them
    return F.when(s.contains("/") | (F.length(s) <= 6), s).otherwise(quoted)


def currency_of(symbol: Column) -> Column:
    """USD if the symbol mentions USD, else EUR."""
    return F.when(symbol.contains("USD"), F.lit("USD")).otherwise(F.lit("EUR"))


def is_online(status: Column) -> Column:
    """status == 'online' (missing status is not online)."""
    return F.coalesce(status == "online", F.lit(False))


def search_terms(search: str) -> list[str]:
    """Lower-cased term plus exchange aliases (doge -> xdg; btc without xbt -> xbt)."""
    s = search.lower()
    terms = [s]
    for trigger, unless, extra in S.SEARCH_ALIASES:
        if trigger in s and (unless is None or unless not in s):
            terms.append(extra)
    return terms


SEARCH_COLUMNS = ["pair", "wsname", "altname", "base", "quote"]


def matches_search(search: str | None, columns: list[str] = SEARCH_COLUMNS) -> Column:
    """Case-insensitive substring of any term in any of the five text columns."""
    if not search:
        return F.lit(True)
    conds = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t) for t in search_terms(search) for c in columns]
    return reduce(lambda a, b: a | b, conds)


def status_filter(status: str | None) -> Column:
    """P8: 'all' or empty disables the filter."""
    if not status or status == "all":
        return F.lit(True)
    return F.col("status") == status


def display_name() -> Column:
    """Wsname, else altname, else the pair key (empty counts as missing)."""
    return F.coalesce(F.nullif(F.col("wsname"), F.lit("")), F.nullif(F.col("altname"), F.lit("")), F.col("pair"))
