"""Time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def timeframe_minutes(tf: Column) -> Column:
    """exchange interval in minutes; unknown time frames -> 60."""
    m = F.create_map(*[F.lit(x) for kv in S.TIMEFRAME_MINUTES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, tf), F.lit(S.TIMEFRAME_DEFAULT_MINUTES))


def from_epoch(seconds: Column) -> Column:
    """epoch seconds -> UTC timestamp."""
    return F.timestamp_seconds(seconds.cast("bigint"))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text ('Z' accepted as +00:00) -> timestamp."""
    t = F.regexp_replace(text, "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
                      F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")),
                      F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")))


def to_iso(ts: Column) -> Column:
    """timestamp -> ISO text in UTC with explicit offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def month_partition(ts: Column) -> Column:
    """partition suffix YYYY_MM of the month containing ``ts``."""
    return F.date_format(F.date_trunc("month", ts), "yyyy_MM")


def months_ahead(ts: Column, n: int) -> Column:
    """first day of the month ``n`` months after the month of ``ts``."""
    return F.add_months(F.trunc(ts.cast("date"), "month"), n)
