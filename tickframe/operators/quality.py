"""Constraint checks as data-quality jobs (Q1-Q5, Q7): each is one aggregate pass per table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.timeframes import timeframe_minutes
from ..session import scratch, staged
from .merge import first_per_key
from .reads import candle_violations


def null_counts(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """Q1: NULLs per NOT NULL column, all columns in one aggregate, then unpivoted."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "null_count").select(
        F.lit(table).alias("table_name"), "column_name", "null_count")


def key_duplicates(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Q2: keys that occur more than once, and the rows they cover (partial counts per key)."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    dup = per_key.filter(F.col("n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                   F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duplicate_rows")).select(
        F.lit(table).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), "duplicate_keys", "duplicate_rows")


def orphans(child: DataFrame, table: str, symbols: DataFrame, fk: str = "symbol_id") -> DataFrame:
    """Q3: child rows whose symbol does not exist."""
    ids = symbols.select(F.col("id").alias(fk))
    return child.join(ids, fk, "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows")).select(
        F.lit(table).alias("table_name"), "orphan_rows")


CANDLE_RULES = ["open_not_positive", "high_not_positive", "low_not_positive", "close_not_positive",
                "volume_negative", "bad_time_frame"]


def range_violations(candles: DataFrame, prices: DataFrame) -> DataFrame:
    """Q4: rows breaking each value rule (candles: prices > 0, volume >= 0, known time frame;
    prices: price > 0). One pass per table."""
    v = candles.select(candle_violations().alias("v"))
    c = v.agg(*[F.count_if(F.array_contains("v", r)).alias(r) for r in CANDLE_RULES])
    c = c.unpivot([], CANDLE_RULES, "rule", "violations").select(F.lit("market_data").alias("table_name"), "rule", "violations")
    p = prices.agg(F.count_if(~F.coalesce(F.col("price") > 0, F.lit(False))).alias("violations")).select(
        F.lit("real_time_prices").alias("table_name"), F.lit("price_not_positive").alias("rule"), "violations")
    return c.unionByName(p)


def length_violations(symbols: DataFrame) -> DataFrame:
    """Q5: text longer than its declared VARCHAR(n)."""
    cols = [c for c in S.SYMBOL_LENGTHS if c in symbols.columns]
    agg = symbols.agg(*[F.count_if(F.length(c) > S.SYMBOL_LENGTHS[c]).alias(c) for c in cols])
    limits = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(S.SYMBOL_LENGTHS[c]))])
    return agg.unpivot([], cols, "column_name", "too_long").select(
        F.lit("symbols").alias("table_name"), "column_name",
        F.element_at(limits, F.col("column_name")).alias("max_length"), "too_long")


def gap_summary(candles: DataFrame) -> DataFrame:
    """Q7: per series, bars expected between its first and last bar at the time frame's
    interval (F5 minutes; calendar months for 1M, as A8 builds them) versus bars present.
    Counting needs no expansion of the range."""
    g = candles.groupBy("symbol_id", "data_source", "time_frame").agg(
        F.min("t_stamp").alias("first_ts"), F.max("t_stamp").alias("last_ts"),
        F.count_distinct("t_stamp").alias("present"))
    step = timeframe_minutes(F.col("time_frame")) * 60
    months = (F.year("last_ts") - F.year("first_ts")) * 12 + F.month("last_ts") - F.month("first_ts")
    expected = F.when(F.col("time_frame") == "1M", months).otherwise(
        F.floor((F.unix_seconds("last_ts") - F.unix_seconds("first_ts")) / step)) + 1
    return g.select("symbol_id", "data_source", "time_frame", "first_ts", "last_ts",
                    expected.cast("bigint").alias("expected"), "present",
                    (expected - F.col("present")).cast("bigint").alias("missing"))


def missing_bars(candles: DataFrame) -> DataFrame:
    """Q7 listing: the missing bar times themselves.

    Gaps and islands: each bar looks at the next one of its series, and only the stretch between two
    bars that are more than a step apart is expanded, so the rows made are the missing ones.
    """
    series = ["symbol_id", "data_source", "time_frame"]
    bars = candles.select(*series, "t_stamp").withColumn("_next", F.lead("t_stamp").over(Window.partitionBy(*series).orderBy("t_stamp")))
    step = F.make_dt_interval(F.lit(0), F.lit(0), timeframe_minutes(F.col("time_frame")).cast("int"))
    before = F.col("_next") - F.expr("INTERVAL 1 MICROSECOND")
    months = F.ceil(F.months_between("_next", "t_stamp")).cast("int") - 1
    monthly = F.when(months > 0, F.transform(F.sequence(F.lit(1), months), lambda k: F.col("t_stamp") + F.make_ym_interval(F.lit(0), k)))
    wide = F.when(F.col("t_stamp") + step < F.col("_next"), F.sequence(F.col("t_stamp") + step, before, step))
    times = F.when(F.col("time_frame") == "1M", monthly).otherwise(wide)
    return bars.filter(F.col("_next").isNotNull()).select(*series, F.explode(times).alias("t_stamp"))


# --------------------------------------------------------------------------- measured while writing
def rules(table: str, columns: list[str]) -> dict[str, Column]:
    """Rule name -> condition that a row breaks, of a table's declared constraints (Q1, Q4, Q5)."""
    out = {f"{c}_missing": F.col(c).isNull() for c in S.NOT_NULL.get(table, []) if c in columns}
    if table == "market_data":
        out |= {r: F.array_contains(candle_violations(), r) for r in CANDLE_RULES}
    if table == "real_time_prices":
        out["price_not_positive"] = ~F.coalesce(F.col("price") > 0, F.lit(False))
    if table == "symbols":
        out |= {f"{c}_too_long": F.coalesce(F.length(c) > n, F.lit(False)) for c, n in S.SYMBOL_LENGTHS.items() if c in columns}
    return out


def checked(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """``df`` whose rows, and rows against each rule, are counted by the job that writes it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(r) for r, bad in rules(table, df.columns).items()]), seen


def write_checked(spark: SparkSession, tables: dict[str, DataFrame], write: Callable[[str, DataFrame], object]) -> DataFrame:
    """Write each table with ``write(name, rows)`` and give (table_name, rule, violations), counted on the
    way. ``duplicate_keys_dropped`` are the rows that the declared keys removed.

    Of a table with a key the keys are counted first, and only rows whose key repeats are brought together
    (see ``once_per_key``): such a table is read three times and should be a stored one.
    """
    out = []
    for name, df in tables.items():
        key = S.KEYS.get(name, [None])[-1]
        with scratch(spark):
            if key:
                parts, after = once_per_key(df, key, name)
            else:
                (df, seen), after = checked(df, name), None
                parts = [(df, seen)]
            write(name, union_all([rows for rows, _ in parts]))
        counts = Counter()
        for _, seen in parts:
            counts.update(seen.get)
        rows = counts.pop("rows")
        out += [(name, r, n) for r, n in counts.items()]
        if after is not None:
            out.append((name, "duplicate_keys_dropped", rows - after.get["rows"] - (parts[0][1].get["rows"] if len(parts) > 1 else 0)))
    return spark.createDataFrame(out, "table_name string, rule string, violations bigint")


def once_per_key(df: DataFrame, key: list[str], table: str) -> tuple[list[tuple[DataFrame, Observation]], Observation]:
    """(parts of ``df`` with one row per key, each with the counts of the rows that went into it; the counts of
    what is left in the last part).

    Where most rows have a key of their own they are not shuffled: the keys alone are counted, and the rows of
    repeated keys (the last part) are reduced by ``first_per_key``. Where half of the rows or more have a
    repeated key, all are one part.
    """
    order = [c for c in df.columns if c not in key]
    seen = Observation()
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    n = n.observe(seen, F.sum("_n").alias("rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n"))).alias("repeated"))
    repeats = staged(n.filter(F.col("_n") > 1).select(*[F.col(c).alias(f"_key_{c}") for c in key]), "repeated-keys")
    rows, repeated = seen.get["rows"] or 0, seen.get["repeated"] or 0
    if 2 * repeated >= rows:
        every, before = checked(df, table)
        left, after = checked(first_per_key(every, key, order), table)
        return [(left, before)], after
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key])
    own, seen_own = checked(df.join(repeats, same, "left_anti"), table)
    several, seen_several = checked(df.join(repeats, same, "left_semi"), table)
    left, after = checked(first_per_key(several, key, order), table)
    return [(own, seen_own), (left.select(*own.columns), seen_several)], after


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
