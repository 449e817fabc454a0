"""Technical indicators (I1-I14): the 22 declared columns of technical_indicators.

The reference declares the columns but ships no formula, so the standard definitions are
fixed here (see README). A series is one (symbol_id, time_frame); bars are ordered by time.

A series is cut into chunks of ``CHUNK_BARS`` bars by its bars' numbers, so that one hot series is
worked on by many tasks. Bars are numbered without bringing a series together: rows are counted per
stretch of time, the counts are added up over the stretches, and each stretch numbers its own bars.

* Sliding-window indicators are frames over (series, chunk): of Spark windows (stochastic, Williams %R),
  or, where all bars of a frame are added up (SMA, Bollinger, volume SMA, CCI), of numpy blocks in the
  windows' order. A chunk carries copies of the ``HALO`` bars before it, which are dropped afterwards.
  On-balance volume adds a running offset of the chunks before.
* Recurrences (EMA, Wilder smoothing) are affine: y -> a*y + b. The map of a whole chunk is one
  weighted sum over its bars (a Spark aggregate that combines map-side); the maps are composed
  along the chunks of a series, and each chunk starts from the value so carried to it. Within
  chunks numpy steps all chunks of a task's block at once, one bar of each at a time, left to right
  as a sequential run would.

Where no series is longer than a chunk there is one chunk each, and nothing is carried.

Warm-up: a value is NULL until its look-back is full. Wilder(n) = mean of the first n inputs,
then (prev*(n-1) + x)/n. Sums are accumulated left to right so results are reproducible.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import staged as _staged

# The functions below that step recurrences run in Python workers; ship this module's code
# with the task (pickle by value) so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES = ["symbol_id", "time_frame"]
# One real column naming a series: partitioning and windows key on it, so they share one
# exchange (a constant time_frame cannot be folded out of it).
SERIES_KEY = "_series"
SMA_PERIODS = [5, 10, 20, 50, 200]


# --------------------------------------------------------------------------- I13 series selection
def series_bars(candles: DataFrame) -> DataFrame:
    """One bar per (symbol, time frame, time): the indicator key has no data_source, so the
    bar of the lowest-ranked source (name order) is used. Partial-aggregable (min_by)."""
    bar = F.struct("data_source", "open", "high", "low", "close", "volume")
    # The feeds of a bar are reduced where the rows lie (partial min_by). The series column spells
    # out both key parts, so any two time frames (a NULL one included) are different series.
    series = F.concat_ws(":", F.col("symbol_id").cast("string"), F.coalesce("time_frame", F.lit("-")))
    g = candles.withColumn(SERIES_KEY, series).groupBy(SERIES_KEY, "symbol_id", "time_frame", "t_stamp").agg(
        F.min_by(bar, F.col("data_source")).alias("b"))
    return g.select(SERIES_KEY, "symbol_id", "time_frame", "t_stamp", "b.data_source", "b.open", "b.high",
                    "b.low", "b.close", "b.volume")


# --------------------------------------------------------------------------- chunks
HALO = max(SMA_PERIODS) - 1
CHUNK_BARS = 4096
CHUNK, HALO_ROW = "_chunk", "_halo"


class Bars:
    """Numbered bars: ``rn`` (from 1 in each series), the chunk, and whether a row is a copy from the chunk before."""

    def __init__(self, rows: DataFrame, chunk_bars: int | None):
        self.rows, self.chunk_bars = rows, chunk_bars

    def window(self) -> Window:
        """A chunk in time order; without chunks a whole series."""
        if self.chunk_bars is None:
            return Window.partitionBy(SERIES_KEY).orderBy("t_stamp")
        return Window.partitionBy(SERIES_KEY, CHUNK).orderBy("t_stamp")

    def own(self, df: DataFrame) -> DataFrame:
        """Without the copies."""
        return df if self.chunk_bars is None else df.filter(~F.col(HALO_ROW))


def numbered(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> Bars:
    """The bars of every series numbered by time and dealt to chunks of ``chunk_bars`` bars.

    The bars are written once, as their number per series decides on the chunks.
    """
    bars = _staged(bars, "bars")
    longest = bars.groupBy(SERIES_KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= chunk_bars:
        w = Window.partitionBy(SERIES_KEY).orderBy("t_stamp")
        return Bars(bars.withColumn("rn", F.row_number().over(w)), None)
    # a stretch of time holds about a chunk of the series' bars at most: as long as so many bar widths
    minutes = F.create_map(*[F.lit(x) for kv in S.TIMEFRAME_MINUTES.items() for x in kv])
    width = F.coalesce(F.try_element_at(minutes, F.col("time_frame")), F.lit(1)) * (60 * chunk_bars)
    bars = bars.withColumn("_stretch", F.floor(F.unix_seconds("t_stamp") / width))
    stretches = bars.groupBy(SERIES_KEY, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(SERIES_KEY).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select(SERIES_KEY, "_stretch", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy(SERIES_KEY, "_stretch").orderBy("t_stamp")) + F.col("_before")
    rows = bars.join(before, [SERIES_KEY, "_stretch"]).withColumn("rn", rn).drop("_stretch", "_before")
    own = F.floor((F.col("rn") - 1) / chunk_bars)
    rows = (rows.withColumn("_own", own).withColumn(CHUNK, F.explode(F.sequence("_own", F.floor((F.col("rn") - 1 + HALO) / chunk_bars))))
            .withColumn(HALO_ROW, F.col(CHUNK) > F.col("_own")).drop("_own"))
    return Bars(rows, chunk_bars)


# --------------------------------------------------------------------------- window indicators
#: Sums over the last n bars: name -> (what is made of them, column, n). They are stepped in numpy, as a window
#: frame adds up all its bars anew for every row.
FRAMES = {**{f"sma_{n}": ("mean", "close", n) for n in SMA_PERIODS}, "_sd": ("deviation", "close", 20),
          "_volume_mean": ("mean", "volume", 20), "_tp_sma": ("share", "_tp", 20), "_md": ("distance", "_tp", 20)}
#: window column -> frames that it needs
FRAME_NEEDS = {**{f"sma_{n}": [f"sma_{n}"] for n in SMA_PERIODS}, "bollinger_upper": ["sma_20", "_sd"], "bollinger_middle": ["sma_20"],
               "bollinger_lower": ["sma_20", "_sd"], "volume_sma_20": ["_volume_mean"], "cci": ["_tp_sma", "_md"]}


def _sum_back(terms: Callable[[slice, slice], np.ndarray], place: np.ndarray, n: int, short: bool) -> np.ndarray:
    """For each row the sum of ``terms`` over the last ``n`` rows, the oldest first; ``terms(back, here)`` gives
    those of the rows ``back`` as the rows ``here`` see them. ``place``: a row's place in its chunk (from 0);
    ``short``: frames end at the start of the chunk."""
    rows = len(place)
    out = np.zeros(rows)
    for k in range(min(n, rows) - 1, -1, -1):
        more = terms(slice(0, rows - k), slice(k, rows))
        out[k:] += np.where(place[k:] >= k, more, 0.0) if short else more
    return out


def frame_block(frames: list[str], number: np.ndarray, opens: np.ndarray, values: dict[str, np.ndarray], valid: dict[str, np.ndarray]) -> dict[str, tuple]:
    """(values, which are NULL) of each of ``frames`` for a block of whole chunks (``opens``: where one begins)
    in bar order.

    Missing inputs are skipped, as a window's aggregates do. The first n - 1 bars of a series (``number``: the
    bars' numbers in it) are NULL.
    """
    out = {}
    start = np.flatnonzero(opens)
    place = np.arange(len(number)) - np.repeat(start, np.diff(np.append(start, len(number))))
    for name in frames:
        kind, column, n = FRAMES[name]
        x, ok = values[column], valid[column]
        short = bool(((place < n - 1) & (number >= n)).any())
        some = _sum_back(lambda back, _: ok[back], place, n, short) if short or not ok.all() else np.full(len(number), float(n))
        with np.errstate(all="ignore"):
            center = _sum_back(lambda back, _: x[back], place, n, short) / (some if kind in ("mean", "deviation") else n)
            if kind == "deviation":
                center = np.sqrt(_sum_back(lambda back, here: np.where(ok[back], np.square(x[back] - center[here]), 0.0), place, n, short) / n)
            elif kind == "distance":
                center = _sum_back(lambda back, here: np.where(ok[back], np.abs(x[back] - center[here]), 0.0), place, n, short) / n
        out[name] = center, (some == 0) | (number < n)
    return out


def _frames(columns: list[str]) -> list[str]:
    return list(dict.fromkeys(x for c in columns for x in FRAME_NEEDS.get(c, [])))


def _windows(b: Bars) -> DataFrame:
    """The window columns but for the ``FRAMES``, and what those and the recurrences read (_tp, and the bar
    before: _pc, _ph, _pl)."""
    w = b.window()
    frame = lambda n: w.rowsBetween(-(n - 1), 0)
    cols = {"_pc": F.lag("close").over(w), "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w)}
    # I5/I12 stochastic and Williams %R over 14 bars
    cols["_ll14"] = F.min("low").over(frame(14))
    cols["_hh14"] = F.max("high").over(frame(14))
    # I9 on-balance volume
    step = F.signum(F.col("close") - F.lag("close").over(w))
    cols["_obv_step"] = F.coalesce(step, F.lit(0.0)) * F.col("volume")
    # I11 CCI on the typical price
    rows = b.rows if b.chunk_bars is None else b.rows.repartition(SERIES_KEY, CHUNK)
    df = rows.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.select("*", *[v.alias(k) for k, v in cols.items()])

    rng = F.col("_hh14") - F.col("_ll14")
    full14 = (F.col("rn") >= 14) & (rng != 0)
    stoch_k = F.when(full14, (F.col("close") - F.col("_ll14")) * 100 / rng)
    # a copy's own step belongs to the chunk before
    own_step = F.col("_obv_step") if b.chunk_bars is None else F.when(F.col(HALO_ROW), F.lit(0.0)).otherwise(F.col("_obv_step"))
    gone = {"_ll14", "_hh14", "_obv_step"}
    df = df.select(
        *[c for c in df.columns if c not in gone],
        stoch_k.alias("stoch_k"),
        F.when(full14, (F.col("_hh14") - F.col("close")) * -100 / rng).alias("williams_r"),
        F.sum(own_step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("obv"),
    )
    k3 = frame(3)
    return df.withColumn("stoch_d", F.when(F.count("stoch_k").over(k3) == 3, F.avg("stoch_k").over(k3)))


def _from_frames() -> dict[str, Column]:
    """The window columns made of ``FRAMES`` (those of one name are the frames themselves)."""
    mid, sd, full = F.col("sma_20"), F.col("_sd"), F.col("rn") >= 20
    return {"bollinger_upper": F.when(full, mid + sd * 2), "bollinger_middle": mid, "bollinger_lower": F.when(full, mid - sd * 2),
            "volume_sma_20": F.rint("_volume_mean").cast("bigint"),
            "cci": F.when(full & (F.col("_md") != 0), (F.col("_tp") - F.col("_tp_sma")) / (F.col("_md") * 0.015))}


def _window_columns(columns: list[str]) -> list[Column]:
    made = _from_frames()
    return [made[c].alias(c) if c in made else F.col(c) for c in columns]


def _framed(df: DataFrame, columns: list[str], chunk_bars: int | None, kept: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (of ``_windows``) with the frames that the window ``columns`` need; of the other columns those that
    are read later, and ``kept``."""
    frames = _frames(columns)
    plain = [c for c in columns if c not in FRAME_NEEDS]
    more = [] if chunk_bars is None else [CHUNK, HALO_ROW]
    tp = ["_tp"] if "cci" in columns else []
    return _smoothed(df.select(*BAR_COLUMNS, "rn", *more, *tp, *kept, *plain), {}, chunk_bars, frames=frames)


def _obv_carried(df: DataFrame) -> DataFrame:
    """``obv`` of chunks plus what the chunks before add up to (their last value is the greatest row's)."""
    last = df.groupBy(SERIES_KEY, CHUNK).agg(F.max_by("obv", "rn").alias("_sum"))
    along = Window.partitionBy(SERIES_KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offset = last.select(SERIES_KEY, CHUNK, F.coalesce(F.sum("_sum").over(along), F.lit(0.0)).alias("_offset"))
    return df.join(offset, [SERIES_KEY, CHUNK]).withColumn("obv", F.col("obv") + F.col("_offset")).drop("_offset")


def window_indicators(bars: DataFrame, chunk_bars: int = CHUNK_BARS, columns: list[str] | None = None) -> DataFrame:
    """The bars with the asked window ``columns`` (default: all)."""
    b = numbered(bars, chunk_bars)
    asked = WINDOW_COLUMNS if columns is None else columns
    df = b.own(_framed(_windows(b), asked, b.chunk_bars))
    if b.chunk_bars is not None and "obv" in asked:
        df = _obv_carried(_staged(df, "indicator-windows"))
    return df.select(*BAR_COLUMNS, "rn", *_window_columns(asked))


# --------------------------------------------------------------------------- recurrences
#: name -> (input, smoothing, n, number of the series' first input bar). Those of the second round
#: read values of the first.
FIRST_ROUND = {"ema_12": ("close", "ema", 12, 1), "ema_26": ("close", "ema", 26, 1), "_gain": ("_up", "wilder", 14, 2),
               "_loss": ("_down", "wilder", 14, 2), "atr_14": ("_tr", "wilder", 14, 1), "_plus": ("_pdm", "wilder", 14, 2),
               "_minus": ("_mdm", "wilder", 14, 2), "_range": ("_tr", "wilder", 14, 2)}
SECOND_ROUND = {"macd_signal": ("macd", "ema", 9, 1), "adx": ("_dx", "wilder", 14, 15)}
#: asked column -> first and second round names that it needs
NEEDS = {"ema_12": ["ema_12"], "ema_26": ["ema_26"], "macd": ["ema_12", "ema_26"], "macd_signal": ["ema_12", "ema_26", "macd_signal"],
         "macd_histogram": ["ema_12", "ema_26", "macd_signal"], "rsi_14": ["_gain", "_loss"], "atr_14": ["atr_14"],
         "adx": ["_plus", "_minus", "_range", "adx"]}
RECURRENCE_COLUMNS = list(NEEDS)
#: Bars that a task steps together.
BLOCK_BARS = 200_000


def _inputs(df: DataFrame) -> DataFrame:
    """Gains, losses, directional moves and true ranges against the bar before (0 and high - low for a first bar)."""
    zero, later = F.lit(0.0), F.col("rn") > 1
    move, up, down = F.col("close") - F.col("_pc"), F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    span = F.col("high") - F.col("low")
    return df.withColumns({
        "_up": F.when(later & (move > 0), move).otherwise(zero), "_down": F.when(later & (move < 0), -move).otherwise(zero),
        "_pdm": F.when(later & (up > down) & (up > 0), up).otherwise(zero), "_mdm": F.when(later & (down > up) & (down > 0), down).otherwise(zero),
        "_tr": F.when(later, F.greatest(span, F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))).otherwise(span)})


def _decay(kind: str, n: int) -> float:
    return 1.0 - 2.0 / (n + 1) if kind == "ema" else (n - 1) / n


def _step(rounds: dict, y: np.ndarray, x: np.ndarray, k: int) -> None:
    """One bar of all chunks: ``y`` (smoothings x chunks) after inputs ``x``; ``k`` is the bar's number in its series.

    During a Wilder warm-up y holds the sum so far.
    """
    for i, (_, kind, n, first) in enumerate(rounds.values()):
        at = k - first + 1
        if at < 1:
            continue
        if kind == "ema":
            a = 2.0 / (n + 1)
            y[i] = x[i] if at == 1 else a * x[i] + (1.0 - a) * y[i]
        elif at < n:
            y[i] = y[i] + x[i]
        elif at == n:
            y[i] = (y[i] + x[i]) / n
        else:
            y[i] = (y[i] * (n - 1) + x[i]) / n


def smooth_block(rounds: dict, number: np.ndarray, opens: np.ndarray, inputs: list[np.ndarray], carried: list[np.ndarray]) -> list[np.ndarray]:
    """Smoothed values of a block of whole chunks, one after the other in bar order.

    ``number``: the bars' numbers in their series; ``opens``: where a chunk begins; ``carried``: for
    each smoothing the value that the chunk starts from, given in the chunk's first bar.
    """
    out = [np.full(len(number), np.nan) for _ in rounds]
    start = np.flatnonzero(opens)
    size = np.diff(np.append(start, len(number)))
    warm = max(first + n for _, _, n, first in rounds.values())
    begin = np.where(number[start] > warm, warm + 1, number[start])  # all bars past the warm-up are stepped alike
    for b in np.unique(begin):
        order = np.flatnonzero(begin == b)
        order = order[np.argsort(-size[order], kind="stable")]
        rows, sizes = start[order], size[order]
        y = np.stack([c[rows] for c in carried]) if b > 1 else np.zeros((len(rounds), len(rows)))
        for i, (_, kind, n, first) in enumerate(rounds.values()):
            if kind == "wilder" and 1 < b <= first + n - 1:
                y[i] *= n  # carried as a share of the mean, stepped as a sum
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for t, m in enumerate(alive.tolist()):
            at = rows[:m] + t
            now = y[:, :m]
            _step(rounds, now, np.stack([x[at] for x in inputs]), int(b) + t)
            for i, (_, kind, n, first) in enumerate(rounds.values()):
                if kind == "ema" or int(b) + t >= first + n - 1:
                    out[i][at] = now[i]
    return out


def _chunk_maps(df: DataFrame, rounds: dict, chunk_bars: int) -> DataFrame:
    """(series, chunk, value that each smoothing carries into it): a chunk's affine map y -> a*y + b has
    b as a weighted sum over its bars and a known from the bars' numbers. Of the chunks before only
    those that still weigh anything in a double are composed."""
    last = (F.col(CHUNK) + 1) * chunk_bars
    sums = []
    for name, (x, kind, n, first) in rounds.items():
        r, k = _decay(kind, n), F.col("rn") - first + 1
        if kind == "ema":
            weight = F.pow(F.lit(r), last - F.col("rn")) * F.when(k == 1, F.lit(1.0)).otherwise(F.lit(1.0 - r))
        else:
            weight = F.when(k >= 1, F.pow(F.lit(r), F.least(last - F.col("rn"), F.greatest(F.lit(0), last - (first + n - 1)))) / n).otherwise(F.lit(0.0))
        sums.append(F.sum(weight * F.coalesce(x, F.lit(0.0))).alias(name))
    maps = df.groupBy(SERIES_KEY, CHUNK).agg(*sums)
    reach = max(math.ceil((math.log(1e40) / -math.log(_decay(kind, n)) + first + n) / chunk_bars) for _, kind, n, first in rounds.values()) + 1
    along = Window.partitionBy(SERIES_KEY).orderBy(CHUNK).rowsBetween(-reach, -1)
    carried = []
    for name, (_, kind, n, first) in rounds.items():
        # bars of a chunk that shrink what is carried: all, or those after the warm-up
        start = F.col(CHUNK) * chunk_bars
        shrinks = F.lit(chunk_bars) if kind == "ema" else F.least(F.lit(chunk_bars), F.greatest(F.lit(0), last - (first + n - 1)))
        a = F.when((start == 0) & F.lit(kind == "ema"), F.lit(0.0)).otherwise(F.pow(F.lit(_decay(kind, n)), shrinks))
        listed = F.collect_list(F.struct(a.alias("a"), F.col(name).alias("b"))).over(along)
        carried.append(F.aggregate(listed, F.lit(0.0), lambda y, m: m["a"] * y + m["b"]).alias(f"_in_{name}"))
    return maps.select(SERIES_KEY, CHUNK, *carried)


def _smoothed(df: DataFrame, rounds: dict, chunk_bars: int | None, stepped: bool = False, frames: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each smoothing of ``rounds`` and each of ``frames``. Without chunks its rows stand
    in the order of the windows, or (``stepped``) of an earlier round, which keeps it without Spark's knowing.
    Chunks still hold their copies where there are frames, and then there are no ``rounds``."""
    frames = frames or []
    if not rounds and not frames:
        return df
    if frames and chunk_bars is not None:
        df = df.sortWithinPartitions(SERIES_KEY, CHUNK, "t_stamp")
        opens, carried = F.row_number().over(Window.partitionBy(SERIES_KEY, CHUNK).orderBy("t_stamp")) == 1, {}
    elif chunk_bars is None:
        df = df if stepped else df.sortWithinPartitions(SERIES_KEY, "t_stamp")  # as the windows left it: no sort is added
        opens, carried = F.col("rn") == 1, {f"_in_{name}": F.lit(0.0) for name in rounds}
    else:
        df = _staged(df, "indicator-round")
        df = (df.join(_chunk_maps(df, rounds, chunk_bars), [SERIES_KEY, CHUNK])
              .repartition(SERIES_KEY, CHUNK).sortWithinPartitions(SERIES_KEY, CHUNK, "t_stamp"))
        opens, carried = F.pmod(F.col("rn") - 1, F.lit(chunk_bars)) == 0, {f"_in_{name}": F.col(f"_in_{name}") for name in rounds}
    names, inputs, into = [c for c in df.columns if c not in carried], [x for x, *_ in rounds.values()], list(carried)
    df = df.select(*names, opens.alias("_opens"), *[c.alias(k) for k, c in carried.items()])
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, T.DoubleType(), True) for c in [*rounds, *frames])])
    framed = list(dict.fromkeys(FRAMES[c][1] for c in frames))

    def floats(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(np.float64)

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number, starts = table.column("rn").to_numpy(), table.column("_opens").to_numpy().astype(bool)
        made = smooth_block(rounds, number, starts,
                            [floats(table, x) for x in inputs], [floats(table, k) for k in into]) if rounds else []
        out = table.select(names)
        for name, values in zip(rounds, made):
            out = out.append_column(name, pa.array(values, mask=np.isnan(values)))
        given = {c: table.column(c).cast(pa.float64(), safe=False) for c in framed}
        sums = frame_block(frames, number, starts, {c: x.fill_null(0.0).to_numpy() for c, x in given.items()},
                           {c: x.is_valid().to_numpy() for c, x in given.items()}) if frames else {}
        for name, (values, missing) in sums.items():
            out = out.append_column(name, pa.array(values, mask=missing, from_pandas=False))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("_opens")).to_numpy(zero_copy_only=False))
            if size >= BLOCK_BARS and len(starts):
                cut = int(starts[-1])  # chunks up to here are whole
                held.append(batch.slice(0, cut))
                yield from block(pa.Table.from_batches(held))
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from block(pa.Table.from_batches(held))

    return df.mapInArrow(run, schema)


def _recurrences(df: DataFrame, columns: list[str], chunk_bars: int | None, frames: list[str] | None = None) -> DataFrame:
    """``df`` (with _pc, _ph, _pl) with the asked recurrence columns and, where there are no chunks, ``frames``."""
    needed = {x for c in columns for x in NEEDS[c]}
    kept = [c for c in df.columns if c not in ("_pc", "_ph", "_pl")]
    first = {k: v for k, v in FIRST_ROUND.items() if k in needed}
    second = {k: v for k, v in SECOND_ROUND.items() if k in needed}
    df = _smoothed(_inputs(df).select(*kept, *dict.fromkeys(x for x, *_ in first.values() if x != "close")), first, chunk_bars, frames=frames)
    made = {}
    if "ema_26" in needed and "ema_12" in needed:
        made["macd"] = F.col("ema_12") - F.col("ema_26")
    if "adx" in needed:
        share = lambda c: F.when(F.col("_range") != 0, F.col(c) * 100.0 / F.col("_range")).otherwise(F.lit(0.0))
        both = share("_plus") + share("_minus")
        dx = F.when(both != 0, F.abs(share("_plus") - share("_minus")) * 100.0 / both).otherwise(F.lit(0.0))
        made["_dx"] = F.when(F.col("_range").isNotNull(), dx)
    df = _smoothed(df.withColumns(made) if made else df, second, chunk_bars, bool(first or frames))
    last = {"macd_histogram": lambda: F.col("macd") - F.col("macd_signal"),
            "rsi_14": lambda: F.when(F.col("_gain").isNull(), None).when(F.col("_loss") == 0, F.lit(100.0))
            .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("_gain") / F.col("_loss")))}
    return df.select(*kept, *(frames or []), *[last[c]().alias(c) if c in last else F.col(c) for c in columns])


BAR_COLUMNS = [SERIES_KEY, "symbol_id", "time_frame", "t_stamp", "data_source", "open", "high", "low", "close",
               "volume"]
WINDOW_COLUMNS = ["sma_5", "sma_10", "sma_20", "sma_50", "sma_200", "bollinger_upper", "bollinger_middle",
                  "bollinger_lower", "stoch_k", "stoch_d", "williams_r", "volume_sma_20", "obv", "cci"]


def _asked(columns: list[str] | None) -> list[str]:
    return [c for c in RECURRENCE_COLUMNS if columns is None or c in columns]


def recurrence_indicators(bars: DataFrame, columns: list[str] | None = None, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """The bars with the asked recurrence ``columns`` (default: all)."""
    b = numbered(bars, chunk_bars)
    w = b.window()
    df = b.rows.withColumns({"_pc": F.lag("close").over(w), "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w)})
    out = _recurrences(b.own(df), _asked(columns), b.chunk_bars)
    return out.select(*BAR_COLUMNS, *_asked(columns))


def all_indicators(bars: DataFrame, window_cols: list[str] | None = None, columns: list[str] | None = None,
                   chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """Window frames, then the recurrences over their output, on one partitioning. ``columns`` names
    the recurrence columns to compute, ``window_cols`` the window columns to keep."""
    b = numbered(bars, chunk_bars)
    asked = WINDOW_COLUMNS if window_cols is None else window_cols
    tp = ["_tp"] if "cci" in asked else []
    plain = [c for c in asked if c not in FRAME_NEEDS]
    if b.chunk_bars is None:  # one pass for frames and recurrences
        df = _windows(b).select(*BAR_COLUMNS, "rn", *tp, "_pc", "_ph", "_pl", *plain)
        df = _recurrences(df, _asked(columns), None, _frames(asked))
    else:
        df = b.own(_framed(_windows(b), asked, b.chunk_bars, ("_pc", "_ph", "_pl"))).drop(HALO_ROW)
        if "obv" in asked:
            df = _obv_carried(_staged(df, "indicator-windows"))
        df = _recurrences(df, _asked(columns), b.chunk_bars)
    return df.select(*BAR_COLUMNS, *_window_columns(asked), *_asked(columns))


# --------------------------------------------------------------------------- assembly
def technical_indicators(candles: DataFrame) -> DataFrame:
    """The full technical_indicators row per (symbol_id, timestamp, time_frame)."""
    from .. import schemas as S

    ind = all_indicators(series_bars(candles))
    listed = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in S.TIMEFRAMES]), F.col("time_frame")), F.lit(0))
    return ind.select(
        # surrogate id from the key, no extra shuffle: bars are >= 1 minute apart, so (symbol, listed
        # time frame, minute since epoch) is unique; 2^26 minutes reach the year 2097. Other time
        # frames get a negative hash of the key.
        F.when(listed > 0, (F.col("symbol_id").cast("bigint") * 16 + listed) * (1 << 26) + F.floor(F.unix_seconds("t_stamp") / 60))
        .otherwise(-F.abs(F.shiftright(F.xxhash64(SERIES_KEY, "t_stamp"), 1)) - 1).cast("bigint").alias("id"),
        "symbol_id", F.col("t_stamp").alias("timestamp"), "time_frame",
        *S.INDICATOR_COLUMNS,
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def latest_per_key(df: DataFrame, key: list[str], ts_col: str = "ts", id_col: str = "id") -> DataFrame:
    """Newest row per key by (ts, id): a partial-aggregable max_by, no sort."""
    others = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(ts_col, id_col)).alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])
