"""Technical indicators: windows over blocks of rows with a halo, a chunked affine scan for linear recurrences.

sma, bollinger, relative_volume, log_return and window_return are columns of with_halo() rows, in which a symbol's blocks
lie apart; plain() ends that. realized_volatility, with_recurrences and triple_barrier take and give plain bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

from .running import BLOCK, block_window, haloed, inside

DAY_MS = 86_400_000
#: Rows before a row that the windows of this module reach with their usual lengths.
REACH = 21


def with_halo(bars: DataFrame, before: int = REACH, after: int = 0, size: int = BLOCK) -> DataFrame:
    """Bars in blocks of rows of their symbol, with the rows that frames of a block reach outside it."""
    return haloed(bars, ["symbol"], F.expr(f"ts div {DAY_MS}"), ["ts"], before, after, size)


def plain(rows: DataFrame) -> DataFrame:
    """Bars without what with_halo added."""
    return inside(rows)


def _by():
    return block_window(["symbol"], ["ts"])


def _full(n: int, value: Column, frame) -> Column:
    return F.when(F.count(F.lit(1)).over(frame) >= n, value)


def sma(c: str, n: int) -> Column:
    frame = _by().rowsBetween(-(n - 1), 0)
    return _full(n, F.avg(c).over(frame), frame)


def bollinger(c: str = "close", n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Middle and bands (population deviation) and %B, which is null where the bands meet."""
    frame = _by().rowsBetween(-(n - 1), 0)
    mid, dev = F.avg(c).over(frame), F.stddev_pop(c).over(frame)
    width = 2 * k * dev
    return {
        "bb_mid": _full(n, mid, frame), "bb_upper": _full(n, mid + k * dev, frame), "bb_lower": _full(n, mid - k * dev, frame),
        "pct_b": _full(n, F.when(width > 0, (F.col(c) - (mid - k * dev)) / F.when(width > 0, width)), frame),
    }


def relative_volume(c: str = "volume", n: int = 20) -> Column:
    frame = _by().rowsBetween(-n, -1)
    mean = F.avg(c).over(frame)
    return _full(n, F.when(mean != 0, F.col(c) / F.when(mean != 0, mean)), frame)


def log_return(c: str = "close") -> Column:
    prev = F.lag(c).over(_by())
    return F.when((F.col(c) > 0) & (prev > 0), F.ln(F.when((F.col(c) > 0) & (prev > 0), F.col(c) / prev)))


def window_return(c: str = "close", n: int = 15) -> Column:
    base = F.lag(c, n).over(_by())
    return F.when(base != 0, F.col(c) / F.when(base != 0, base) - 1)


def volatility_within(rows: DataFrame, n: int = 20, c: str = "close") -> DataFrame:
    """with_halo rows, of n rows before or more, with the population deviation of the last n log returns."""
    frame = _by().rowsBetween(-(n - 1), 0)
    return rows.withColumn("_r", log_return(c)).withColumn("realized_vol", F.when(F.count("_r").over(frame) >= n, F.stddev_pop("_r").over(frame))).drop("_r")


def realized_volatility(bars: DataFrame, n: int = 20, c: str = "close") -> DataFrame:
    return plain(volatility_within(with_halo(bars, n), n, c))


def cyclical_time(ts: str = "ts") -> dict[str, Column]:
    at = F.timestamp_millis(ts)
    hour = 2 * F.pi() * (F.hour(at) + F.minute(at) / 60) / 24
    day = 2 * F.pi() * F.weekday(at) / 7
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(day), "dow_cos": F.cos(day)}


def smoothed(x: np.ndarray, a: float, state: float) -> np.ndarray:
    """y = a x + (1 - a) y of the value before, from a state on; without one (NaN) the first x is y. NaN gives NaN."""
    ok = ~np.isnan(x)
    out = np.full(len(x), np.nan)
    v = x[ok]
    if len(v):
        first = np.isnan(state)
        y = pd.Series(v if first else np.concatenate([[state], v])).ewm(alpha=a, adjust=False).mean().to_numpy()
        out[ok] = y if first else y[1:]
    return out


def recurrence(
    df: DataFrame, inputs: dict[str, tuple[str, float]], chunk: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts",
    of_differences: dict[str, tuple[str, str, float]] | None = None,
) -> DataFrame:
    """y = a x + (1 - a) y of the row before, y = x at a key's first x, for each output: (input, a). Null inputs give null.
    of_differences has outputs of the difference of two outputs over one input: (first, second, a).

    A chunk maps the state s to A s + B, that of a difference takes both its outputs' states too. The first pass takes the
    maps of every chunk, a window over the few chunk rows carries the states, and the last pass runs each chunk from its
    own. No task ever holds more than one chunk, so a single long symbol is spread over all its chunks.
    """
    extra = of_differences or {}
    names, columns = [*inputs, *extra], df.columns
    part = df.select(*keys, chunk, order, *dict.fromkeys(x for x, _ in inputs.values()))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        row = {k: [pdf[k].iloc[0]] for k in (*keys, chunk)}
        held = {}
        for n, (x, a) in inputs.items():
            v = pdf[x].to_numpy(float)
            v = v[~np.isnan(v)]
            held[n] = smoothed(v, a, 0.0)
            row[f"{n}_n"], row[f"{n}_x"], row[f"{n}_b"] = [len(v)], [v[0] if len(v) else np.nan], [held[n][-1] if len(v) else 0.0]
        for n, (one, two, a) in extra.items():
            m = len(held[one])
            fade = [smoothed((1 - inputs[x][1]) ** np.arange(1, m + 1), a, 0.0)[-1] if m else 0.0 for x in (one, two)]
            row[f"{n}_b"], row[f"{n}_p"], row[f"{n}_q"] = [smoothed(held[one] - held[two], a, 0.0)[-1] if m else 0.0], [fade[0]], [-fade[1]]
        return pd.DataFrame(row)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = ", ".join(f"`{k}` {types[k]}" for k in (*keys, chunk))
    made = "".join(f", {n}_n bigint, {n}_x double, {n}_b double" for n in inputs) + "".join(f", {n}_b double, {n}_p double, {n}_q double" for n in extra)
    summed = part.groupBy(*keys, chunk).applyInPandas(summary, head + made)

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(chunk)
        state, out = dict.fromkeys(names, np.nan), {n: [] for n in names}
        for row in pdf.to_dict("records"):
            for n in names:
                out[n].append(state[n])
            now = {n: row[f"{n}_x"] if np.isnan(state[n]) else state[n] for n in inputs}  # a key's first x stands for its state
            for n, (one, two, a) in extra.items():
                if count := row[f"{one}_n"]:
                    before = 0.0 if np.isnan(state[n]) else state[n]
                    state[n] = row[f"{n}_b"] + (1 - a) ** count * before + row[f"{n}_p"] * now[one] + row[f"{n}_q"] * now[two]
            for n, (_, a) in inputs.items():
                if count := row[f"{n}_n"]:
                    state[n] = row[f"{n}_b"] + (1 - a) ** count * now[n]
        for n in names:
            pdf[f"{n}_s"] = out[n]
        return pdf[[*keys, chunk, *[f"{n}_s" for n in names]]]

    states = summed.groupBy(*keys).applyInPandas(carried, head + "".join(f", {n}_s double" for n in names))

    def final(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(order)
        state = lambda n: float(right[f"{n}_s"].iloc[0]) if len(right) else np.nan
        for n, (x, a) in inputs.items():
            left[n] = smoothed(left[x].to_numpy(float), a, state(n))
        for n, (one, two, a) in extra.items():
            left[n] = smoothed((left[one] - left[two]).to_numpy(float), a, state(n))
        return left[[*columns, *names]]

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + "".join(f", {n} double" for n in names)
    return df.groupBy(*keys, chunk).cogroup(states.groupBy(*keys, chunk)).applyInPandas(final, schema)


def with_recurrences(bars: DataFrame, size: int = BLOCK, fast: int = 12, slow: int = 26, trend: int = 240, signal: int = 9, n: int = 14) -> DataFrame:
    """EMA, RSI, ATR, MACD and trend regime, in blocks of ``size`` bars. Averages of gains and losses start at the first
    change; RSI is null until n changes and 100 without losses; the first true range is high - low, and ATR is null until n
    bars."""
    prev = F.lag("close").over(_by())
    change = F.col("close") - prev
    rows = with_halo(bars, 1, size=size).withColumns({
        "_gain": F.greatest(change, F.when(change.isNotNull(), 0.0)), "_loss": F.greatest(-change, F.when(change.isNotNull(), 0.0)),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)), "_chunk": F.col("_block"), "_n": F.col("_i") + 1,
    })
    rows = written(plain(rows), "steps")  # read by two passes
    alpha = lambda k: 2 / (k + 1)
    two = recurrence(rows, {
        "ema_fast": ("close", alpha(fast)), "ema_slow": ("close", alpha(slow)), "ema_trend": ("close", alpha(trend)),
        "_g": ("_gain", 1 / n), "_l": ("_loss", 1 / n), "_a": ("_tr", 1 / n),
    }, "_chunk", of_differences={"macd_signal": ("ema_fast", "ema_slow", alpha(signal))}).withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    rs = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.when(F.col("_l") != 0, F.col("_l"))))
    return two.select(
        *bars.columns, "ema_fast", "ema_slow", "ema_trend", F.when(F.col("_n") > n, rs).alias("rsi"), F.when(F.col("_n") >= n, F.col("_a")).alias("atr"), "macd", "macd_signal",
        (F.col("macd") - F.col("macd_signal")).alias("macd_hist"), ((F.col("close") - F.col("ema_trend")) / F.col("close")).alias("trend_regime_pct"),
    )


def triple_barrier(bars: DataFrame, horizon: int = 12, target: float | Column = 0.1, stop: float = 0.05) -> DataFrame:
    """label 1 where, in the next horizon bars, the target is hit before the stop, else 0; both in one bar is 0. The target
    is a share of the close, fixed or a column such as k * atr_pct; a null target is never hit."""
    frame = _by().rowsBetween(1, horizon)
    ahead = F.collect_list(F.struct("high", "low")).over(frame)
    up, down = F.col("close") * (1 + target), F.col("close") * (1 - stop)
    hits = F.transform("_a", lambda b: F.when(b["low"] <= down, 0).when(F.coalesce(b["high"] >= up, F.lit(False)), 1).otherwise(2))
    rows = plain(with_halo(bars, 0, horizon).withColumn("_a", ahead)).filter(F.size("_a") == horizon)
    return rows.withColumn("label", F.coalesce(F.get(F.filter(hits, lambda x: x < 2), F.lit(0)), F.lit(0))).drop("_a")


def walk_forward(rows: DataFrame, folds: int = 5, first: float = 0.4, purge: int = 12) -> DataFrame:
    """symbol, fold, train_end (exclusive, purged), test_start, test_end (exclusive) over row numbers from 0. A symbol with too
    few rows for a test row in every fold is an error."""
    n = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    lead = F.floor(F.col("n") * first)
    size = F.floor((F.col("n") - lead) / folds)
    few = F.raise_error(F.concat(F.lit("too few rows to walk forward: "), F.coalesce("symbol", F.lit("null")))).cast("bigint")
    held = n.withColumn("size", F.when(size > 0, size).otherwise(few))
    f = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return held.withColumn("fold", f).select(
        "symbol", "fold", F.greatest(F.lit(0), lead + F.col("fold") * F.col("size") - purge).alias("train_end"), (lead + F.col("fold") * F.col("size")).alias("test_start"),
        F.when(F.col("fold") == folds - 1, F.col("n")).otherwise(lead + (F.col("fold") + 1) * F.col("size")).alias("test_end"),
    )
