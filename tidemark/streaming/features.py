"""The feature table of closed bars as they come: equal to the batch table of the same bars.

The state of a symbol is what its recurrences carry, a list of its last bars, and for every coarser frame the open bucket,
what its RSI carries and its last closes. A micro-batch is worked on as arrays: recurrences run from their state, windows
slide over the kept bars and the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import features, indicators
from tidemark.operators.indicators import smoothed

#: Bars that windows look back on; bars of the window return.
WINDOW, RETURN = 20, 15
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CARRIED = ("close", "ema_fast", "ema_slow", "ema_trend", "gain", "loss", "tr", "macd_signal", "reference")
_FRAME = ("gain", "loss", "last", "rsi", "pct_b")
MADE = ("ema_fast", "ema_slow", "ema_trend", "rsi", "atr", "macd", "macd_signal", "macd_hist", "trend_regime_pct", "bb_mid", "bb_upper", "bb_lower", "pct_b", "rel_volume", "realized_vol", "ret15")


def _num(x: float | None) -> float:
    return np.nan if x is None else x


def _cell(x: float) -> float | None:
    return None if np.isnan(x) else float(x)


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _mean(windows: np.ndarray) -> np.ndarray:
    """Means of rows, added up from left to right as an aggregation does."""
    return np.cumsum(windows, axis=1)[:, -1] / windows.shape[1]


def _rsi(x: np.ndarray, gain: float, loss: float, before: float, seen: int, n: int) -> tuple[np.ndarray, float, float]:
    """RSI of values behind ``seen`` earlier ones, the last of which is before; and the averages then."""
    step = np.diff(x, prepend=before)
    up, down = np.where(np.isnan(step), np.nan, np.maximum(step, 0)), np.where(np.isnan(step), np.nan, np.maximum(-step, 0))
    g, l = smoothed(up, 1 / n, gain), smoothed(down, 1 / n, loss)
    out = np.where(l == 0, 100.0, 100 - 100 / (1 + _div(g, l)))
    out[np.isnan(l) | (seen + np.arange(1, len(x) + 1) <= n)] = np.nan
    return out, g[-1] if len(g) else gain, l[-1] if len(l) else loss


def _bands(kept: np.ndarray, x: np.ndarray, k: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and %B of the last WINDOW values at each of x; NaN before there are so many."""
    both = np.concatenate([np.full(max(0, WINDOW - 1 - len(kept)), np.nan), kept[max(0, len(kept) - WINDOW + 1) :], x])
    if not len(x):
        return (np.empty(0),) * 3
    w = np.lib.stride_tricks.sliding_window_view(both, WINDOW)
    mid = _mean(w)
    dev = np.where(w.max(axis=1) == w.min(axis=1), 0.0, w.std(axis=1))
    dev[np.isnan(mid)] = np.nan
    return mid, dev, _div(x - (mid - k * dev), 2 * k * dev)


class LiveFeatures(StatefulProcessor):
    """One symbol's features; its rows are its own bars and, marked, those of the reference."""

    def __init__(self, frames: dict[str, int], fast: int, slow: int, trend: int, signal: int, n: int) -> None:
        self.frames, self.lengths = frames, (fast, slow, trend, signal, n)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("carried", "seen bigint, ts bigint, " + ", ".join(f"{c} double" for c in _CARRIED))
        self.recent = handle.getListState("recent", "close double, volume double")
        self.of_reference = handle.getListState("reference", "close double")
        self.by_frame = handle.getMapState("frames", "name string", "seen bigint, bucket bigint, open double, " + ", ".join(f"{c} double" for c in _FRAME) + ", closes array<double>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fast, slow, trend, signal, n = self.lengths
        whole = pd.concat(list(rows)).sort_values(["ts", "side"], kind="stable")
        held = self.carried.get() if self.carried.exists() else None
        seen, last = (held[0], held[1]) if held else (0, None)
        s = dict(zip(_CARRIED, map(_num, held[2:]))) if held else dict.fromkeys(_CARRIED, np.nan)

        ref = whole[whole["side"] == 0]
        before = np.array([r[0] for r in self.of_reference.get()], float) if self.of_reference.exists() else np.empty(0)
        closes = np.concatenate([before, ref["close"].to_numpy(float)])
        base = np.concatenate([np.full(RETURN, np.nan), closes])[len(before) : len(closes)]
        returns = np.concatenate([[s["reference"]], _div(closes[len(before) :], base) - 1])
        if len(ref):
            self.of_reference.put([(float(c),) for c in closes[-RETURN:]])

        bars = whole[whole["side"] == 1].drop_duplicates("ts")
        bars = bars[bars["ts"] > last] if last is not None else bars  # in time; later ones of one time or before it go
        x = {c: bars[c].to_numpy(float) for c in ("high", "low", "close", "volume")}
        ts, m = bars["ts"].to_numpy(np.int64), len(bars)
        at_bar = returns[np.searchsorted(ref["ts"].to_numpy(np.int64), ts, "right")]
        s["reference"] = returns[-1]
        out = pd.DataFrame({"symbol": key[0], "ts": ts, "high": x["high"], "low": x["low"], "close": x["close"], "volume": x["volume"]})
        if m:
            c = x["close"]
            prev = np.concatenate([[s["close"]], c[:-1]])
            alpha = lambda k: 2 / (k + 1)
            f, w, t = (smoothed(c, alpha(k), s[name]) for k, name in ((fast, "ema_fast"), (slow, "ema_slow"), (trend, "ema_trend")))
            sig = smoothed(f - w, alpha(signal), s["macd_signal"])
            out["ema_fast"], out["ema_slow"], out["ema_trend"], out["macd"], out["macd_signal"], out["macd_hist"] = f, w, t, f - w, sig, f - w - sig
            out["trend_regime_pct"] = _div(c - t, c)
            out["rsi"], s["gain"], s["loss"] = _rsi(c, s["gain"], s["loss"], s["close"], seen, n)
            wide = np.fmax(x["high"] - x["low"], np.fmax(np.abs(x["high"] - prev), np.abs(x["low"] - prev)))
            tr = smoothed(wide, 1 / n, s["tr"])
            number = seen + np.arange(1, m + 1)
            out["atr"] = np.where(number >= n, tr, np.nan)
            kept = list(self.recent.get()) if self.recent.exists() else []
            old, vol = np.array([r[0] for r in kept], float), np.array([r[1] for r in kept], float)
            mid, dev, out["pct_b"] = _bands(old, c)
            out["bb_mid"], out["bb_upper"], out["bb_lower"] = mid, mid + 2 * dev, mid - 2 * dev
            both, volumes = np.concatenate([old, c]), np.concatenate([vol, x["volume"]])
            pad = lambda v, k: np.concatenate([np.full(k, np.nan), v])
            behind = np.lib.stride_tricks.sliding_window_view(pad(volumes, WINDOW), WINDOW)[len(old) : len(old) + m]
            out["rel_volume"] = _div(x["volume"], _mean(behind))
            gone = pad(both, 1)[:-1]
            good = (both > 0) & (gone > 0)
            logs = np.log(np.divide(both, gone, out=np.full(len(both), np.nan), where=good))
            out["realized_vol"] = np.lib.stride_tricks.sliding_window_view(pad(logs, WINDOW - 1), WINDOW)[len(old) :].std(axis=1)
            out["ret15"] = _div(c, pad(both, RETURN)[len(old) : len(old) + m]) - 1
            for name, ms in self.frames.items():
                out[f"rsi_{name}"], out[f"pct_b_{name}"] = self._frame(name, ms, ts, c, n)
            self.recent.put([(float(a), float(b)) for a, b in zip(both[-WINDOW:], volumes[-WINDOW:])])
            s |= {"close": c[-1], "ema_fast": f[-1], "ema_slow": w[-1], "ema_trend": t[-1], "tr": tr[-1], "macd_signal": sig[-1]}
            seen, last = seen + m, int(ts[-1])
            out["relative_strength"] = out["ret15"].to_numpy() - at_bar
        self.carried.update((seen, last, *[_cell(s[k]) for k in _CARRIED]))
        if m:
            yield out

    def _frame(self, name: str, ms: int, ts: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """RSI and %B of the last bucket finished before each bar's own."""
        held = self.by_frame.getValue((name,)) if self.by_frame.containsKey((name,)) else None
        seen, bucket, open_ = held[:3] if held else (0, None, None)
        s = dict(zip(_FRAME, map(_num, held[3:-1]))) if held else dict.fromkeys(_FRAME, np.nan)
        kept = np.array(held[-1] if held else [], float)
        own = ts // ms * ms
        every = np.concatenate([[bucket], own]).astype(np.int64) if held else own
        closes = np.concatenate([[open_], c]) if held else c
        ends = np.flatnonzero(np.append(np.diff(every) != 0, False))  # the last bar of each finished bucket
        done, x = every[ends], closes[ends]
        rsi, s["gain"], s["loss"] = _rsi(x, s["gain"], s["loss"], s["last"], seen, n)
        _, _, pct_b = _bands(kept, x)
        at = np.searchsorted(done, own, "left")
        out = tuple(np.concatenate([[s[k]], v])[at] for k, v in (("rsi", rsi), ("pct_b", pct_b)))
        if len(x):
            s |= {"last": x[-1], "rsi": rsi[-1], "pct_b": pct_b[-1]}
        kept = np.concatenate([kept, x])[-(WINDOW - 1) :]
        self.by_frame.updateValue((name,), (seen + len(x), int(every[-1]), float(closes[-1]), *[_cell(s[k]) for k in _FRAME], kept.tolist()))
        return out


def live_features(
    bars: DataFrame, frames: dict[str, int], reference: str | None = None, symbols: list[str] | None = None,
    fast: int = 12, slow: int = 26, trend: int = 240, signal: int = 9, n: int = 14,
) -> DataFrame:
    """The rows of features.feature_table() for a stream of closed bars (symbol, ts, high, low, close, volume).

    A symbol's bars must not come in a later micro-batch than bars of a later time; those that do, and bars that repeat a
    time, are left out. With a reference, symbols names those that are followed: the reference's bars are sent to each of
    them, and its latest return at a bar's time is that of its bars that have come by then. States are kept by RocksDB, which
    the session is set to.
    """
    bars.sparkSession.conf.set(*_PROVIDER)
    cols = ["symbol", "ts", "high", "low", "close", "volume"]
    rows = bars.select(*cols, F.lit(1).alias("side"))
    if reference is not None:
        if not symbols:
            raise ValueError("name the symbols that follow the reference")
        to = F.when(F.col("symbol") == reference, F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(0).alias("side")) for s in symbols if s != reference]))
        to = F.coalesce(to, F.array(F.struct("symbol", F.lit(1).alias("side"))))
        rows = bars.select(*cols[1:], F.explode(to).alias("to")).select("to.symbol", *cols[1:], "to.side")
    more = [*MADE, *[f"{x}_{name}" for name in frames for x in ("rsi", "pct_b")], "relative_strength"]
    schema = "symbol string, ts bigint, high double, low double, close double, volume double, " + ", ".join(f"`{c}` double" for c in more)
    made = rows.groupBy("symbol").transformWithStateInPandas(LiveFeatures(frames, fast, slow, trend, signal, n), schema, "append", "none")
    made = made.select(*cols, *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in more])
    return features.price_relative(made).withColumns(indicators.cyclical_time())
