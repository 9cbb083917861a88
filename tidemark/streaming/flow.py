"""Streams of trades, candles and depth; each gives what the batch operator of the same rows gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import flow, store


def live_buckets(trades: DataFrame, bucket_ms: int = 1000, late: str = "1 minute") -> DataFrame:
    """Order-flow buckets of a stream, each sent once when the watermark has passed it; later trades are dropped."""
    rows = trades.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    sell, q = F.col("is_buyer_maker"), F.col("quantity")
    out = rows.groupBy("symbol", F.window("at", f"{bucket_ms} milliseconds").alias("w")).agg(
        F.sum(F.when(~sell, q).otherwise(0)).alias("buy_volume"), F.sum(F.when(sell, q).otherwise(0)).alias("sell_volume"),
        F.count_if(~sell).alias("buy_count"), F.count_if(sell).alias("sell_count"), F.sum(F.col("price") * q).alias("notional"),
    )
    return out.withColumn("bucket", F.unix_millis("w.start")).drop("w")


def append_partials(trades: DataFrame, path: str, checkpoint: str, bucket_ms: int = 1000) -> StreamingQuery:
    """Trades of any lateness: every micro-batch appends its partial buckets, keyed by the batch, which a replay replaces.
    Back-filled trades take the same way; compacted() adds the partials up."""

    def write(batch: DataFrame, number: int) -> None:
        flow.flow_buckets(batch, bucket_ms).drop("vwap").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return trades.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture(trades: DataFrame, path: str, checkpoint: str, bucket_ms: int = 1000) -> StreamingQuery:
    """A stream of trades into the capture store at path, a batch a micro-batch; store.backfill() fills its gaps later, under
    numbers that the stream doesn't reach."""

    def write(batch: DataFrame, number: int) -> None:
        store.capture(batch.select("symbol", "id", "ts", "price", "quantity", "is_buyer_maker"), path, number, bucket_ms)

    return trades.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark, path: str) -> DataFrame:
    """The buckets of all partials below path."""
    return flow.merge_buckets(spark.read.parquet(path).drop("batch"))


def accepted(rows: DataFrame, time_col: str = "open_time") -> DataFrame:
    """Rows whose time is over every earlier accepted one of their symbol, in order of arrival (a column seq); the state is
    one number a symbol."""
    schema = rows.schema
    columns = rows.columns

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        whole = pd.concat(list(parts)).sort_values("seq")
        seen = whole[time_col].cummax().shift(1)
        if last is not None:
            seen = seen.fillna(last).clip(lower=last)
        kept = whole[seen.isna() | (whole[time_col] > seen)]
        top = int(whole[time_col].max())
        state.update((top if last is None else max(top, last),))
        yield kept[columns]

    return rows.groupBy("symbol").applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def sampled(rows: DataFrame, bucket_ms: int = 60_000, late: str = "5 minutes") -> DataFrame:
    """The first row of every symbol and bucket, within the watermark."""
    at = rows.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late).withColumn("bucket", F.expr(f"ts div {bucket_ms}") * bucket_ms)
    return at.dropDuplicatesWithinWatermark(["symbol", "bucket"]).drop("at")


def id_gaps(rows: DataFrame, id_col: str = "id", hole: int = 50_000) -> DataFrame:
    """Missing ids per symbol in order of arrival (a column seq, then the id); the state is the last id."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Parts are numbered from 0 each, so they are worked on by position.
        ids = pd.concat(list(parts), ignore_index=True).sort_values(["seq", id_col])[id_col].to_numpy("int64")
        prev = np.concatenate([[state.get[0] if state.exists else ids[0]], ids[:-1]])
        at = ids - prev > 1
        state.update((int(ids[-1]),))
        found, missing = ids[at], (ids - prev - 1)[at]
        yield pd.DataFrame({"symbol": key[0], "expected_from": prev[at] + 1, "found": found, "missing": missing, "is_hole": missing > hole})

    schema = "symbol string, expected_from bigint, found bigint, missing bigint, is_hole boolean"
    return rows.groupBy("symbol").applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


_STATE = "n bigint, close double, fast double, slow double, trend double, gain double, loss double, tr double, signal double"


def live_indicators(bars: DataFrame, fast: int = 12, slow: int = 26, trend: int = 240, signal: int = 9, n: int = 14) -> DataFrame:
    """EMA, RSI, ATR, MACD and trend regime of closed bars as they come, in order of ts; the state is the last values."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, close, f, s, t, g, lo, tr, sig = state.get if state.exists else (0, *[None] * 8)
        out = []
        whole = pd.concat(list(parts)).sort_values("ts")
        for ts, high, low, c in zip(whole["ts"], whole["high"], whole["low"], whole["close"]):
            count += 1
            ema = lambda old, new, k: new if old is None else old + 2 / (k + 1) * (new - old)
            wilder = lambda old, new: new if old is None else old + (new - old) / n
            if close is not None:
                g, lo = wilder(g, max(c - close, 0.0)), wilder(lo, max(close - c, 0.0))
            tr = wilder(tr, high - low if close is None else max(high - low, abs(high - close), abs(low - close)))
            f, s, t, close = ema(f, c, fast), ema(s, c, slow), ema(t, c, trend), c
            sig = ema(sig, f - s, signal)
            rsi = None if count <= n else 100.0 if lo == 0 else 100 - 100 / (1 + g / lo)
            out.append((key[0], ts, c, f, s, rsi, tr if count >= n else None, f - s, sig, (c - t) / c if c else None))
        state.update((count, close, f, s, t, g, lo, tr, sig))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema_fast", "ema_slow", "rsi", "atr", "macd", "macd_signal", "trend_regime_pct"])

    schema = "symbol string, ts bigint, close double, ema_fast double, ema_slow double, rsi double, atr double, macd double, macd_signal double, trend_regime_pct double"
    return bars.groupBy("symbol").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
