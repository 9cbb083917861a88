"""Daily reports over trades and captures."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import net_pnl, share


def weak_hours(trades: DataFrame, keys: tuple[str, ...] = (), least: float = 0.35, sample: int = 10) -> DataFrame:
    """Hours of exit (UTC) whose share of trades with a net gain is under ``least``; preliminary below ``sample`` trades."""
    hour = F.hour(F.timestamp_millis("exit_ts")).alias("hour")
    out = trades.groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("n"), share(net_pnl() > 0).alias("net_win_rate"), F.sum(net_pnl()).cast("double").alias("net_pnl"))
    return out.filter(F.col("net_win_rate") < least).withColumn("preliminary", F.col("n") < sample)


def daily_rows(trades: DataFrame, events: DataFrame, state: str = "PARADO_CIRCUIT_BREAKER") -> DataFrame:
    """A row per day with trades or events: raw and net figures, 0 without trades, and whether an event reached the state."""
    day = lambda c: F.to_date(F.timestamp_millis(c)).alias("day")
    t = trades.groupBy(day("exit_ts")).agg(
        F.count(F.lit(1)).alias("trades"), share(F.col("pnl") > 0).alias("win_rate"), F.sum("pnl").cast("double").alias("pnl"), share(net_pnl() > 0).alias("net_win_rate"),
        F.sum(net_pnl()).cast("double").alias("net_pnl"),
    )
    e = events.groupBy(day("ts")).agg(F.bool_or(F.col("to_state") == state).alias("breaker"))
    zero = {"trades": 0, "win_rate": 0.0, "pnl": 0.0, "net_win_rate": 0.0, "net_pnl": 0.0, "breaker": False}
    return t.join(e, "day", "full").na.fill(zero)


def learning_report(trades: DataFrame, events: DataFrame, freshness: DataFrame) -> DataFrame:
    """daily_rows with the day's weak hours (hour, n, preliminary) and its stale captures, as arrays; most days have few."""
    dated = trades.withColumn("day", F.to_date(F.timestamp_millis("exit_ts")))
    hours = weak_hours(dated, ("day",)).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hour", "n", "preliminary"))).alias("weak_hours"))
    stale = freshness.filter("NOT ok").groupBy("day").agg(F.array_sort(F.collect_list(F.concat_ws("/", "table", "environment"))).alias("stale"))
    return daily_rows(trades, events).join(hours, "day", "left").join(stale, "day", "left")


def realized(trades: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    return trades.groupBy(*keys).agg(F.sum("pnl").cast("double").alias("realized_pnl"))


def in_days(rows: DataFrame, time_col: str, first: str, last: str) -> DataFrame:
    """Rows whose time in milliseconds falls into the days from first to last, both included; a plain range for the scan."""
    ms = lambda d: int(datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp() * 1000)
    return rows.filter(F.col(time_col).between(ms(first), ms(last) + 86_399_999))
