"""Trade and equity metrics by run."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

from .running import previous, running

#: Share of a notional that an entry or an exit costs.
FEE = Decimal("0.001")
DAY_MS, ORDER = 86_400_000, ["ts", "trade_id", "leg"]
#: Rows of a written curve that a task sorts, about; tasks grow with the curve, not their memory.
TASK_ROWS = 250_000


def ratio(a: Column, b: Column) -> Column:
    """a / b; by 0: infinity for a positive a, else 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, float("inf")).otherwise(0.0)


def fees(rate: Decimal = FEE) -> Column:
    """Fees of both ends of a trade, an exact decimal like its notionals."""
    return F.lit(rate) * (F.col("entry_notional") + F.col("exit_notional"))


def net_pnl(rate: Decimal = FEE) -> Column:
    return F.col("pnl") - fees(rate)


def share(flag: Column) -> Column:
    """Share of rows for which flag holds."""
    return F.count_if(flag) / F.count(F.lit(1))


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Counts, win rate, profits, losses, fees and ratios of every key. Sums are exact and become doubles at the end."""
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0))
    out = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("pnl") > 0).alias("win_rate"), gain.cast("double").alias("gross_profit"), loss.cast("double").alias("gross_loss"),
        F.sum("pnl").cast("double").alias("total_pnl"), F.sum(fees()).cast("double").alias("fees"), F.sum(net_pnl()).cast("double").alias("net_pnl"),
    )
    return out.withColumn("profit_factor", ratio(F.col("gross_profit"), F.col("gross_loss")))


def _parts(rows: DataFrame) -> int:
    """Tasks for written rows, from the counts in their files' footers."""
    return rows.count() // TASK_ROWS + 1


def equity_curve(trades: DataFrame, capital: int = 1_000_000) -> DataFrame:
    """Equity after every trade of a run, in order of exit, written; a day of a run is one task's work."""
    rows = trades.select("run", F.col("exit_ts").alias("ts"), "trade_id", "leg", "pnl")
    rows = written(rows, "pnl")
    rows = running(rows, ["run"], F.expr(f"ts div {DAY_MS}"), ORDER, F.col("pnl"), "sum", "sum", parts=_parts(rows))
    return written(rows.select("run", *ORDER, (F.lit(capital) + F.col("sum")).cast("double").alias("equity")), "curve")


def drawdown(curve: DataFrame) -> DataFrame:
    """Largest fall below the running peak as a share of it, and the longest time under a peak."""
    day = F.expr(f"ts div {DAY_MS}")
    # The largest equity so far and, of points that reach it, the latest time.
    c = running(curve, ["run"], day, ORDER, F.struct("equity", "ts"), "max", "top", parts=_parts(curve)).withColumns({"peak": F.col("top.equity"), "at": F.col("top.ts")})
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.when(F.col("peak") > 0, F.col("peak"))).otherwise(0.0)
    return c.groupBy("run").agg(F.max(fall).alias("max_drawdown"), F.max(F.col("ts") - F.col("at")).alias("longest_ms"))


def curve_volatility(curve: DataFrame) -> DataFrame:
    rows = previous(curve, ["run"], F.expr(f"ts div {DAY_MS}"), ORDER, ["equity"])
    prev = F.col("prev.equity")
    r = F.when(prev > 0, F.col("equity") / F.when(prev > 0, prev) - 1)
    return rows.withColumn("r", r).groupBy("run").agg(F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("volatility"))


def total_return(curve: DataFrame, capital: int = 1_000_000) -> DataFrame:
    """Return over the capital at the last point of every curve."""
    last = curve.groupBy("run").agg(F.max_by("equity", F.struct(*ORDER)).alias("equity"))
    return last.select("run", (F.col("equity") / capital - 1).alias("total_return"))


def return_ratios(curve: DataFrame, capital: int = 1_000_000) -> DataFrame:
    """Total return over the largest fall and over volatility, by the rule of ratio."""
    every = total_return(curve, capital).join(drawdown(curve), "run").join(curve_volatility(curve), "run")
    r = F.col("total_return")
    return every.select("run", r, ratio(r, F.col("max_drawdown")).alias("return_over_drawdown"), ratio(r, F.col("volatility")).alias("return_over_volatility"))


def breaker(curve: DataFrame, window_ms: int = 3_600_000, loss: float = 0.1) -> DataFrame:
    """First time at which equity has fallen by loss from its peak of the last window or of the run; null if never.
    Points of one time count together.

    Points of one time become one before windows: of a time its highest equity counts for the peak, its lowest for the fall.
    The window's peak is taken over chunks of twice the window that overlap by one, so no task holds a whole run.
    """
    day = F.expr(f"ts div {DAY_MS}")
    fell = lambda p, e: F.coalesce((F.col(p) > 0) & ((F.col(p) - F.col(e)) / F.when(F.col(p) > 0, F.col(p)) >= loss), F.lit(False))
    c = running(curve.select("run", *ORDER, "equity"), ["run"], day, ORDER, F.col("equity"), "max", "peak", parts=_parts(curve))
    c = c.groupBy("run", "ts").agg(F.max("equity").alias("high"), F.min("equity").alias("low"), F.max(fell("peak", "equity")).alias("fell"))
    wide = F.explode(F.array_distinct(F.array(F.expr(f"ts div {window_ms}"), F.expr(f"ts div {window_ms}") + 1)))
    recent = Window.partitionBy("run", "_c").orderBy("ts").rangeBetween(-window_ms, 0)
    c = c.withColumn("_c", wide).withColumn("recent", F.max("high").over(recent)).filter(F.col("_c") == F.expr(f"ts div {window_ms}"))
    return c.groupBy("run").agg(F.min(F.when(fell("recent", "low") | F.col("fell"), F.col("ts"))).alias("triggered_at"))


def exposure(trades: DataFrame) -> DataFrame:
    held = F.sum(F.greatest(F.lit(0), F.col("exit_ts") - F.col("entry_ts")))
    span = F.max("exit_ts") - F.min("exit_ts")
    return trades.groupBy("run").agg(held.alias("held"), span.alias("span")).select("run", F.when(F.col("span") > 0, F.least(F.lit(1.0), F.col("held") / F.when(F.col("span") > 0, F.col("span")))).otherwise(0.0).alias("exposure"))


def by_time(trades: DataFrame) -> DataFrame:
    """P&L by hour of exit and by weekday (Monday 0) in one pass."""
    at = F.timestamp_millis("exit_ts")
    rows = trades.select("run", "pnl", F.hour(at).alias("hour"), F.weekday(at).alias("weekday"))
    return rows.groupingSets([["run", "hour"], ["run", "weekday"]], "run", "hour", "weekday").agg(F.sum("pnl").cast("double").alias("pnl"))


def _raw_and_net() -> list[Column]:
    raw, net = F.col("pnl"), net_pnl()
    return [
        F.count(F.lit(1)).alias("n"), share(raw > 0).alias("win_rate"), F.sum(raw).cast("double").alias("pnl"), F.sum(net).cast("double").alias("net_pnl"), share(net > 0).alias("net_win_rate")
    ]


def daily_table(trades: DataFrame) -> DataFrame:
    """A row per day of exit and a TOTAL line: raw and net P&L and win rates."""
    out = trades.withColumn("day", F.to_date(F.timestamp_millis("exit_ts"))).rollup("day").agg(F.grouping("day").alias("g"), *_raw_and_net())
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("day").cast("string")).alias("day"), "n", "win_rate", "pnl", "net_pnl", "net_win_rate")


def by_exit_reason(trades: DataFrame) -> DataFrame:
    """Count, raw and net P&L of every exit reason, most frequent first."""
    return trades.groupBy("exit_reason").agg(*_raw_and_net()).select("exit_reason", "n", "pnl", "net_pnl").orderBy(F.desc("n"), "exit_reason")
