"""Candidates by catalog, volume and price; ranks; and what is latest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ratio
from .running import previous

#: Endings of leveraged tokens, and base assets that are pegged.
LEVERAGED = ("UP", "DOWN", "BULL", "BEAR")
PEGGED = ("USDC", "FDUSD", "TUSD", "DAI", "USDP", "BUSD", "EUR", "GBP", "AEUR")


def tradable(symbols: DataFrame, quote: str = "USDT") -> DataFrame:
    """Spot symbols that trade against the quote asset, without leveraged and pegged bases."""
    base = F.col("base_asset")
    return symbols.filter((F.col("status") == "TRADING") & F.col("is_spot_trading_allowed") & (F.col("quote_asset") == quote) & ~base.rlike("(" + "|".join(LEVERAGED) + ")$") & ~base.isin(*PEGGED))


def candidates(symbols: DataFrame, tickers: DataFrame, least_volume: float, least_price: float, quote: str = "USDT") -> DataFrame:
    """Tradable symbols with a 24-hour ticker at or over both floors."""
    live = tickers.filter((F.col("quote_volume") >= least_volume) & (F.col("last_price") >= least_price))
    return tradable(symbols, quote).select("symbol", "base_asset").join(live.select("symbol", "quote_volume", "last_price"), "symbol")


def top_by_volume(found: DataFrame, n: int, without: str | None = None) -> DataFrame:
    rows = found if without is None else found.filter(F.col("symbol") != without)
    return rows.orderBy(F.desc("quote_volume"), "symbol").limit(n)


def config_rollup(folds: DataFrame, keys: tuple[str, ...] = ("config",)) -> DataFrame:
    """Folds won and in all, mean and least profit factor, total P&L, and the profit factor of all folds' sums."""
    out = folds.groupBy(*keys).agg(
        F.count_if("wins").alias("folds_won"), F.count(F.lit(1)).alias("folds"), F.avg("profit_factor").alias("mean_pf"), F.min("profit_factor").alias("min_pf"),
        F.sum("total_pnl").alias("total_pnl"), F.sum("gross_profit").alias("gp"), F.sum("gross_loss").alias("gl"),
    )
    return out.withColumn("pooled_pf", ratio(F.col("gp"), F.col("gl"))).drop("gp", "gl")


def ranked(rollup: DataFrame, by: tuple[str, ...] = ("folds_won", "mean_pf"), keys: tuple[str, ...] = ("config",)) -> DataFrame:
    return rollup.orderBy(*[F.desc(c) for c in by], *keys)


def judged(candidate: DataFrame, baseline: DataFrame, key: list[str], min_trades: int = 30, min_pf: float = 1.0, better_by: float = 0.0, worse_by: float = 0.0) -> DataFrame:
    """Every fold's first failing gate, or null if the candidate wins: enough trades, a loss at all, a profit factor of
    min_pf, more than the baseline's, and a drawdown that isn't worse."""
    b = baseline.select(*key, F.col("profit_factor").alias("b_pf"), F.col("max_drawdown").alias("b_dd"))
    rows = candidate.join(b, key)
    reason = (
        F.when(F.col("n") < min_trades, "too_few_trades").when((F.col("n") > 0) & (F.col("gross_loss") == 0), "no_loss").when(F.col("profit_factor") < min_pf, "not_profitable")
        .when(F.col("profit_factor") <= F.col("b_pf") + better_by, "not_over_baseline").when(F.col("max_drawdown") > F.col("b_dd") + worse_by, "deeper_drawdown")
    )
    return rows.withColumn("reason", reason).withColumn("wins", F.col("reason").isNull())


def promoted(folds: DataFrame, keys: tuple[str, ...] = ("config",)) -> DataFrame:
    """Whether every fold of a configuration wins; without folds there is no row, which is no promotion."""
    return folds.groupBy(*keys).agg((F.bool_and("wins") & (F.count(F.lit(1)) > 0)).alias("promoted"))


def permutation_test(scores: DataFrame, keys: tuple[str, ...] = ("config",)) -> DataFrame:
    """p = (k + 1) / (N + 1) with k of N permuted scores (is_real false) at or over the real one; least, upper median and
    largest of the permuted."""
    real = scores.filter("is_real").groupBy(*keys).agg(F.max("score").alias("real"))
    null = scores.filter("NOT is_real").join(F.broadcast(real), list(keys))
    out = null.groupBy(*keys, "real").agg(
        ((F.count_if(F.col("score") >= F.col("real")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.min("score").alias("null_min"),
        F.sort_array(F.collect_list("score")).alias("s"), F.max("score").alias("null_max"),
    )  # permutations are some dozens
    return out.withColumn("null_median", F.get("s", F.expr("size(s) div 2"))).drop("s")


def open_entries(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """Per symbol the latest filled entry order that no closed trade names."""
    filled = orders.filter("purpose = 'entry' AND status IN ('FILLED', 'PARTIALLY_FILLED') AND avg_fill_price IS NOT NULL AND filled_qty > 0")
    left = filled.join(trades.select(F.col("entry_order_id").alias("client_order_id")), "client_order_id", "left_anti")
    return left.groupBy("symbol").agg(F.max_by(F.struct("client_order_id", "created_at"), F.struct("created_at", "client_order_id")).alias("o")).select("symbol", "o.*")


def latest_stop_after(orders: DataFrame, entries: DataFrame) -> DataFrame:
    """Per symbol the latest stop order created at or after its open entry."""
    after = entries.select("symbol", F.col("created_at").alias("since"))
    rows = orders.filter("purpose = 'stop_loss'").join(after, "symbol").filter("created_at >= since")
    return rows.groupBy("symbol").agg(F.max_by(F.struct("client_order_id", "created_at"), F.struct("created_at", "client_order_id")).alias("o")).select("symbol", "o.*")


def latest_unacknowledged(events: DataFrame, time_col: str = "triggered_at", id_col: str = "id") -> DataFrame:
    return events.filter("acknowledged_at IS NULL").orderBy(F.desc(time_col), F.desc(id_col)).limit(1)


def recent(events: DataFrame, n: int, time_col: str = "ts", id_col: str = "id") -> DataFrame:
    return events.orderBy(F.desc(time_col), F.desc(id_col)).limit(n)


def correlations(bars: DataFrame, reference: str) -> DataFrame:
    """Correlation of every other symbol's simple returns with the reference's, by time; null under three common returns or
    without variance. A zero price gives no return."""
    prev = F.col("_prev.close")
    bars = previous(bars.select("symbol", "ts", "close"), ["symbol"], F.expr("ts div 86400000"), ["ts"], ["close"], "_prev")
    r = bars.select("symbol", "ts", F.when(prev != 0, F.col("close") / F.when(prev != 0, prev) - 1).alias("r")).dropna()
    ref = r.filter(F.col("symbol") == reference).select("ts", F.col("r").alias("ref"))
    varied = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("r") > 0) & (F.stddev_pop("ref") > 0)
    return r.filter(F.col("symbol") != reference).join(ref, "ts").groupBy("symbol").agg(F.when(varied, F.corr("r", "ref")).alias("correlation"))


def screen(symbols: DataFrame, tickers: DataFrame, bars: DataFrame, reference: str, n: int, least_volume: float, least_price: float, quote: str = "USDT") -> DataFrame:
    """The n candidates of the largest volume, without the reference, with their correlation to it."""
    top = top_by_volume(candidates(symbols, tickers, least_volume, least_price, quote), n, reference)
    return top.join(correlations(bars, reference), "symbol", "left")
