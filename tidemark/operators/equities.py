"""Point-in-time equities: filings as known on a date, corporate events, liquidity and the eligible universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dates(decisions: DataFrame) -> list:
    """Decision dates in order: a few hundred at most, as they are months or quarters."""
    return [r[0] for r in decisions.select("decision_date").distinct().orderBy("decision_date").collect()]


def _as_of(filings: DataFrame, decisions: DataFrame, key: list[str], best: list[str], rest: list[str]) -> DataFrame:
    """For every key and decision date, the filing with the largest ``best`` among those received by then.

    A filing counts from the first decision date that sees it; of each key and such date the best filing stays, by partial
    aggregation, and a later date takes the best of all that came before. No filing meets a date that isn't its own.
    """
    dates = F.array(*[F.lit(d) for d in _dates(decisions)]).cast("array<date>")
    first = F.array_min(F.filter(dates, lambda d: d >= F.col("received")))
    seen = filings.withColumn("_first", first).filter("_first IS NOT NULL")
    value = F.struct(*best, *rest)
    per = seen.groupBy(*key, "_first").agg(F.max_by(value, F.struct(*best)).alias("f"))
    held = per.groupBy(*key).agg(F.collect_list(F.struct(F.col("_first").alias("d"), "f")).alias("h"))  # one entry a date at most
    shown = held.withColumn("decision_date", F.explode(F.filter(dates, lambda d: d >= F.array_min(F.transform("h", lambda x: x["d"])))))
    rank = F.filter("h", lambda x: x["d"] <= F.col("decision_date"))
    top = F.array_max(F.transform(rank, lambda x: x["f"]))  # structs compare by best first
    return shown.withColumn("f", top).select("decision_date", *key, "f.*")


def filing_as_of(filings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Highest version of each (company, period, category) received by the decision date, which counts."""
    return _as_of(filings, decisions, ["company", "period", "category"], ["version"], ["filing_id", "received"])


def latest_filing_as_of(filings: DataFrame, decisions: DataFrame) -> DataFrame:
    """The newest period, then the highest version, visible on the decision date."""
    return _as_of(filings, decisions, ["company", "category"], ["period", "version"], ["filing_id"])


def line_items_as_of(filings: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current-period line items of the version of each filing that is visible on a decision date."""
    seen = filing_as_of(filings, decisions).select("decision_date", "company", "period", "category", "version", "filing_id")
    return seen.join(items.filter("is_current").drop("is_current"), "filing_id")


def _move(before: Column) -> Column:
    """Close over the close before it, less 1; null without one or after one that isn't positive."""
    return F.when(before > 0, F.col("close") / F.when(before > 0, before) - 1)


def corporate_events(prices: DataFrame) -> DataFrame:
    """The first day of each new ex-suffix with the day's return; B and G break the level, EX does from a third on."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    rows = prices.withColumn("prev", F.lag("ex_suffix").over(w)).withColumn("ret", _move(F.lag("close").over(w)))
    rows = rows.filter(F.col("ex_suffix").isNotNull() & ~F.col("ex_suffix").eqNullSafe(F.col("prev")))
    level = F.when(F.col("ex_suffix").rlike("[BG]"), True).when(F.col("ex_suffix") == "EX", F.coalesce(F.abs("ret") >= 0.33, F.lit(False))).otherwise(False)
    return rows.select("ticker", "trade_date", "ex_suffix", level.alias("is_level_break"))


def implausible_moves(prices: DataFrame, events: DataFrame, limit: float = 0.6) -> DataFrame:
    """Day-over-day moves beyond the limit without a level break on that day."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    moves = prices.withColumns({"from_date": F.lag("trade_date").over(w), "from_close": F.lag("close").over(w)}).withColumn("ret", _move(F.col("from_close"))).filter(F.abs("ret") > limit)
    rest = moves.join(events.filter("is_level_break").select("ticker", "trade_date"), ["ticker", "trade_date"], "left_anti")
    return rest.select("ticker", "from_date", "trade_date", "from_close", "close", "ret")


def validity(prices: DataFrame, tolerance_days: int = 180) -> DataFrame:
    """First and last session of a ticker; the end is null unless the market went on for longer than the tolerance. The
    window over all has one row per ticker, of which there are thousands."""
    span = prices.groupBy("ticker").agg(F.min("trade_date").alias("valid_from"), F.max("trade_date").alias("last"))
    return span.withColumn("market", F.max("last").over(Window.partitionBy())).select(
        "ticker", "valid_from", F.when(F.datediff("market", "last") > tolerance_days, F.col("last")).alias("valid_to")
    )


def universe(prices: DataFrame, decisions: DataFrame, least_volume: float, sessions: int = 63, least_sessions: int = 252, reach_days: int = 200) -> DataFrame:
    """Every candidate of every decision date with its median volume and the first gate it fails, null if eligible.

    Candidates traded in the reach before the date; the volume is the upper median of the last sessions; of a root's
    classes the most liquid stays (ties: the smaller ticker); history counts sessions up to the date.
    """
    now = sessions_as_of(prices, decisions, sessions, reach_days)
    liquid = F.col("median_volume") >= least_volume
    best = F.row_number().over(Window.partitionBy("decision_date", "root", liquid).orderBy(F.desc("median_volume"), "ticker"))
    reason = F.when(~liquid, "illiquid").when(best > 1, "less_liquid_class").when(F.col("history") < least_sessions, "short_history")
    return now.select("decision_date", "ticker", "root", "median_volume", "history", reason.alias("reason"))


def sessions_as_of(prices: DataFrame, decisions: DataFrame, sessions: int = 63, reach_days: int = 200) -> DataFrame:
    """Of every ticker that traded in the reach before a decision date: its sessions so far and the upper median volume of
    the last ones. A session is the last one for the dates before the next session, so no session meets other dates, and
    only such sessions' volumes are sorted.
    """
    ticker_day = Window.partitionBy("ticker").orderBy("trade_date")
    dates = F.array(*[F.lit(d) for d in _dates(decisions)]).cast("array<date>")
    until = F.least(F.coalesce(F.date_sub("_next", 1), F.date_add("trade_date", reach_days - 1)), F.date_add("trade_date", reach_days - 1))
    last = ticker_day.rowsBetween(-(sessions - 1), 0)
    rolled = prices.withColumns({"history": F.row_number().over(ticker_day), "_next": F.lead("trade_date").over(ticker_day), "_v": F.collect_list("volume").over(last)})
    held = rolled.withColumn("_d", F.filter(dates, lambda d: (d >= F.col("trade_date")) & (d <= until))).filter("size(_d) > 0")
    median = F.get(F.sort_array("_v"), F.expr("size(_v) div 2"))
    return held.select(F.explode("_d").alias("decision_date"), "ticker", "root", "history", median.alias("median_volume"))
