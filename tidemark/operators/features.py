"""The feature table: price-relative indicators, coarser time frames, relative strength, and what models need of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

from . import indicators, running
from .running import previous

#: Features that a model needs; a row that lacks one is warming up.
REQUIRED = (
    "ema_fast_dist_pct", "ema_slow_dist_pct", "ema_cross_pct", "rsi", "macd_pct", "macd_signal_pct", "macd_hist_pct", "pct_b", "rel_volume", "realized_vol", "atr_pct",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)


def _over_close(x: Column) -> Column:
    close = F.col("close")
    return F.when(close != 0, x / F.when(close != 0, close))


def price_relative(rows: DataFrame) -> DataFrame:
    """Levels of the indicators as shares of the close; null where the indicator is, or the close is 0."""
    c = F.col
    return rows.withColumns({
        "ema_fast_dist_pct": _over_close(c("close") - c("ema_fast")), "ema_slow_dist_pct": _over_close(c("close") - c("ema_slow")), "ema_cross_pct": _over_close(c("ema_fast") - c("ema_slow")),
        "macd_pct": _over_close(c("macd")), "macd_signal_pct": _over_close(c("macd_signal")), "macd_hist_pct": _over_close(c("macd_hist")), "atr_pct": _over_close(c("atr")),
    })


def coarse(bars: DataFrame, bucket_ms: int) -> DataFrame:
    """Bars of wider buckets: high, low, volume and last close of what they hold."""
    rows = bars.groupBy("symbol", (F.expr(f"ts div {bucket_ms}") * bucket_ms).alias("bucket")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return rows.withColumnRenamed("bucket", "ts")


def on_finished_buckets(bars: DataFrame, coarse_rows: DataFrame, bucket_ms: int, cols: dict[str, str]) -> DataFrame:
    """bars with columns of the last bucket that was finished before each bar's own: that before it among those present.

    cols maps columns of coarse_rows to new names; nulls replace older values, as a bucket without a value has none.
    """
    seen = previous(coarse_rows, ["symbol"], F.expr(f"ts div {max(indicators.DAY_MS, 1000 * bucket_ms)}"), ["ts"], list(cols), "_prev")
    before = seen.select("symbol", F.col("ts").alias("_bucket"), *[F.col(f"_prev.{c}").alias(n) for c, n in cols.items()])
    return bars.withColumn("_bucket", F.expr(f"ts div {bucket_ms}") * bucket_ms).join(before, ["symbol", "_bucket"], "left").drop("_bucket")


def multi_timeframe(bars: DataFrame, frames: dict[str, int]) -> DataFrame:
    """bars with rsi_<name> and pct_b_<name> of each coarser frame (name to milliseconds), as of its last finished bucket."""
    out = bars
    for name, ms in frames.items():
        rows = coarse(bars, ms)
        held = written(indicators.with_recurrences(rows).select("symbol", "ts", "close", "rsi"), "coarse")
        held = written(indicators.plain(indicators.with_halo(held).withColumn("pct_b", indicators.bollinger()["pct_b"])), "coarse")
        out = on_finished_buckets(out, held, ms, {"rsi": f"rsi_{name}", "pct_b": f"pct_b_{name}"})
    return out


def relative_strength(bars: DataFrame, reference: str, n: int = 15, allow_exact_match: bool = True) -> DataFrame:
    """Bars of all symbols but the reference with own_return less the latest return of the reference known at the bar.

    The reference's returns are few rows against all symbols' bars; each bar looks its own up by interval: a return holds
    from its bar (or, if exact matches aren't allowed, from after it) until the next one. A null return replaces the one
    before, as the reference may be warming up.
    """
    rows = indicators.plain(indicators.with_halo(bars, n).withColumn("own_return", indicators.window_return("close", n)))
    ref = rows.filter(F.col("symbol") == reference).select("ts", F.struct(F.col("own_return").alias("r")).alias("ref"), F.lit(0 if allow_exact_match else 1).alias("side"), F.lit(None).cast("string").alias("symbol"))
    mine = rows.filter(F.col("symbol") != reference)
    # Times, not rows: each distinct time takes the latest return before it, and bars join their time.
    times = mine.select("ts").distinct().select("ts", F.lit(None).cast(ref.schema["ref"].dataType).alias("ref"), F.lit(1 - (0 if allow_exact_match else 1)).alias("side"), F.lit("t").alias("symbol"))
    day = F.expr("ts div 86400000")
    both = ref.unionByName(times).withColumn("_d", day)
    frame = Window.partitionBy("_d").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last("ref", ignorenulls=True).over(frame))
    days = both.groupBy("_d").agg(F.max_by("ref", F.when(F.col("ref").isNotNull(), F.col("ts"))).alias("_last"))
    carry = days.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)))
    known = inside.filter("symbol = 't'").join(carry.select("_d", "_before"), "_d").select("ts", F.coalesce("_in", "_before")["r"].alias("reference_return"))
    return mine.join(known, "ts").withColumn("relative_strength", F.col("own_return") - F.col("reference_return"))


def merged_streams(one: DataFrame, two: DataFrame, chunk_ms: int = indicators.DAY_MS) -> DataFrame:
    """Two symbols' bars as one stream with ``place``, their order from 1; at one time the first one's bar comes first. Places
    are counted by days and carried over days."""
    both = one.withColumn("_side", F.lit(0)).unionByName(two.withColumn("_side", F.lit(1))).withColumn("_all", F.lit(0))
    placed = running.running(both, ["_all"], F.expr(f"ts div {chunk_ms}"), ["ts", "_side"], F.lit(1), "sum", "place")
    return placed.withColumn("place", F.col("place").cast("long")).drop("_side", "_all")


def feature_table(bars: DataFrame, frames: dict[str, int] | None = None, reference: str | None = None) -> DataFrame:
    """bars with indicators, price-relative features, cyclical time, volatility and relative volume; with rsi_<name> and
    pct_b_<name> of each coarser frame, and, given a reference symbol, which then has no rows of its own, relative strength."""
    rows = bars if reference is None else written(relative_strength(bars, reference).drop("own_return", "reference_return"), "relative")
    rows = written(multi_timeframe(rows, frames), "frames") if frames else rows
    rows = written(price_relative(indicators.with_recurrences(rows)), "recurrences")  # every step reads its input more than once
    b = indicators.bollinger()
    rows = indicators.with_halo(rows).withColumns({"pct_b": b["pct_b"], "bb_mid": b["bb_mid"], "bb_upper": b["bb_upper"], "bb_lower": b["bb_lower"], "rel_volume": indicators.relative_volume(), "ret15": indicators.window_return()})
    return indicators.plain(indicators.volatility_within(rows)).withColumns(indicators.cyclical_time())


def warm(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows with all required features."""
    return rows.dropna(subset=list(required))


def closed_candles(klines: DataFrame) -> DataFrame:
    return klines.filter("is_closed")


def chart_feed(features: DataFrame, n: int = 500) -> DataFrame:
    """The last n candles of every symbol with moving averages, bands and RSI."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    cols = ["symbol", "ts", "open", "high", "low", "close", "ema_fast", "ema_slow", "bb_mid", "bb_upper", "bb_lower", "rsi"]
    return features.withColumn("_n", rank).filter(F.col("_n") <= n).select(*cols)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with ``i``, their number in the symbol from 0, counted by day and carried over days."""
    return running.numbered(rows, ["symbol"], F.expr(f"ts div {indicators.DAY_MS}"), ["ts"])


def fold_rows(rows: DataFrame, folds: DataFrame, warmup: int = 40) -> DataFrame:
    """Rows of every fold's test range with the warm-up rows before it: part is warmup or test. Folds are a few a symbol."""
    f = folds.select("symbol", "fold", "test_start", "test_end")
    near = numbered(rows).join(f, "symbol").filter((F.col("i") >= F.col("test_start") - warmup) & (F.col("i") < F.col("test_end")))
    return near.withColumn("part", F.when(F.col("i") < F.col("test_start"), "warmup").otherwise("test")).drop("test_start", "test_end")


def fit_or_calibration(rows: DataFrame, keys: list[str], fraction: float = 0.2) -> DataFrame:
    """rows (with i, numbered within keys) with part: fit for the first int(n (1 - fraction)), else calibration. A key whose
    parts would be empty is an error."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * (1 - fraction))
    held = rows.join(n, keys).withColumn("_cut", F.when((cut > 0) & (cut < F.col("_n")), cut).otherwise(F.raise_error(F.lit("not enough rows to split into fit and calibration")).cast("bigint")))
    return held.withColumn("part", F.when(F.col("i") < F.col("_cut"), "fit").otherwise("calibration")).drop("_n", "_cut")


def hold_and_flat(bars: DataFrame, capital: float = 1_000_000.0) -> DataFrame:
    """Equity curves of buying at the first close and holding, and of doing nothing."""
    first = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("_first"))
    rows = bars.select("symbol", "ts", "close").join(first, "symbol")
    hold = F.when(F.col("_first") > 0, capital * F.col("close") / F.when(F.col("_first") > 0, F.col("_first"))).otherwise(capital)
    return rows.select("symbol", "ts", hold.alias("hold"), F.lit(capital).alias("flat"))
