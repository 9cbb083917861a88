"""Windows over blocks with a halo give what windows over whole keys give, bit by bit, without a shuffle by key alone."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import features, flow, indicators, models, running

DAY = 86_400_000


@pytest.fixture(scope="module")
def bars(spark):
    """Two symbols, one much longer than the other, with gaps of days between bars."""
    at = F.col("id") * 3_600_000 + F.when(F.col("id") % 50 > 40, 3 * DAY).otherwise(0)
    x = lambda k: 100 + F.sin(F.col("id") * k) * 7 + F.pmod(F.col("id") * 37, F.lit(11)) / 3
    rows = spark.range(400).select(F.when(F.col("id") % 8 == 0, "B").otherwise("A").alias("symbol"), (at * 1).cast("long").alias("ts"), x(0.7).alias("close"), F.col("id"))
    rows = rows.withColumns({"high": F.col("close") + 2 + F.pmod("id", F.lit(3)), "low": F.col("close") - 1 - F.pmod("id", F.lit(4)), "open": F.col("close"), "volume": F.pmod("id", F.lit(9)).cast("double")})
    return rows.drop("id").dropDuplicates(["symbol", "ts"])


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size", [21, 32, 4096])
def test_frames_are_those_of_whole_keys(bars, size):
    w = Window.partitionBy("symbol").orderBy("ts")
    frame, ahead = w.rowsBetween(-19, 0), w.rowsBetween(1, 12)
    want = bars.select("symbol", "ts", F.avg("close").over(frame).alias("a"), F.stddev_pop("close").over(frame).alias("d"), F.lag("close", 15).over(w).alias("l"), F.sum("high").over(ahead).alias("h"), (F.row_number().over(w) - 1).cast("long").alias("n"))
    b = running.block_window(["symbol"], ["ts"])
    frame, ahead = b.rowsBetween(-19, 0), b.rowsBetween(1, 12)
    rows = running.haloed(bars, ["symbol"], F.expr(f"ts div {DAY}"), ["ts"], 19, 12, size)
    rows = rows.withColumns({"a": F.avg("close").over(frame), "d": F.stddev_pop("close").over(frame), "l": F.lag("close", 15).over(b), "h": F.sum("high").over(ahead), "n": F.col("_i")})
    assert found(running.inside(rows).select(want.columns)) == found(want)
    with pytest.raises(ValueError):
        running.haloed(bars, ["symbol"], F.lit(0), ["ts"], size + 1, 0, size)


def test_no_window_takes_a_symbol_as_a_whole(bars):
    """Shuffles by symbol alone carry a row per symbol and day, not bars."""
    table = features.feature_table(bars)
    for df in (table, indicators.triple_barrier(bars), flow.arrival_rates(bars.withColumn("id", F.col("ts")), last=10), models.score_noise(bars.withColumn("score", F.col("close")), ["symbol"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in re.findall(r"Window \[.*", plan):
            parts = re.search(r"windowspecdefinition\((.*?) ASC", line)[1].split(", ")
            keys = [p.split("#")[0] for p in parts]
            assert "_block" in keys or "_chunk" in keys or "_before" in line or "_total" in line or "_end" in line, line


@pytest.mark.parametrize("size", [25, 4096])
def test_recurrences_in_blocks(bars, size):
    held = {(r.symbol, r.ts): r for r in indicators.with_recurrences(bars, size=size).collect()}
    for symbol in "AB":
        f = s = sig = g = lo = tr = close = None
        for n, r in enumerate(sorted((r for r in bars.collect() if r.symbol == symbol), key=lambda r: r.ts), 1):
            ema = lambda old, new, k: new if old is None else old + 2 / (k + 1) * (new - old)
            wilder = lambda old, new: new if old is None else old + (new - old) / 14
            if close is not None:
                g, lo = wilder(g, max(r.close - close, 0.0)), wilder(lo, max(close - r.close, 0.0))
            tr = wilder(tr, r.high - r.low if close is None else max(r.high - r.low, abs(r.high - close), abs(r.low - close)))
            f, s, close = ema(f, r.close, 12), ema(s, r.close, 26), r.close
            sig = ema(sig, f - s, 9)
            h = held[symbol, r.ts]
            assert h.ema_fast == pytest.approx(f, rel=1e-12) and h.macd_signal == pytest.approx(sig, rel=1e-9, abs=1e-12)
            assert (h.rsi is None) == (n <= 14) and (h.atr is None) == (n < 14)
            if n > 14:
                assert h.rsi == pytest.approx(100 if lo == 0 else 100 - 100 / (1 + g / lo)) and h.atr == pytest.approx(tr)


def test_too_few_rows_to_walk_forward_is_an_error(spark):
    rows = spark.createDataFrame([("A", k) for k in range(50)] + [("B", k) for k in range(4)], "symbol string, ts long")
    assert indicators.walk_forward(rows.filter("symbol = 'A'")).count() == 5
    with pytest.raises(Exception, match="too few rows"):
        indicators.walk_forward(rows).collect()
