"""Order flow: trade buckets, roll-ups, additive merges, gaps in ids and in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .running import BLOCK, block_window, haloed, inside, previous, running

DAY_MS = 86_400_000


def _bucket(ts: str, ms: int):
    return F.expr(f"{ts} div {ms}") * ms


def _vwap():
    volume = F.col("buy_volume") + F.col("sell_volume")
    return F.when(volume > 0, F.col("notional").cast("double") / F.when(volume > 0, volume.cast("double"))).otherwise(0.0)


def flow_buckets(trades: DataFrame, bucket_ms: int = 1000, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Buy and sell volume and count, notional and vwap per key and bucket; a buyer that is the maker means a sell."""
    sell = F.col("is_buyer_maker")
    q = F.col("quantity")
    return trades.groupBy(*keys, _bucket("ts", bucket_ms).alias("bucket")).agg(
        F.sum(F.when(~sell, q).otherwise(0)).alias("buy_volume"), F.sum(F.when(sell, q).otherwise(0)).alias("sell_volume"),
        F.count_if(~sell).alias("buy_count"), F.count_if(sell).alias("sell_count"), F.sum(F.col("price") * q).alias("notional"),
    ).withColumn("vwap", _vwap())


def merge_buckets(*parts: DataFrame, keys: tuple[str, ...] = ("symbol",), bucket_ms: int = 1) -> DataFrame:
    """Partials are additive: late or back-filled buckets, or finer ones, add up, and vwap follows from the sums."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = [F.sum(c).alias(c) for c in ("buy_volume", "sell_volume", "buy_count", "sell_count", "notional")]
    return every.groupBy(*keys, _bucket("bucket", bucket_ms).alias("bucket")).agg(*sums).withColumn("vwap", _vwap())


def imbalance():
    total = F.col("buy_volume") + F.col("sell_volume")
    return F.when(total > 0, (F.col("buy_volume") - F.col("sell_volume")).cast("double") / F.when(total > 0, total.cast("double"))).otherwise(0.0)


def as_doubles(buckets: DataFrame) -> DataFrame:
    """Sums that were exact decimals, as doubles."""
    return buckets.withColumns({c: F.col(c).cast("double") for c in ("buy_volume", "sell_volume", "notional") if c in buckets.columns})


def id_gaps(rows: DataFrame, id_col: str = "id", order: tuple[str, ...] = ("ts", "id"), hole: int = 50_000, chunk_ms: int = DAY_MS) -> DataFrame:
    """Missing ids per symbol in order of arrival; nothing where an id goes back. Wide gaps are flagged as holes."""
    seen = previous(rows, ["symbol"], F.expr(f"ts div {chunk_ms}"), list(order), [id_col])
    gaps = seen.withColumn("prev", F.col(f"prev.{id_col}")).filter(F.col(id_col) - F.col("prev") > 1)
    missing = F.col(id_col) - F.col("prev") - 1
    return gaps.select("symbol", (F.col("prev") + 1).alias("expected_from"), F.col(id_col).alias("found"), missing.alias("missing"), (missing > hole).alias("is_hole"))


def silences(rows: DataFrame, limit_ms: int = 10_000, chunk_ms: int = DAY_MS) -> DataFrame:
    """Times without a message for longer than the limit."""
    seen = previous(rows, ["symbol"], F.expr(f"ts div {chunk_ms}"), ["ts", "id"], ["ts"])
    seen = seen.withColumn("since", F.col("prev.ts")).filter(F.col("ts") - F.col("since") > limit_ms)
    return seen.select("symbol", "since", F.col("ts").alias("until"), (F.col("ts") - F.col("since")).alias("silent_ms"))


def accepted(rows: DataFrame, time_col: str = "ts", order: str = "id", chunk: int = 1_000_000) -> DataFrame:
    """Rows later than every earlier accepted one, in order of arrival (a number): duplicates and late rows go."""
    seen = running(rows, ["symbol"], F.expr(f"{order} div {chunk}"), [order], F.col(time_col), "max", "_seen", current=False)
    return seen.filter(F.col("_seen").isNull() | (F.col(time_col) > F.col("_seen"))).drop("_seen")


def sampled(rows: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """The first row of each symbol and bucket."""
    return rows.withColumn("_b", _bucket("ts", bucket_ms)).groupBy("symbol", F.col("_b").alias("bucket")).agg(F.min("ts").alias("ts"), F.min_by("id", F.struct("ts", "id")).alias("id"))


def rate_report(rates: DataFrame, time_col: str, rate_col: str, keys: tuple[str, ...] = ("symbol",), page: int = 1000, latency_s: float = 0.25) -> DataFrame:
    """Percentiles (linear between values), peak and span of rates by key; how long a page of ``page`` messages covers at
    the 99th percentile, and how many serial requests of the given latency fit into that (infinity without a rate)."""
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in ranks.items()])
    span = (F.max(time_col) - F.min(time_col) + 1).alias("span")
    out = quantiles(rates, list(keys), rate_col, wanted, [F.max(rate_col).alias("peak"), span])
    out = out.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("quantile"))).alias(n) for n in ranks], F.max("peak").alias("peak"), F.max("span").alias("span"))
    covered = F.when(F.col("p99") > 0, page / F.when(F.col("p99") > 0, F.col("p99"))).otherwise(float("inf"))
    return out.withColumn("covered", covered).withColumn("headroom", F.col("covered") / latency_s)


def arrival_rates(rows: DataFrame, every_ms: int = 30_000, last: int = 1000) -> DataFrame:
    """One sample per symbol and interval: messages per second over the last ``last`` messages before its end.

    Samples whose messages all have one time are dropped, as are those before ``last`` messages have come.
    """
    held = haloed(rows.select("symbol", "ts", "id"), ["symbol"], F.expr(f"ts div {DAY_MS}"), ["ts", "id"], last - 1, size=max(BLOCK, last))
    seen = inside(held.withColumn("first", F.lag("ts", last - 1).over(block_window(["symbol"], ["ts", "id"]))))
    top = seen.groupBy("symbol", _bucket("ts", every_ms).alias("bucket")).agg(F.max_by(F.struct("ts", "first"), F.struct("ts", "id")).alias("x"))
    span = F.col("x.ts") - F.col("x.first")
    return top.filter(span > 0).select("symbol", "bucket", span.alias("span_ms"), (last * 1000 / span).alias("per_second"))


def capture_freshness(counts: DataFrame, floors: DataFrame) -> DataFrame:
    """Rows per captured table, environment and day against the floor of floors (table, environment, floor): every day of
    the counts is held against every floor, so a table without a row on a day shows 0 and isn't ok."""
    days = counts.select("day").distinct()
    # Floors are settings; each takes all days as one array, of an entry per day.
    every = days.agg(F.collect_set("day").alias("days"))
    due = floors.withColumn("_all", F.lit(0)).join(every.withColumn("_all", F.lit(0)), "_all").select("table", "environment", "floor", F.explode("days").alias("day"))
    held = due.join(counts, ["table", "environment", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return held.select("table", "environment", "day", "n", "floor", (F.col("n") >= F.col("floor")).alias("ok"))
