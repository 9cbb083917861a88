"""Domain tables derived from the driver's tables, as DataFrames and as the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: Money and quantities add up as decimals: sums are exact, whatever their order, and become doubles once, at the end.
CENTS, TENTHS = "decimal(18,2)", "decimal(18,1)"
_DAY0 = "timestamp_ntz'1970-01-01 00:00:00'"


def millis(c: str):
    """Milliseconds since 1970 of a timestamp with or without a zone, as UTC; no session setting matters."""
    return F.expr(f"timestampdiff(MILLISECOND, {_DAY0}, cast({c} AS timestamp_ntz))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, id, ts (ms), price, quantity, is_buyer_maker: one aggregated trade per event."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"), F.col("event_id").alias("id"), millis("ts").alias("ts"),
        (F.col("value") + 1).cast(CENTS).alias("price"), (1 + F.coalesce(k, F.lit(0)) / 10).cast(TENTHS).alias("quantity"), F.col("event_type").isin("view", "signup").alias("is_buyer_maker"),
    )


TICKS = """ticks AS (SELECT 'S' || (user_id % 10)::VARCHAR AS symbol, event_id AS id, epoch_us(ts) // 1000 AS ts, (value + 1)::DECIMAL(18,2) AS price,
    (1 + coalesce(json_extract_string(props, '$.k')::INT, 0) / 10)::DECIMAL(18,1) AS quantity, event_type IN ('view', 'signup') AS is_buyer_maker FROM events)"""


def bars(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """OHLCV per symbol and bucket; ts is the bucket's start, empty buckets are absent. Partial aggregation does most."""
    t = ticks(spark, sf_dir)
    key = F.struct("ts", "id")
    price = F.col("price").cast("double")
    return t.groupBy("symbol", (F.expr(f"ts div {bucket_ms}") * bucket_ms).alias("bar")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("quantity").cast("double").alias("volume")
    ).withColumnRenamed("bar", "ts")


BARS = f"""{TICKS}, bars AS (SELECT symbol, ts // {HOUR_MS} * {HOUR_MS} AS ts, arg_min(price, (ts, id))::DOUBLE AS open, max(price)::DOUBLE AS high,
    min(price)::DOUBLE AS low, arg_max(price, (ts, id))::DOUBLE AS close, sum(quantity)::DOUBLE AS volume FROM ticks GROUP BY ALL)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: one per line item, of the run of its supplier; notionals and P&L are exact decimals."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = line.join(orders, line.l_orderkey == orders.o_orderkey)
    entry = F.col("l_extendedprice").cast(CENTS)
    gain = (entry * (F.col("l_tax").cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    return j.select(
        F.concat(F.lit("R"), (F.col("l_suppkey") % 7).cast("string")).alias("run"), F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("leg"),
        millis("o_orderdate").alias("entry_ts"), millis("l_shipdate").alias("exit_ts"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("exit_reason"),
        entry.alias("entry_notional"), (entry + gain).cast("decimal(18,4)").alias("exit_notional"), gain.alias("pnl"),
    )


TRADES = """trades AS (SELECT *, (entry_notional + pnl)::DECIMAL(18,4) AS exit_notional FROM (SELECT 'R' || (l_suppkey % 7)::VARCHAR AS run,
    l_orderkey AS trade_id, l_linenumber AS leg, epoch_us(o_orderdate) // 1000 AS entry_ts, epoch_us(l_shipdate) // 1000 AS exit_ts,
    l_quantity AS size, l_returnflag AS exit_reason, l_extendedprice::DECIMAL(18,2) AS entry_notional,
    (l_extendedprice::DECIMAL(18,2) * (l_tax::DECIMAL(4,2) - l_discount::DECIMAL(4,2)))::DECIMAL(18,4) AS pnl FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, root, trade_date, volume, close, ex_suffix: suppliers as share classes, two to a root."""
    line = table(spark, sf_dir, "lineitem")
    root = F.concat(F.lit("R"), F.lpad(F.expr("l_suppkey div 2").cast("string"), 3, "0"))
    money, shares = F.sum(F.col("l_extendedprice").cast(CENTS)).cast("double"), F.sum(F.col("l_quantity").cast(CENTS)).cast("double")
    return line.groupBy(
        F.concat(root, F.when(F.col("l_suppkey") % 2 == 0, "3").otherwise("4")).alias("ticker"), root.alias("root"), F.to_date("l_shipdate").alias("trade_date")
    ).agg(
        money.alias("volume"), F.when(shares > 0, money / F.when(shares > 0, shares)).otherwise(0.0).alias("close"),
        F.max(F.when(F.col("l_returnflag") == "R", "EB").when(F.col("l_returnflag") == "A", "EX")).alias("ex_suffix"),
    )


PRICES = """prices AS (SELECT 'R' || lpad((l_suppkey // 2)::VARCHAR, 3, '0') || CASE WHEN l_suppkey % 2 = 0 THEN '3' ELSE '4' END AS ticker,
    'R' || lpad((l_suppkey // 2)::VARCHAR, 3, '0') AS root, l_shipdate::DATE AS trade_date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS volume,
    CASE WHEN sum(l_quantity) > 0 THEN sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE ELSE 0 END AS close,
    max(CASE l_returnflag WHEN 'R' THEN 'EB' WHEN 'A' THEN 'EX' END) AS ex_suffix FROM lineitem GROUP BY 1, 2, 3)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, period, category, received, filing_id, version: orders as versioned filings of a company's year."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    key = ["company", "period", "category"]
    rows = o.select(
        F.col("o_custkey").alias("company"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period"), F.col("o_orderstatus").alias("category"),
        F.to_date("o_orderdate").alias("received"), F.col("o_orderkey").alias("filing_id"),
    )
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(*key).orderBy("received", "filing_id")))


FILINGS = """filings AS (SELECT *, row_number() OVER (PARTITION BY company, period, category ORDER BY received, filing_id) AS version FROM (
    SELECT o_custkey AS company, make_date(year(o_orderdate), 12, 31) AS period, o_orderstatus AS category,
    o_orderdate::DATE AS received, o_orderkey AS filing_id FROM orders))"""


def decisions(rows: DataFrame, date_col: str, step: str = "month") -> DataFrame:
    """First days of months or quarters, from the first after the rows' first date to the first after their last."""
    span, n = rows.agg(F.min(date_col).alias("a"), F.max(date_col).alias("b")), {"month": 1, "quarter": 3}[step]
    every = F.expr(f"sequence(cast(date_trunc('{step}', a) AS date) + INTERVAL {n} MONTH, cast(date_trunc('{step}', b) AS date) + INTERVAL {n} MONTH, INTERVAL {n} MONTH)")
    return span.filter("a IS NOT NULL").select(F.explode(every).alias("decision_date"))


def decisions_sql(rows: str, date_col: str, step: str = "month") -> str:
    by = f"INTERVAL {dict(month=1, quarter=3)[step]} MONTH"
    return f"""decisions AS (SELECT unnest(generate_series(date_trunc('{step}', min({date_col})) + {by}, date_trunc('{step}', max({date_col})) + {by}, {by}))::DATE AS decision_date FROM {rows})"""


def closed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as they arrive: id, symbol, purpose, created_at, updated_at, status, filled_qty, avg_fill_price.

    Every event of a user in an hour is a state of that hour's order; the first event says what the order is for.
    """
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.expr(f"cast({_ms()} div {HOUR_MS} AS string)")).alias("client_order_id"),
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        F.when(F.col("event_type") == "purchase", "entry").when(F.col("event_type") == "error", "stop_loss").otherwise("exit").alias("purpose"),
        millis("ts").alias("updated_at"), F.col("event_id").alias("seq"),
        F.when(F.coalesce(k, F.lit(0)) % 3 == 0, "NEW").when(F.coalesce(k, F.lit(0)) % 3 == 1, "PARTIALLY_FILLED").otherwise("FILLED").alias("status"),
        F.coalesce(k, F.lit(0)).alias("filled_qty"), F.col("value").alias("avg_fill_price"),
    )


def _ms() -> str:
    return f"timestampdiff(MILLISECOND, {_DAY0}, cast(ts AS timestamp_ntz))"


ORDERS = f"""states AS (SELECT user_id::VARCHAR || '-' || (epoch_us(ts) // 1000 // {HOUR_MS})::VARCHAR AS client_order_id, 'S' || (user_id % 10)::VARCHAR AS symbol,
    CASE event_type WHEN 'purchase' THEN 'entry' WHEN 'error' THEN 'stop_loss' ELSE 'exit' END AS purpose, epoch_us(ts) // 1000 AS updated_at, event_id AS seq,
    CASE coalesce(json_extract_string(props, '$.k')::INT, 0) % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'PARTIALLY_FILLED' ELSE 'FILLED' END AS status,
    coalesce(json_extract_string(props, '$.k')::INT, 0) AS filled_qty, value AS avg_fill_price FROM events)"""
