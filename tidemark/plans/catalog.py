"""Named queries over the driver's tables, with the SQL that states each result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import equities, flow, indicators, metrics, screening
from tidemark.sources import adapters as src

from .registry import Query, oracle_sql, queries, query, rounded  # noqa: F401

MIN_VOLUME = 20_000.0


_FLOW = """SELECT symbol, ts // {b} * {b} AS bucket, sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END) AS buy_volume,
    sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS sell_volume, count(*) FILTER (NOT is_buyer_maker) AS buy_count,
    count(*) FILTER (is_buyer_maker) AS sell_count, sum(price * quantity) AS notional FROM ticks GROUP BY ALL"""


@query(f"WITH {src.TICKS}, f AS ({_FLOW.format(b=1000)}) SELECT symbol, bucket, buy_volume::DOUBLE AS buy_volume, sell_volume::DOUBLE AS sell_volume, buy_count, sell_count, notional::DOUBLE AS notional, notional::DOUBLE / (buy_volume + sell_volume)::DOUBLE AS vwap FROM f")
def a1_flow_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.as_doubles(flow.flow_buckets(src.ticks(spark, sf_dir)))


@query(f"WITH {src.TICKS}, f AS ({_FLOW.format(b=3600000)}) SELECT symbol, bucket, buy_volume::DOUBLE AS buy_volume, sell_volume::DOUBLE AS sell_volume, buy_count, sell_count, notional::DOUBLE / (buy_volume + sell_volume)::DOUBLE AS vwap, (buy_volume - sell_volume)::DOUBLE / (buy_volume + sell_volume)::DOUBLE AS imbalance FROM f")
def a2_flow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = flow.merge_buckets(flow.flow_buckets(src.ticks(spark, sf_dir)), bucket_ms=src.HOUR_MS).withColumn("imbalance", flow.imbalance())
    return flow.as_doubles(hourly.drop("notional"))


@query(f"WITH {src.TICKS}, g AS (SELECT *, lag(id) OVER (PARTITION BY symbol ORDER BY ts, id) AS prev FROM ticks) SELECT symbol, prev + 1 AS expected_from, id AS found, id - prev - 1 AS missing, id - prev - 1 > 50000 AS is_hole FROM g WHERE id - prev > 1")
def w14_id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.id_gaps(src.ticks(spark, sf_dir))


@query(f"WITH {src.TICKS}, g AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id) AS since FROM ticks) SELECT symbol, since, ts AS until, ts - since AS silent_ms FROM g WHERE ts - since > 3600000")
def w15_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.silences(src.ticks(spark, sf_dir), 3_600_000)


@query(f"WITH {src.TICKS}, g AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id) AS since FROM ticks) SELECT symbol, since, ts AS until, ts - since AS silent_ms FROM g WHERE ts - since > 10000")
def w15_liveness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences over the reference's 10 s; w15_silences holds those over an hour."""
    return flow.silences(src.ticks(spark, sf_dir))


@query(f"WITH {src.TICKS}, g AS (SELECT *, max(price) OVER (PARTITION BY symbol ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ticks) SELECT symbol, id, price::DOUBLE AS price FROM g WHERE seen IS NULL OR price > seen")
def w16_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.accepted(src.ticks(spark, sf_dir), "price").select("symbol", "id", F.col("price").cast("double").alias("price"))


@query(f"WITH {src.TICKS} SELECT symbol, ts // 60000 * 60000 AS bucket, min(ts) AS ts, arg_min(id, (ts, id)) AS id FROM ticks GROUP BY 1, 2")
def w22_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.sampled(src.ticks(spark, sf_dir))


@query(f"WITH {src.BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def a3_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars(spark, sf_dir)


@query(f"""WITH {src.BARS}, w AS (SELECT *, count(*) OVER f AS n, avg(close) OVER f AS mid, stddev_pop(close) OVER f AS dev,
    count(*) OVER p AS np, avg(volume) OVER p AS mv, lag(close, 15) OVER o AS base FROM bars
    WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, ts, round(CASE WHEN n >= 20 THEN mid END, 6) AS sma, round(CASE WHEN n >= 20 THEN mid + 2 * dev END, 6) AS bb_upper,
    round(CASE WHEN n >= 20 AND dev > 0 THEN (close - mid + 2 * dev) / (4 * dev) END, 6) AS pct_b, round(CASE WHEN np >= 20 THEN volume / mv END, 6) AS rel_volume,
    round(close / base - 1, 6) AS ret15 FROM w""")
def w1_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = indicators.bollinger()
    out = indicators.plain(indicators.with_halo(src.bars(spark, sf_dir)).withColumns({
        "sma": indicators.sma("close", 20), "bb_upper": b["bb_upper"], "pct_b": b["pct_b"], "rel_volume": indicators.relative_volume(), "ret15": indicators.window_return(),
    })).select("symbol", "ts", "sma", "bb_upper", "pct_b", "rel_volume", "ret15")
    return rounded(out, 6, "sma", "bb_upper", "pct_b", "rel_volume", "ret15")


@query(f"""WITH {src.BARS}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars)
    SELECT symbol, ts, round(CASE WHEN count(r) OVER f >= 20 THEN stddev_pop(r) OVER f END, 6) AS realized_vol FROM r WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)""")
def w4_realized_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.realized_volatility(src.bars(spark, sf_dir)).select("symbol", "ts", "realized_vol"), 6, "realized_vol")


@query(f"""WITH {src.BARS}, t AS (SELECT symbol, ts, 2 * pi() * (hour(make_timestamp(ts * 1000)) + minute(make_timestamp(ts * 1000)) / 60) / 24 AS h,
    2 * pi() * (isodow(make_timestamp(ts * 1000)) - 1) / 7 AS d FROM bars) SELECT symbol, ts, round(sin(h), 6) AS hour_sin, round(cos(h), 6) AS hour_cos, round(sin(d), 6) AS dow_sin, round(cos(d), 6) AS dow_cos FROM t""")
def p9_cyclical_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars(spark, sf_dir).select("symbol", "ts", *[F.round(c, 6).alias(n) for n, c in indicators.cyclical_time().items()])


@query(f"""WITH RECURSIVE {src.BARS}, i AS (SELECT *, row_number() OVER o AS i, lag(close) OVER o AS prev FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
    x AS (SELECT symbol, ts, i, close, CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS g, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS l,
        greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr FROM i),
    s AS (SELECT symbol, ts, i, close, close AS f, close AS w, close AS t, 0::DOUBLE AS sig, g AS ag, l AS al, tr AS a FROM x WHERE i = 1
    UNION ALL SELECT x.symbol, x.ts, x.i, x.close, s.f + 2 / 13 * (x.close - s.f), s.w + 2 / 27 * (x.close - s.w), s.t + 2 / 241 * (x.close - s.t),
        s.sig + 0.2 * (s.f + 2 / 13 * (x.close - s.f) - s.w - 2 / 27 * (x.close - s.w) - s.sig), coalesce(s.ag + (x.g - s.ag) / 14, x.g), coalesce(s.al + (x.l - s.al) / 14, x.l),
        s.a + (x.tr - s.a) / 14 FROM s JOIN x ON x.symbol = s.symbol AND x.i = s.i + 1)
    SELECT symbol, ts, round(f, 6) AS ema_fast, round(CASE WHEN i > 14 THEN CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END, 6) AS rsi,
    round(CASE WHEN i >= 14 THEN a END, 6) AS atr, round(f - w, 6) AS macd, round(sig, 6) AS macd_signal, round((close - t) / close, 6) AS trend_regime_pct FROM s""")
def w6_recurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indicators.with_recurrences(src.bars(spark, sf_dir))
    cols = ["ema_fast", "rsi", "atr", "macd", "macd_signal", "trend_regime_pct"]
    return rounded(out.select("symbol", "ts", *cols), 6, *cols)


@query(f"""WITH {src.BARS}, a AS (SELECT symbol, ts, close, list(struct_pack(h := high, l := low)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS a FROM bars)
    SELECT symbol, ts, coalesce(list_filter(list_transform(a, lambda b: CASE WHEN b.l <= close * 0.95 THEN 0 WHEN b.h >= close * 1.1 THEN 1 ELSE 2 END), lambda x: x < 2)[1], 0) AS label FROM a WHERE len(a) = 12""")
def w19_triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.triple_barrier(src.bars(spark, sf_dir)).select("symbol", "ts", "label")


@query(f"""WITH {src.BARS}, n AS (SELECT symbol, count(*) AS n, floor(count(*) * 0.4)::BIGINT AS lead FROM bars GROUP BY 1), s AS (SELECT *, (n - lead) // 5 AS size, unnest(range(5)) AS fold FROM n)
    SELECT symbol, fold, greatest(0, lead + fold * size - 12) AS train_end, lead + fold * size AS test_start, CASE WHEN fold = 4 THEN n ELSE lead + (fold + 1) * size END AS test_end FROM s WHERE size > 0""")
def w23_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.walk_forward(src.bars(spark, sf_dir))


@query(f"""WITH {src.TRADES}, s AS (SELECT run, count(*) AS n, count(*) FILTER (pnl > 0) AS w, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)::DOUBLE AS gp, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END)::DOUBLE AS gl, sum(pnl) AS p,
    sum(0.001 * (entry_notional + exit_notional)) AS f FROM trades GROUP BY 1)
    SELECT run, n, w / n AS win_rate, gp AS gross_profit, gl AS gross_loss, p::DOUBLE AS total_pnl, f::DOUBLE AS fees, CASE WHEN gl != 0 THEN gp / gl WHEN gp > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor, (p - f)::DOUBLE AS net_pnl FROM s""")
def a8_trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trade_stats(src.trades(spark, sf_dir))


@query(f"""WITH {src.TRADES} SELECT run, hour(make_timestamp(exit_ts * 1000))::INT AS hour, NULL::INT AS weekday, sum(pnl)::DOUBLE AS pnl FROM trades GROUP BY ALL
    UNION ALL SELECT run, NULL, (isodow(make_timestamp(exit_ts * 1000)) - 1)::INT, sum(pnl)::DOUBLE FROM trades GROUP BY ALL""")
def a10_pnl_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_time(src.trades(spark, sf_dir))


@query(f"""WITH {src.TRADES}, e AS (SELECT run, sum(greatest(0, exit_ts - entry_ts)) AS held, max(exit_ts) - min(exit_ts) AS span FROM trades GROUP BY 1)
    SELECT run, round(CASE WHEN span > 0 THEN least(1.0, held / span) ELSE 0 END, 6) AS exposure FROM e""")
def a11_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.exposure(src.trades(spark, sf_dir)), 6, "exposure")


_NET = "pnl - 0.001 * (entry_notional + exit_notional) AS net"


@query(f"""WITH {src.TRADES}, t AS (SELECT make_timestamp(exit_ts * 1000)::DATE AS day, pnl, {_NET} FROM trades)
    SELECT coalesce(day::VARCHAR, 'TOTAL') AS day, count(*) AS n, count(*) FILTER (pnl > 0) / count(*) AS win_rate, sum(pnl)::DOUBLE AS pnl, sum(net)::DOUBLE AS net_pnl, count(*) FILTER (net > 0) / count(*) AS net_win_rate FROM t GROUP BY ROLLUP (day)""")
def a13_daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.daily_table(src.trades(spark, sf_dir))


@query(f"WITH {src.TRADES}, t AS (SELECT exit_reason, pnl, {_NET} FROM trades) SELECT exit_reason, count(*) AS n, sum(pnl)::DOUBLE AS pnl, sum(net)::DOUBLE AS net_pnl FROM t GROUP BY 1")
def a14_by_exit_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_exit_reason(src.trades(spark, sf_dir))


@query(f"""WITH {src.TICKS}, r AS (SELECT symbol, ts // 60000 AS m, count(*) AS n FROM ticks GROUP BY 1, 2) SELECT symbol, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.95), 4) AS p95,
    round(quantile_cont(n, 0.99), 4) AS p99, max(n) AS peak, max(m) - min(m) + 1 AS span, round(1000 / quantile_cont(n, 0.99), 4) AS covered, round(1000 / quantile_cont(n, 0.99) / 0.25, 4) AS headroom FROM r GROUP BY 1""")
def a18_rate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = src.ticks(spark, sf_dir).groupBy("symbol", F.expr("ts div 60000").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(flow.rate_report(rate, "m", "n"), 4, "p50", "p95", "p99", "covered", "headroom")


@query(f"""WITH {src.BARS}, r AS (SELECT symbol, ts, CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY ts) != 0 THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 END AS r FROM bars)
    SELECT a.symbol, round(CASE WHEN count(*) >= 3 THEN corr(a.r, b.r) END, 6) AS correlation FROM r a JOIN r b ON a.ts = b.ts AND b.symbol = 'S0' WHERE a.symbol != 'S0' AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1""")
def a20_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.correlations(src.bars(spark, sf_dir), "S0"), 6, "correlation")


@query(f"""WITH {src.TRADES}, e AS (SELECT *, (1000000 + sum(pnl) OVER o)::DOUBLE AS equity FROM trades WINDOW o AS (PARTITION BY run ORDER BY exit_ts, trade_id, leg ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, max(equity) OVER o AS peak, lag(equity) OVER (PARTITION BY run ORDER BY exit_ts, trade_id, leg) AS prev FROM e WINDOW o AS (PARTITION BY run ORDER BY exit_ts, trade_id, leg ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, max(CASE WHEN equity >= peak THEN exit_ts END) OVER (PARTITION BY run ORDER BY exit_ts, trade_id, leg ROWS UNBOUNDED PRECEDING) AS top_ts FROM p)
    SELECT run, round(max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END), 6) AS max_drawdown, max(exit_ts - top_ts) AS longest_ms,
    round(coalesce(stddev_pop(CASE WHEN prev > 0 THEN equity / prev - 1 END), 0), 6) AS volatility FROM q GROUP BY 1""")
def w17_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.equity_curve(src.trades(spark, sf_dir))
    return rounded(metrics.drawdown(curve).join(metrics.curve_volatility(curve), "run"), 6, "max_drawdown", "volatility")


_QUARTERS, _MONTHS = src.decisions_sql("orders", "o_orderdate", "quarter"), src.decisions_sql("lineitem", "l_shipdate")


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.decisions(src.table(spark, sf_dir, "orders"), "o_orderdate", "quarter")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.decisions(src.table(spark, sf_dir, "lineitem"), "l_shipdate")


@query(f"""WITH {src.FILINGS}, {_QUARTERS} SELECT decision_date, company, period, category, max(version) AS version, arg_max(filing_id, version) AS filing_id, arg_max(received, version) AS received
    FROM filings JOIN decisions ON received <= decision_date GROUP BY ALL""")
def j2_filing_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equities.filing_as_of(src.filings(spark, sf_dir), quarters(spark, sf_dir))


@query(f"""WITH {src.FILINGS}, {_QUARTERS} SELECT decision_date, company, category, max(period) AS period, arg_max(version, (period, version)) AS version, arg_max(filing_id, (period, version)) AS filing_id
    FROM filings JOIN decisions ON received <= decision_date GROUP BY ALL""")
def j3_latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equities.latest_filing_as_of(src.filings(spark, sf_dir), quarters(spark, sf_dir))


_EVENTS = """w0 AS (SELECT *, lag(ex_suffix) OVER o AS prev, lag(close) OVER o AS from_close, lag(trade_date) OVER o AS from_date FROM prices WINDOW o AS (PARTITION BY ticker ORDER BY trade_date)),
    w AS (SELECT *, CASE WHEN from_close > 0 THEN close / from_close - 1 END AS ret FROM w0),
    ev AS (SELECT ticker, trade_date, ex_suffix, CASE WHEN regexp_matches(ex_suffix, '[BG]') THEN true WHEN ex_suffix = 'EX' THEN coalesce(abs(ret) >= 0.33, false) ELSE false END AS is_level_break
    FROM w WHERE ex_suffix IS NOT NULL AND ex_suffix IS DISTINCT FROM prev)"""


@query(f"WITH {src.PRICES}, {_EVENTS} SELECT * FROM ev")
def w12_corporate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equities.corporate_events(src.daily_prices(spark, sf_dir))


@query(f"""WITH {src.PRICES}, {_EVENTS}, b AS (SELECT ticker, trade_date FROM ev WHERE is_level_break), m AS (SELECT * FROM w WHERE abs(ret) > 0.6)
    SELECT m.ticker, from_date, m.trade_date, from_close, close, ret FROM m LEFT JOIN b ON b.ticker = m.ticker AND b.trade_date = m.trade_date WHERE b.ticker IS NULL""")
def w13_implausible_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = src.daily_prices(spark, sf_dir)
    return equities.implausible_moves(prices, equities.corporate_events(prices))


@query(f"""WITH {src.PRICES}, s AS (SELECT ticker, min(trade_date) AS valid_from, max(trade_date) AS last FROM prices GROUP BY 1)
    SELECT ticker, valid_from, CASE WHEN (SELECT max(last) FROM s) - last > 180 THEN last END AS valid_to FROM s""")
def a4_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equities.validity(src.daily_prices(spark, sf_dir))


CANDIDATES = f"""{src.PRICES}, {_MONTHS}, v AS (SELECT *, row_number() OVER o AS history, list_sort(list(volume) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 62 PRECEDING)) AS v FROM prices WINDOW o AS (PARTITION BY ticker ORDER BY trade_date)),
    n AS (SELECT decision_date, ticker, root, arg_max(history, trade_date) AS history, arg_max(v[len(v) // 2 + 1], trade_date) AS median_volume FROM v JOIN decisions ON trade_date <= decision_date AND trade_date > decision_date - 200 GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY decision_date, root, median_volume >= {MIN_VOLUME} ORDER BY median_volume DESC, ticker) AS best FROM n)"""
_UNIVERSE = f"""{CANDIDATES}, universe AS (SELECT decision_date, ticker, median_volume, history,
    CASE WHEN median_volume < {MIN_VOLUME} THEN 'illiquid' WHEN best > 1 THEN 'less_liquid_class' WHEN history < 252 THEN 'short_history' END AS reason FROM b)"""


@query(f"WITH {_UNIVERSE} SELECT * FROM universe")
def c1_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equities.universe(src.daily_prices(spark, sf_dir), months(spark, sf_dir), MIN_VOLUME).drop("root")


@query(f"WITH {_UNIVERSE} SELECT decision_date, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM universe GROUP BY ALL")
def a25_exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c1_universe(spark, sf_dir).groupBy("decision_date", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
