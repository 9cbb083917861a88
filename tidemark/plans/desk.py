"""Queries of the trading desk: orders and events, reports, folds and gates, screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import flow, ingest, metrics, reports, screening, signals
from tidemark.sources import adapters as src
from tidemark.sources import readers

from .catalog import _NET
from .registry import query, rounded

_CURVE = f"""{src.TRADES}, e AS (SELECT *, (1000000 + sum(pnl) OVER o)::DOUBLE AS equity FROM trades WINDOW o AS (PARTITION BY run ORDER BY exit_ts, trade_id, leg ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, max(equity) OVER o AS peak, lag(equity) OVER (PARTITION BY run ORDER BY exit_ts, trade_id, leg) AS prev FROM e WINDOW o AS (PARTITION BY run ORDER BY exit_ts, trade_id, leg ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT run, arg_max(equity, (exit_ts, trade_id, leg)) / 1000000 - 1 AS total_return, max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END) AS dd,
        coalesce(stddev_pop(CASE WHEN prev > 0 THEN equity / prev - 1 END), 0) AS vol FROM p GROUP BY 1)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} != 0 THEN {a} / {b} WHEN {a} > 0 THEN 'inf'::DOUBLE ELSE 0 END"


@query(f"WITH {_CURVE} SELECT run, total_return, round({_ratio('total_return', 'dd')}, 6) AS return_over_drawdown, round({_ratio('total_return', 'vol')}, 4) AS return_over_volatility FROM r")
def a9_return_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 and A12."""
    out = metrics.return_ratios(metrics.equity_curve(src.trades(spark, sf_dir)))
    return rounded(rounded(out, 6, "return_over_drawdown"), 4, "return_over_volatility")


@query(f"WITH {_CURVE} SELECT run, total_return FROM r")
def a12_total_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_return(metrics.equity_curve(src.trades(spark, sf_dir)))


@query(f"""WITH {_CURVE}, w AS (SELECT run, exit_ts, equity, peak, max(equity) OVER (PARTITION BY run ORDER BY exit_ts RANGE 3600000 PRECEDING) AS recent FROM p)
    SELECT run, min(exit_ts) FILTER ((recent > 0 AND (recent - equity) / recent >= 0.02) OR (peak > 0 AND (peak - equity) / peak >= 0.02)) AS triggered_at FROM w GROUP BY 1""")
def w21_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a loss of 2 %, so that some runs trip and others don't."""
    return metrics.breaker(metrics.equity_curve(src.trades(spark, sf_dir)), loss=0.02)


@query(f"WITH {src.TRADES} SELECT run, trade_id, leg, (pnl - 0.001 * (entry_notional + exit_notional))::DOUBLE AS net_pnl FROM trades")
def p13_net_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.trades(spark, sf_dir).select("run", "trade_id", "leg", metrics.net_pnl().cast("double").alias("net_pnl"))


@query(f"WITH {src.TICKS} SELECT symbol, id, price::DOUBLE * CASE WHEN is_buyer_maker THEN 0.9995 ELSE 1.0005 END AS filled, (price * quantity * 0.001)::DOUBLE AS fee FROM ticks")
def p12_fill_and_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = signals.Costs()
    side = F.when(F.col("is_buyer_maker"), "sell").otherwise("buy")
    return src.ticks(spark, sf_dir).select("symbol", "id", costs.filled(F.col("price").cast("double"), side).alias("filled"), costs.of(F.col("price") * F.col("quantity")).cast("double").alias("fee"))


_STOP = "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 1000 END"


@query(f"""SELECT p_partkey, least(100000 * 0.01 / nullif(p_retailprice * {_STOP}, 0), 100000 * 0.2 / p_retailprice) AS size, CASE WHEN coalesce({_STOP}, 0) <= 0 THEN 'missing_stop' END AS rejection FROM part WHERE coalesce({_STOP}, 0) > 0
    UNION ALL SELECT p_partkey, NULL, 'missing_stop' FROM part WHERE coalesce({_STOP}, 0) <= 0""")
def p14_position_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk, equity, price, stop = signals.Risk(), F.lit(100_000.0), F.col("p_retailprice"), F.expr(_STOP)
    return src.table(spark, sf_dir, "part").select("p_partkey", risk.size(equity, price, stop).alias("size"), risk.rejection(equity, price, stop).alias("rejection"))


@query(f"""WITH {src.TRADES}, t AS (SELECT run, exit_reason, hour(make_timestamp(exit_ts * 1000))::INT AS hour, {_NET} FROM trades),
    h AS (SELECT run, exit_reason, hour, count(*) AS n, count(*) FILTER (net > 0) / count(*) AS net_win_rate, sum(net)::DOUBLE AS net_pnl FROM t GROUP BY ALL) SELECT *, n < 10 AS preliminary FROM h WHERE net_win_rate < 0.35""")
def a15_weak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.weak_hours(src.trades(spark, sf_dir), ("run", "exit_reason"))


_STATES = "ev AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'PARADO_CIRCUIT_BREAKER' ELSE 'OPERANDO' END AS to_state FROM orders)"


def engine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), src.millis("o_orderdate").alias("ts"), F.when(F.col("o_orderpriority") == "1-URGENT", "PARADO_CIRCUIT_BREAKER").otherwise("OPERANDO").alias("to_state"))


_DAILY = f"""{src.TRADES}, {_STATES}, t AS (SELECT make_timestamp(exit_ts * 1000)::DATE AS day, pnl, {_NET} FROM trades),
    td AS (SELECT day, count(*) AS trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, sum(pnl)::DOUBLE AS pnl, count(*) FILTER (net > 0) / count(*) AS net_win_rate, sum(net)::DOUBLE AS net_pnl FROM t GROUP BY 1),
    ed AS (SELECT make_timestamp(ts * 1000)::DATE AS day, bool_or(to_state = 'PARADO_CIRCUIT_BREAKER') AS breaker FROM ev GROUP BY 1),
    daily AS (SELECT coalesce(td.day, ed.day) AS day, coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate, coalesce(pnl, 0) AS pnl, coalesce(net_win_rate, 0) AS net_win_rate, coalesce(net_pnl, 0) AS net_pnl, coalesce(breaker, false) AS breaker FROM td FULL JOIN ed ON td.day = ed.day)"""


@query(f"WITH {_DAILY} SELECT * FROM daily")
def a16_daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_rows(src.trades(spark, sf_dir), engine_events(spark, sf_dir))


_FRESH = """counts AS (SELECT event_type AS "table", CASE WHEN user_id % 2 = 0 THEN 'mainnet' ELSE 'testnet' END AS environment, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
    floors AS (SELECT * FROM (VALUES ('view', 'mainnet', 30), ('error', 'testnet', 40), ('signup', 'mainnet', 1), ('missing', 'mainnet', 5)) AS f("table", environment, floor)),
    fresh AS (SELECT f."table", f.environment, d.day, coalesce(n, 0) AS n, floor, coalesce(n, 0) >= floor AS ok FROM floors f CROSS JOIN (SELECT DISTINCT day FROM counts) d LEFT JOIN counts c ON c."table" = f."table" AND c.environment = f.environment AND c.day = d.day)"""


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = src.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("table"), F.when(F.col("user_id") % 2 == 0, "mainnet").otherwise("testnet").alias("environment"), F.to_date("ts").alias("day"))
    floors = spark.createDataFrame([("view", "mainnet", 30), ("error", "testnet", 40), ("signup", "mainnet", 1), ("missing", "mainnet", 5)], "table string, environment string, floor int")
    return flow.capture_freshness(counts.agg(F.count(F.lit(1)).alias("n")), floors)


@query(f"WITH {_FRESH} SELECT * FROM fresh")
def a17_capture_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness(spark, sf_dir)


@query(f"""WITH {_DAILY}, {_FRESH}, wh AS (SELECT day, count(*) AS n_weak FROM (SELECT day, 0 AS hour FROM t GROUP BY day HAVING count(*) FILTER (net > 0) / count(*) < 0.35) GROUP BY 1),
    st AS (SELECT day, count(*) AS n_stale FROM fresh WHERE NOT ok GROUP BY 1)
    SELECT daily.day, trades, net_pnl, breaker, coalesce(n_weak, 0)::INT AS n_weak, coalesce(n_stale, 0)::INT AS n_stale FROM daily LEFT JOIN wh USING (day) LEFT JOIN st USING (day)""")
def c4_learning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.learning_report(src.trades(spark, sf_dir), engine_events(spark, sf_dir), freshness(spark, sf_dir))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return out.select("day", "trades", "net_pnl", "breaker", size("weak_hours").alias("n_weak"), size("stale").alias("n_stale"))


@query(f"""WITH {src.TICKS}, s AS (SELECT symbol, ts, id, lag(ts, 999) OVER (PARTITION BY symbol ORDER BY ts, id) AS first FROM ticks),
    x AS (SELECT symbol, ts // 30000 * 30000 AS bucket, max(ts) AS ts, arg_max(struct_pack(f := first), (ts, id)).f AS first FROM s GROUP BY 1, 2)
    SELECT symbol, bucket, ts - first AS span_ms, 1000 * 1000 / (ts - first) AS per_second FROM x WHERE ts - first > 0""")
def a19_arrival_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last 1000 messages, every 30 s in which there is one."""
    return flow.arrival_rates(src.ticks(spark, sf_dir))


@query(f"WITH {src.TRADES} SELECT run, sum(pnl)::DOUBLE AS realized_pnl FROM trades GROUP BY 1")
def a24_realized_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.realized(src.trades(spark, sf_dir))


@query(f"WITH {src.TRADES} SELECT run, trade_id, leg, exit_ts FROM trades WHERE exit_ts BETWEEN epoch_ms(TIMESTAMP '1997-03-01') AND epoch_ms(TIMESTAMP '1997-04-01') - 1")
def p21_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.in_days(src.trades(spark, sf_dir), "exit_ts", "1997-03-01", "1997-03-31").select("run", "trade_id", "leg", "exit_ts")


_FOLDS = f"""{src.TRADES}, t AS (SELECT run AS config, year(make_timestamp(exit_ts * 1000)) AS fold, trade_id, leg, pnl FROM trades),
    f AS (SELECT config, fold, count(*) AS n, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)::DOUBLE AS gross_profit, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END)::DOUBLE AS gross_loss, sum(pnl)::DOUBLE AS total_pnl, max(abs(pnl))::DOUBLE AS max_drawdown FROM t GROUP BY 1, 2),
    g AS (SELECT *, {_ratio('gross_profit', 'gross_loss')} AS profit_factor FROM f),
    j AS (SELECT g.*, CASE WHEN g.n < 100 THEN 'too_few_trades' WHEN g.gross_loss = 0 THEN 'no_loss' WHEN g.profit_factor < 0.75 THEN 'not_profitable' WHEN g.profit_factor <= b.profit_factor THEN 'not_over_baseline'
        WHEN g.max_drawdown > b.max_drawdown + 100 THEN 'deeper_drawdown' END AS reason FROM g JOIN g b ON b.config = 'R0' AND b.fold = g.fold WHERE g.config != 'R0')"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as configurations and years as folds, against run R0."""
    t = src.trades(spark, sf_dir).select(F.col("run").alias("config"), F.year(F.timestamp_millis("exit_ts")).alias("fold"), "entry_notional", "exit_notional", "pnl")
    f = metrics.trade_stats(t, ("config", "fold")).join(t.groupBy("config", "fold").agg(F.max(F.abs("pnl")).cast("double").alias("max_drawdown")), ["config", "fold"])
    return screening.judged(f.filter("config != 'R0'"), f.filter("config = 'R0'").drop("config"), ["fold"], 100, 0.75, 0.0, 100.0)


@query(f"WITH {_FOLDS} SELECT config, fold, profit_factor, reason, reason IS NULL AS wins FROM j")
def m9_fold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 and M9."""
    return _judged(spark, sf_dir).select("config", "fold", "profit_factor", "reason", "wins")


@query(f"WITH {_FOLDS} SELECT config, bool_and(reason IS NULL) AS promoted FROM j GROUP BY 1")
def m10_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.promoted(_judged(spark, sf_dir))


_ROLLUP = f"""{_FOLDS}, c AS (SELECT config, count(*) FILTER (reason IS NULL) AS folds_won, count(*) AS folds, round(avg(profit_factor), 6) AS mean_pf, min(profit_factor) AS min_pf, round(sum(total_pnl), 2) AS total_pnl,
    round(sum(gross_profit) / sum(gross_loss), 6) AS pooled_pf FROM j GROUP BY 1)"""


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(screening.config_rollup(_judged(spark, sf_dir)), 6, "mean_pf", "pooled_pf"), 2, "total_pnl")


@query(f"WITH {_ROLLUP} SELECT * FROM c")
def a22_config_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir)


@query(f"WITH {_ROLLUP} SELECT config, folds_won, mean_pf, row_number() OVER (ORDER BY folds_won DESC, mean_pf DESC, config) AS place FROM c")
def k2_ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place per configuration, of which there are few."""
    place = F.row_number().over(Window.orderBy(F.desc("folds_won"), F.desc("mean_pf"), "config")).cast("long")
    return screening.ranked(_rollup(spark, sf_dir)).select("config", "folds_won", "mean_pf", place.alias("place"))


@query(f"WITH {_ROLLUP} SELECT config, min_pf, mean_pf FROM c ORDER BY min_pf DESC, mean_pf DESC, config LIMIT 5")
def k3_best_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.ranked(_rollup(spark, sf_dir), ("min_pf", "mean_pf")).limit(5).select("config", "min_pf", "mean_pf")


@query("""WITH s AS (SELECT s_suppkey // 20 AS config, s_suppkey % 20 = 0 AS is_real, s_acctbal AS score FROM supplier), r AS (SELECT config, max(score) AS real FROM s WHERE is_real GROUP BY 1)
    SELECT config, real, (count(*) FILTER (score >= real) + 1) / (count(*) + 1) AS p_value, min(score) AS null_min, max(score) AS null_max, list_sort(list(score))[len(list(score)) // 2 + 1] AS null_median FROM s JOIN r USING (config) WHERE NOT is_real GROUP BY 1, 2""")
def a23_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 20").alias("config"), (F.col("s_suppkey") % 20 == 0).alias("is_real"), F.col("s_acctbal").alias("score"))
    return screening.permutation_test(s)


_LATEST = f"""{src.ORDERS}, latest AS (SELECT client_order_id, arg_min(symbol, (updated_at, seq)) AS symbol, arg_min(purpose, (updated_at, seq)) AS purpose, arg_max(status, (updated_at, seq)) AS status, arg_max(filled_qty, (updated_at, seq)) AS filled_qty,
    arg_max(avg_fill_price, (updated_at, seq)) AS avg_fill_price, max(updated_at) AS updated_at, arg_max(seq, (updated_at, seq)) AS seq, min(updated_at) AS created_at FROM states GROUP BY 1)"""


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_state(src.closed_orders(spark, sf_dir), "client_order_id", ["updated_at", "seq"], ["status", "filled_qty", "avg_fill_price"])


@query(f"WITH {_LATEST} SELECT * FROM latest")
def s11_latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_orders(spark, sf_dir)


_OPEN = f"""{_LATEST}, closed AS (SELECT client_order_id AS entry_order_id FROM latest WHERE seq % 2 = 0),
    open_e AS (SELECT symbol, arg_max(client_order_id, (created_at, client_order_id)) AS client_order_id, max(created_at) AS created_at FROM latest
    WHERE purpose = 'entry' AND status IN ('FILLED', 'PARTIALLY_FILLED') AND filled_qty > 0 AND avg_fill_price IS NOT NULL AND client_order_id NOT IN (SELECT entry_order_id FROM closed) GROUP BY 1)"""


def _open(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = latest_orders(spark, sf_dir)
    return orders, screening.open_entries(orders, orders.filter("seq % 2 = 0").select(F.col("client_order_id").alias("entry_order_id")))


@query(f"WITH {_OPEN} SELECT * FROM open_e")
def j10_open_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, sf_dir)[1]


@query(f"""WITH {_OPEN} SELECT l.symbol, arg_max(l.client_order_id, (l.created_at, l.client_order_id)) AS client_order_id, max(l.created_at) AS created_at FROM latest l JOIN (SELECT symbol, created_at - 86400000 AS since FROM open_e) o USING (symbol)
    WHERE purpose = 'stop_loss' AND l.created_at >= since GROUP BY 1""")
def k5_latest_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops from a day before the open entry on."""
    orders, entries = _open(spark, sf_dir)
    return screening.latest_stop_after(orders, entries.withColumn("created_at", F.col("created_at") - 86_400_000))


@query(f"WITH {_STATES} SELECT id, ts AS triggered_at FROM ev WHERE to_state = 'PARADO_CIRCUIT_BREAKER' AND id % 7 = 0 ORDER BY ts DESC, id DESC LIMIT 1")
def k5_unacknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = engine_events(spark, sf_dir).filter("to_state = 'PARADO_CIRCUIT_BREAKER'")
    ev = ev.select("id", F.col("ts").alias("triggered_at"), F.when(F.col("id") % 7 != 0, F.col("ts")).alias("acknowledged_at"))
    return screening.latest_unacknowledged(ev).select("id", "triggered_at")


@query(f"WITH {_STATES} SELECT id, ts, to_state FROM ev ORDER BY ts DESC, id DESC LIMIT 50")
def k4_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.recent(engine_events(spark, sf_dir), 50)


_LOG = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'sweep' WHEN 1 THEN 'permute' ELSE 'screen' END AS tool, (o_custkey % 40)::VARCHAR AS h, o_orderstatus AS s FROM orders"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "sweep").when(F.col("o_orderkey") % 3 == 1, "permute").otherwise("screen").alias("tool"), (F.col("o_custkey") % 40).cast("string").alias("h"), F.col("o_orderstatus").alias("s"))


@query(f"WITH l AS ({_LOG}) SELECT id, EXISTS (SELECT 1 FROM l o WHERE o.id % 10 = 0 AND o.tool = l.tool AND o.h = l.h AND o.s = l.s) AS tried FROM l WHERE id % 10 > 0")
def s15_already_tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders as the log; parameters come in another order there."""
    rows = log_rows(spark, sf_dir)
    log = rows.filter("id % 10 = 0").withColumn("params", F.expr("map('s', s, 'h', h)"))
    return ingest.already_tried(rows.filter("id % 10 > 0").withColumn("params", F.expr("map('h', h, 's', s)")), log).select("id", "tried")


_CATALOG = """sym AS (SELECT 'B' || c_custkey::VARCHAR || CASE WHEN c_custkey % 9 = 0 THEN 'UP' ELSE '' END AS base_asset, CASE WHEN c_nationkey % 6 = 0 THEN 'EUR' ELSE 'USDT' END AS quote_asset,
    CASE WHEN c_custkey % 5 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status, c_custkey % 7 != 0 AS is_spot_trading_allowed, c_acctbal AS vol, c_custkey % 100 / 10 AS price, c_custkey AS k FROM customer),
    cand AS (SELECT base_asset || quote_asset AS symbol, base_asset, vol AS quote_volume, price AS last_price FROM sym WHERE k % 4 > 0 AND status = 'TRADING' AND is_spot_trading_allowed AND quote_asset = 'USDT'
        AND NOT regexp_matches(base_asset, '(UP|DOWN|BULL|BEAR)$') AND vol >= 1000 AND price >= 1)"""


def _symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and 24-hour tickers of customers, written as the exchange's JSON and decoded again."""
    k = F.col("c_custkey")
    base = F.concat(F.lit("B"), k.cast("string"), F.when(k % 9 == 0, "UP").otherwise(""))
    rows = src.table(spark, sf_dir, "customer").select(
        base.alias("baseAsset"), F.when(F.col("c_nationkey") % 6 == 0, "EUR").otherwise("USDT").alias("quoteAsset"), F.when(k % 5 == 0, "BREAK").otherwise("TRADING").alias("status"),
        (k % 7 != 0).alias("isSpotTradingAllowed"), F.col("c_acctbal").cast("string").alias("quoteVolume"), (k % 100 / 10).cast("string").alias("lastPrice"), k.alias("k"),
    ).withColumn("symbol", F.concat("baseAsset", "quoteAsset"))
    info = rows.select(F.to_json(F.struct(F.array(F.struct("symbol", "baseAsset", "quoteAsset", "status", "isSpotTradingAllowed")).alias("symbols"))).alias("value"))
    tickers = rows.filter("k % 4 > 0").select(F.to_json(F.array(F.struct("symbol", "quoteVolume", "lastPrice"))).alias("value"))
    return readers.decode_catalog(info), readers.decode_tickers(tickers)


@query(f"WITH {_CATALOG} SELECT * FROM cand")
def j1_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, P18 and J1."""
    return screening.candidates(*_symbols(spark, sf_dir), 1000.0, 1.0)


@query(f"WITH {_CATALOG} SELECT symbol, quote_volume FROM cand WHERE symbol != 'B1USDT' ORDER BY quote_volume DESC, symbol LIMIT 20")
def k1_top_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.top_by_volume(screening.candidates(*_symbols(spark, sf_dir), 1000.0, 1.0), 20, "B1USDT").select("symbol", "quote_volume")
