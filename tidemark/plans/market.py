"""Queries over market data: decoding, depth, features, labels, folds, scores and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, flow, indicators, models, screening, signals
from tidemark.sources import adapters as src
from tidemark.sources import readers, scratch
from tidemark.streaming import flow as live

from .registry import query, rounded

HOURS = 4
_COARSE_MS = HOURS * src.HOUR_MS


def _recursion(bars: str, name: str) -> str:
    """All recurrences over bars in DuckDB: f, w, t (averages), sig, ag, al, a of every bar i."""
    return f"""i_{name} AS (SELECT *, row_number() OVER o AS i, lag(close) OVER o AS prev FROM {bars} WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
    x_{name} AS (SELECT symbol, ts, i, close, high, low, volume, CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS g, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS l,
        greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr FROM i_{name}),
    {name} AS (SELECT symbol, ts, i, close, close AS f, close AS w, close AS t, 0::DOUBLE AS sig, g AS ag, l AS al, tr AS a FROM x_{name} WHERE i = 1
    UNION ALL SELECT x.symbol, x.ts, x.i, x.close, s.f + 2 / 13 * (x.close - s.f), s.w + 2 / 27 * (x.close - s.w), s.t + 2 / 241 * (x.close - s.t),
        s.sig + 0.2 * (s.f + 2 / 13 * (x.close - s.f) - s.w - 2 / 27 * (x.close - s.w) - s.sig), coalesce(s.ag + (x.g - s.ag) / 14, x.g), coalesce(s.al + (x.l - s.al) / 14, x.l),
        s.a + (x.tr - s.a) / 14 FROM {name} s JOIN x_{name} x ON x.symbol = s.symbol AND x.i = s.i + 1)"""


_RSI = "CASE WHEN {0}.i > 14 THEN CASE WHEN {0}.al = 0 THEN 100 ELSE 100 - 100 / (1 + {0}.ag / {0}.al) END END"
_PCT_B = """SELECT symbol, ts, CASE WHEN count(*) OVER f >= 20 AND stddev_pop(close) OVER f > 0 THEN (close - avg(close) OVER f + 2 * stddev_pop(close) OVER f) / (4 * stddev_pop(close) OVER f) END AS pct_b,
    CASE WHEN count(*) OVER f >= 20 THEN avg(close) OVER f END AS mid, CASE WHEN count(*) OVER f >= 20 THEN stddev_pop(close) OVER f END AS dev FROM {0} WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars(spark, sf_dir)


@query(f"WITH {src.BARS} SELECT symbol, ts AS open_time, ts + {src.HOUR_MS - 1} AS close_time, '1h' AS interval, open, high, low, close, volume, true AS is_closed FROM bars WHERE ts // {src.HOUR_MS} % 5 > 0")
def s6_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as stream messages, in an envelope or bare, and as array rows, decoded again; P19 drops those still open."""
    b = bars(spark, sf_dir).withColumn("n", F.expr(f"ts div {src.HOUR_MS}"))
    text = lambda c: F.col(c).cast("string")
    k = F.struct(F.col("symbol").alias("s"), F.lit("1h").alias("i"), *[text(c).alias(a) for a, c in zip("ohlcv", ("open", "high", "low", "close", "volume"))], (F.col("n") % 5 > 0).alias("x"))
    times = F.concat(F.lit('{"t":'), text("ts"), F.lit(',"T":'), (F.col("ts") + (src.HOUR_MS - 1)).cast("string"), F.lit(","))
    body = F.concat(F.lit('{"e":"kline","k":'), times, F.to_json(k).substr(F.lit(2), F.length(F.to_json(k))), F.lit("}"))
    stream = b.filter("n % 2 = 0").select(F.when(F.col("n") % 4 == 0, body).otherwise(F.concat(F.lit('{"stream":"x@kline_1h","data":'), body, F.lit("}"))).alias("value"))
    rows = b.filter("n % 2 = 1 AND n % 5 > 0").select("symbol", F.to_json(F.array(text("ts"), *[text(c) for c in ("open", "high", "low", "close", "volume")], (F.col("ts") + (src.HOUR_MS - 1)).cast("string"))).alias("value"))
    return features.closed_candles(readers.decode_klines(stream).unionByName(readers.decode_kline_rows(rows, "1h")))


@query(f"WITH {src.TICKS} SELECT symbol, id AS agg_trade_id, price::DOUBLE AS price, quantity::DOUBLE AS quantity, id AS first_trade_id, id + 1 AS last_trade_id, ts AS trade_time, is_buyer_maker FROM ticks WHERE id % 11 > 0")
def s7_trade_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as stream messages, some without a field, decoded again."""
    t = src.ticks(spark, sf_dir)
    data = F.struct(F.col("id").alias("a"), F.when(F.col("id") % 11 > 0, F.col("price").cast("string")).alias("p"), F.col("quantity").cast("string").alias("q"), F.col("id").alias("f"), (F.col("id") + 1).alias("l"), F.col("ts").alias("T"), F.col("is_buyer_maker").alias("m"))
    return readers.decode_trades(t.select(F.to_json(F.struct(F.concat(F.lower("symbol"), F.lit("@aggTrade")).alias("stream"), data.alias("data"))).alias("value")))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order books of two levels around every trade, as messages, decoded; every 13th has no asks."""
    level = lambda p, q: F.array((F.col("price") + p).cast("string"), q.cast("string"))
    q = F.col("quantity")
    asks = F.when(F.col("id") % 13 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(level(0.5, q), level(1, q * 3)))
    data = F.struct(F.col("id").alias("lastUpdateId"), F.array(level(0, q * 2), level(-0.01, q)).alias("bids"), asks.alias("asks"))
    rows = src.ticks(spark, sf_dir).withColumns({"price": F.col("price").cast("double"), "quantity": F.col("quantity").cast("double")})
    return readers.decode_depth(rows.select("id", "ts", F.to_json(F.struct(F.concat(F.lower("symbol"), F.lit("@depth20@1000ms")).alias("stream"), data.alias("data"))).alias("value")))


@query(f"""WITH {src.TICKS}, d AS (SELECT symbol, id, price::DOUBLE AS bid, CASE WHEN id % 13 > 0 THEN price::DOUBLE + 0.5 END AS ask, quantity::DOUBLE * 2 + quantity::DOUBLE AS b, CASE WHEN id % 13 > 0 THEN quantity::DOUBLE + quantity::DOUBLE * 3 ELSE 0 END AS a FROM ticks)
    SELECT symbol, id, bid AS best_bid, ask AS best_ask, (ask - bid) / bid AS spread_pct, round(b, 6) AS bid_depth, round(a, 6) AS ask_depth, round((b - a) / (b + a), 6) AS imbalance FROM d""")
def p11_depth_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 and P11."""
    out = depth(spark, sf_dir).select("symbol", "id", *[c.alias(n) for n, c in signals.depth_fields(F.col("bids"), F.col("asks")).items()])
    return rounded(out, 6, "bid_depth", "ask_depth", "imbalance")


@query(f"""WITH RECURSIVE {src.BARS}, {_recursion('bars', 's')} SELECT symbol, ts, round((close - f) / close, 6) AS ema_fast_dist_pct, round((close - w) / close, 6) AS ema_slow_dist_pct, round((f - w) / close, 6) AS ema_cross_pct,
    round((f - w) / close, 6) AS macd_pct, round(sig / close, 6) AS macd_signal_pct, round((f - w - sig) / close, 6) AS macd_hist_pct, round(CASE WHEN i >= 14 THEN a END / close, 6) AS atr_pct FROM s""")
def p10_price_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["ema_fast_dist_pct", "ema_slow_dist_pct", "ema_cross_pct", "macd_pct", "macd_signal_pct", "macd_hist_pct", "atr_pct"]
    return rounded(features.price_relative(indicators.with_recurrences(bars(spark, sf_dir))).select("symbol", "ts", *cols), 6, *cols)


@query(f"WITH {src.BARS}, b AS ({_PCT_B.format('bars')}) SELECT symbol, ts, round(mid, 6) AS bb_mid, round(mid + 2 * dev, 6) AS bb_upper, round(mid - 2 * dev, 6) AS bb_lower FROM b")
def w2_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["bb_mid", "bb_upper", "bb_lower"]
    held = indicators.with_halo(bars(spark, sf_dir)).withColumns({c: indicators.bollinger()[c] for c in cols})
    return rounded(indicators.plain(held).select("symbol", "ts", *cols), 6, *cols)


_COARSE = f"coarse AS (SELECT symbol, ts // {_COARSE_MS} * {_COARSE_MS} AS ts, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"


@query(f"""WITH {src.BARS}, {_COARSE}, p AS (SELECT symbol, ts, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM coarse)
    SELECT bars.symbol, bars.ts, before AS coarse_close FROM bars LEFT JOIN p ON p.symbol = bars.symbol AND p.ts = bars.ts // {_COARSE_MS} * {_COARSE_MS}""")
def j12_finished_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return features.on_finished_buckets(b, features.coarse(b, _COARSE_MS), _COARSE_MS, {"close": "coarse_close"}).select("symbol", "ts", "coarse_close")


@query(f"""WITH RECURSIVE {src.BARS}, {_COARSE}, {_recursion('coarse', 's')}, b AS ({_PCT_B.format('coarse')}),
    p AS (SELECT s.symbol, s.ts, lag({_RSI.format('s')}) OVER o AS rsi, lag(pct_b) OVER o AS pct_b FROM s JOIN b ON b.symbol = s.symbol AND b.ts = s.ts WINDOW o AS (PARTITION BY s.symbol ORDER BY s.ts))
    SELECT bars.symbol, bars.ts, round(rsi, 6) AS rsi_4h, round(pct_b, 6) AS pct_b_4h FROM bars LEFT JOIN p ON p.symbol = bars.symbol AND p.ts = bars.ts // {_COARSE_MS} * {_COARSE_MS}""")
def w10_multi_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.multi_timeframe(bars(spark, sf_dir), {f"{HOURS}h": _COARSE_MS}).select("symbol", "ts", "rsi_4h", "pct_b_4h")
    return rounded(out, 6, "rsi_4h", "pct_b_4h")


@query(f"""WITH {src.BARS}, r AS (SELECT symbol, ts, CASE WHEN lag(close, 15) OVER o != 0 THEN close / lag(close, 15) OVER o - 1 END AS r FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
    ref AS (SELECT ts, r FROM r WHERE symbol = 'S0') SELECT m.symbol, m.ts, round(m.r - ref.r, 6) AS relative_strength FROM (SELECT * FROM r WHERE symbol != 'S0') m ASOF LEFT JOIN ref ON m.ts >= ref.ts""")
def j11_relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.relative_strength(bars(spark, sf_dir), "S0").select("symbol", "ts", F.round("relative_strength", 6).alias("relative_strength"))


@query(f"WITH {src.BARS} SELECT symbol, ts, row_number() OVER (ORDER BY ts, CASE symbol WHEN 'S0' THEN 0 ELSE 1 END) AS place FROM bars WHERE symbol IN ('S0', 'S1')")
def u1_merged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return features.merged_streams(b.filter("symbol = 'S0'"), b.filter("symbol = 'S1'")).select("symbol", "ts", "place")


@query(f"""WITH RECURSIVE {src.BARS}, {_recursion('bars', 's')}, b AS ({_PCT_B.format('bars')}), f AS (SELECT s.symbol, s.ts, {_RSI.format('s')} AS rsi, pct_b, (s.close - t) / s.close AS trend FROM s JOIN b ON b.symbol = s.symbol AND b.ts = s.ts)
    SELECT symbol, ts, coalesce(round(rsi, 6) < 40 AND round(pct_b, 6) <= 0.2 AND round(trend, 6) >= -0.5, false) AS enter, coalesce(round(rsi, 6) >= 50, false) AS exit FROM f""")
def p15_gated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule strategy under a regime gate."""
    rows = indicators.plain(indicators.with_halo(indicators.with_recurrences(bars(spark, sf_dir))).withColumn("pct_b", indicators.bollinger()["pct_b"]))
    rows = rounded(rows, 6, "rsi", "pct_b", "trend_regime_pct")
    s = signals.Strategy((F.col("rsi") < 40) & (F.col("pct_b") <= 0.2), F.col("rsi") >= 50, F.lit(0.02)).gated(signals.regime_gate(-0.5))
    return s.signals(rows).select("symbol", "ts", "enter", "exit")


_SCORED = f"b AS ({_PCT_B.format('bars')}), z AS (SELECT symbol, ts, round(pct_b, 6) AS score, CASE WHEN ts // {src.HOUR_MS} % 17 = 0 THEN 1 ELSE 0 END AS label FROM b)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place between the bands as a score, and every 17th hour as a label."""
    label = F.when(F.expr(f"ts div {src.HOUR_MS} % 17 = 0"), 1).otherwise(0)
    rows = indicators.plain(indicators.with_halo(bars(spark, sf_dir)).withColumn("score", F.round(indicators.bollinger()["pct_b"], 6)))
    return rows.select("symbol", "ts", "score", label.alias("label"))


@query(f"WITH {src.BARS}, {_SCORED} SELECT symbol, ts, coalesce(score >= 0.9, false) AS enter, coalesce(score < 0.1, false) AS exit FROM z")
def p17_model_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.model_strategy(["score"], 0.9, 0.1).signals(scored(spark, sf_dir)).select("symbol", "ts", "enter", "exit")


@query(f"WITH {src.BARS}, {_SCORED} SELECT symbol, count(*) AS n, round(avg(label), 6) AS label_rate, round(avg((score - label) ** 2), 6) AS brier FROM z WHERE score IS NOT NULL GROUP BY 1")
def a21_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20 (rows without a score are warming up) and A21."""
    rows = features.warm(scored(spark, sf_dir), ("score",))
    return rounded(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), models.label_rate().alias("label_rate"), models.brier_score("score").alias("brier")), 6, "label_rate", "brier")


@query(f"WITH {src.BARS}, {_SCORED}, d AS (SELECT symbol, score - lag(score) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM z WHERE score IS NOT NULL) SELECT symbol, round(CASE WHEN count(d) > 1 THEN stddev_pop(d) ELSE 0 END, 6) AS noise FROM d GROUP BY 1")
def w25_score_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.score_noise(scored(spark, sf_dir).dropna(), ["symbol"]), 6, "noise")


@query(f"""WITH {src.BARS}, {_SCORED}, d AS (SELECT *, score - lag(score) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM z WHERE score IS NOT NULL),
    n AS (SELECT symbol, count(*) AS n, avg(label) AS label_rate, list_sort(list(score)) AS s, coalesce(stddev_pop(d), 0) AS noise FROM d GROUP BY 1), p AS (SELECT *, greatest(80, least(99.9, 100 - 300 * label_rate)) AS percentile FROM n),
    k AS (SELECT *, (n - 1) * percentile / 100 AS k FROM p), e AS (SELECT *, s[floor(k)::INT + 1] + (s[ceil(k)::INT + 1] - s[floor(k)::INT + 1]) * (k - floor(k)) AS entry FROM k)
    SELECT symbol, n, round(percentile, 6) AS percentile, round(entry, 6) AS entry, round(greatest(0, entry - 3 * noise), 6) AS exit FROM e""")
def m4_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.thresholds(scored(spark, sf_dir).dropna(), ["symbol"]).select("symbol", "n", "percentile", "entry", "exit")
    return rounded(out, 6, "percentile", "entry", "exit")


def _round(x: str, y: str, k: int) -> str:
    return f"(({x} + ('0x' || substr(md5(({y})::VARCHAR || ':' || seed || ':{k}'), 1, 8))::BIGINT) % base)"


def _step(x: str) -> str:
    """One step of the bijection in DuckDB."""
    high, low = f"({x} // base)", f"({x} % base)"
    high = _round(high, low, 0)
    low = _round(low, high, 1)
    high = _round(high, low, 2)
    return f"({high} * base + {_round(low, high, 3)})"


@query(f"""WITH {src.BARS}, {_SCORED}, i AS (SELECT symbol, ts, label, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM z),
    q AS (SELECT *, floor(sqrt(n))::BIGINT + 1 AS base, unnest([3, 4, 5]) AS seed FROM i), f AS (SELECT *, {_step('i')} AS x FROM q),
    w AS (SELECT *, CASE WHEN n <= 1 THEN 0 WHEN x < n THEN x ELSE list_reduce(list_prepend(x, range(64)), lambda acc, k: CASE WHEN acc < n THEN acc ELSE {_step('acc')} END) END AS at FROM f)
    SELECT w.symbol, w.ts, seed::BIGINT AS seed, i.label FROM w JOIN i ON i.symbol = w.symbol AND i.i = w.at""")
def m6_shuffled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's labels dealt anew under three seeds."""
    return models.shuffled_labels(scored(spark, sf_dir), [3, 4, 5], ["symbol"]).select("symbol", "ts", "seed", "label")


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM bars)"


@query(f"WITH {src.BARS}, {_NUMBERED} SELECT symbol, ts, i, CASE WHEN i < floor(c * 0.8) THEN 'fit' ELSE 'calibration' END AS part FROM n")
def w24_fit_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fit_or_calibration(features.numbered(bars(spark, sf_dir)), ["symbol"]).select("symbol", "ts", "i", "part")


@query(f"""WITH {src.BARS}, {_NUMBERED}, s AS (SELECT DISTINCT symbol, c, floor(c * 0.4)::BIGINT AS lead, (c - floor(c * 0.4)::BIGINT) // 5 AS size FROM n), f AS (SELECT *, unnest(range(5)) AS fold FROM s),
    b AS (SELECT symbol, fold, lead + fold * size AS a, CASE WHEN fold = 4 THEN c ELSE lead + (fold + 1) * size END AS z FROM f WHERE size > 0)
    SELECT n.symbol, fold, ts, CASE WHEN i < a THEN 'warmup' ELSE 'test' END AS part FROM n JOIN b ON b.symbol = n.symbol AND i >= a - 40 AND i < z""")
def j13_fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return features.fold_rows(b, indicators.walk_forward(b)).select("symbol", F.col("fold").cast("long").alias("fold"), "ts", "part")


@query(f"WITH {src.BARS}, f AS (SELECT symbol, arg_min(close, ts) AS first FROM bars GROUP BY 1) SELECT symbol, ts, CASE WHEN first > 0 THEN 1000000 * close / first ELSE 1000000 END AS hold, 1000000::DOUBLE AS flat FROM bars JOIN f USING (symbol)")
def w26_hold_and_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hold_and_flat(bars(spark, sf_dir))


@query(f"""WITH RECURSIVE {src.BARS}, {_recursion('bars', 's')}, b AS ({_PCT_B.format('bars')}), j AS (SELECT s.symbol, s.ts, s.close, f, w, {_RSI.format('s')} AS rsi, mid, dev, row_number() OVER (PARTITION BY s.symbol ORDER BY s.ts DESC) AS back FROM s JOIN b ON b.symbol = s.symbol AND b.ts = s.ts)
    SELECT symbol, ts, close, round(f, 6) AS ema_fast, round(w, 6) AS ema_slow, round(mid, 6) AS bb_mid, round(mid + 2 * dev, 6) AS bb_upper, round(mid - 2 * dev, 6) AS bb_lower, round(rsi, 6) AS rsi FROM j WHERE back <= 100""")
def w27_chart_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 100 candles of every symbol."""
    out = features.chart_feed(features.feature_table(bars(spark, sf_dir)), 100).drop("open", "high", "low")
    return rounded(out, 6, "ema_fast", "ema_slow", "bb_mid", "bb_upper", "bb_lower", "rsi")


@query(f"""WITH {src.BARS}, v AS (SELECT symbol, ts, close, (high - low) / close AS swing, list(struct_pack(h := high, l := low)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS a FROM bars WHERE close > 0)
    SELECT symbol, ts, coalesce(list_filter(list_transform(a, lambda b: CASE WHEN b.l <= close * 0.95 THEN 0 WHEN b.h >= close * (1 + 2 * swing) THEN 1 ELSE 2 END), lambda x: x < 2)[1], 0) AS label FROM v WHERE len(a) = 12""")
def w19_scaled_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is twice the bar's own swing, as k times ATR over close would be."""
    rows = bars(spark, sf_dir).filter("close > 0").withColumn("swing", (F.col("high") - F.col("low")) / F.col("close"))
    return indicators.triple_barrier(rows, target=2 * F.col("swing")).select("symbol", "ts", "label")


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm feature rows of all symbols but S0, which is their reference, with labels, numbered and parted 80 to 20 in every
    symbol."""
    table = features.feature_table(bars(spark, sf_dir), MODEL_FRAMES, "S0")
    labelled = scratch.written(indicators.triple_barrier(features.warm(table, MODEL_FEATURES)), "labelled")
    return features.fit_or_calibration(features.numbered(labelled), ["symbol"])


@query(f"""WITH {src.BARS}, v AS (SELECT symbol, sum(price * quantity)::DOUBLE AS quote_volume, arg_max(price, (ts, id))::DOUBLE AS last_price FROM ticks GROUP BY 1),
    top AS (SELECT * FROM v WHERE symbol NOT IN ('S0', 'S3') AND quote_volume >= 1000 AND last_price >= 1 ORDER BY quote_volume DESC, symbol LIMIT 5),
    r AS (SELECT symbol, ts, CASE WHEN lag(close) OVER o != 0 THEN close / lag(close) OVER o - 1 END AS r FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
    c AS (SELECT a.symbol, CASE WHEN count(*) >= 3 THEN corr(a.r, b.r) END AS c FROM r a JOIN r b ON a.ts = b.ts AND b.symbol = 'S0' WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1)
    SELECT top.symbol, quote_volume, last_price, round(c, 6) AS correlation FROM top LEFT JOIN c USING (symbol)""")
def c3_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog, floors, volume rank and correlation; S3 doesn't trade."""
    t = src.ticks(spark, sf_dir)
    tickers = t.groupBy("symbol").agg(F.sum(F.col("price") * F.col("quantity")).cast("double").alias("quote_volume"), F.max_by(F.col("price").cast("double"), F.struct("ts", "id")).alias("last_price"))
    symbols = tickers.select("symbol", F.col("symbol").alias("base_asset"), F.lit("USDT").alias("quote_asset"), F.when(F.col("symbol") == "S3", "BREAK").otherwise("TRADING").alias("status"), F.lit(True).alias("is_spot_trading_allowed"))
    out = screening.screen(symbols, tickers, bars(spark, sf_dir), "S0", 5, 1000.0, 1.0)
    return rounded(out.select("symbol", "quote_volume", "last_price", "correlation"), 6, "correlation")


#: All that a model is given: the required features, the trend, coarser frames and relative strength.
MODEL_FRAMES = {"4h": 4 * src.HOUR_MS, "12h": 12 * src.HOUR_MS}
MODEL_FEATURES = (*features.REQUIRED, "trend_regime_pct", *[f"{x}_{n}" for n in MODEL_FRAMES for x in ("rsi", "pct_b")], "relative_strength")


@query()
def m1_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M3: raw and calibrated scores of the calibration rows, by all features."""
    rows = scratch.written(dataset(spark, sf_dir), "dataset")
    return models.train(rows, MODEL_FEATURES).score(rows.filter("part = 'calibration'")).select("symbol", "ts", "label", "score", "probability")


@query()
def m5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scratch.written(dataset(spark, sf_dir), "dataset")
    return models.importance(models.train(rows, MODEL_FEATURES), rows.filter("part = 'calibration'"))


def _streamed(rows: DataFrame, files: int = 4) -> DataFrame:
    """rows as a stream of files, in order of seq."""
    return scratch.streamed(rows, "seq", files)


_BUCKETS = """SELECT symbol, ts // 1000 * 1000 AS bucket, sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END)::DOUBLE AS buy_volume, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END)::DOUBLE AS sell_volume,
    count(*) FILTER (NOT is_buyer_maker) AS buy_count, count(*) FILTER (is_buyer_maker) AS sell_count, sum(price * quantity)::DOUBLE AS notional, sum(price * quantity)::DOUBLE / sum(quantity)::DOUBLE AS vwap FROM ticks GROUP BY 1, 2"""


@query(f"WITH {src.TICKS} {_BUCKETS}")
def t1_live_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every third trade comes late appends partial buckets, which then add up."""
    t = src.ticks(spark, sf_dir).withColumn("seq", F.when(F.col("id") % 3 == 0, F.col("id") + 1_000_000).otherwise(F.col("id")))
    path = scratch.path(spark, "partials")
    live.append_partials(_streamed(t), path, scratch.path(spark, "state")).awaitTermination()
    return flow.as_doubles(live.compacted(spark, path))


@query(f"WITH {src.TICKS}, g AS (SELECT symbol, id, price, max(price) OVER (PARTITION BY symbol ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ticks) SELECT symbol, id FROM g WHERE seen IS NULL OR price > seen")
def t3_live_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = src.ticks(spark, sf_dir).select("symbol", "id", (F.col("price") * 100).cast("long").alias("open_time"), F.col("id").alias("seq"))
    return scratch.drained(live.accepted(_streamed(t)), "accepted").select("symbol", "id")


@query(f"WITH {src.TICKS} SELECT DISTINCT symbol, ts // 60000 * 60000 AS bucket FROM ticks")
def t4_live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = src.ticks(spark, sf_dir).select("symbol", "id", "ts", F.col("id").alias("seq"))
    return scratch.drained(live.sampled(_streamed(t)), "samples").select("symbol", "bucket")


@query(f"WITH {src.TICKS}, g AS (SELECT *, lag(id) OVER (PARTITION BY symbol ORDER BY ts, id) AS prev FROM ticks) SELECT symbol, prev + 1 AS expected_from, id AS found, id - prev - 1 AS missing, id - prev - 1 > 50000 AS is_hole FROM g WHERE id - prev > 1")
def t6_live_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades come in order of time, those of one time by id."""
    t = src.ticks(spark, sf_dir).select("symbol", "id", "ts", F.col("ts").alias("seq"))
    return scratch.drained(live.id_gaps(_streamed(t)), "gaps")


@query(f"WITH RECURSIVE {src.BARS}, {_recursion('bars', 's')} SELECT symbol, ts, round(f, 6) AS ema_fast, round({_RSI.format('s')}, 6) AS rsi, round(CASE WHEN i >= 14 THEN a END, 6) AS atr, round(sig, 6) AS macd_signal, round((close - t) / close, 6) AS trend_regime_pct FROM s")
def t5_live_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "ts", "high", "low", "close", F.col("ts").alias("seq"))
    out = scratch.drained(live.live_indicators(_streamed(b)), "indicators").select("symbol", "ts", "ema_fast", "rsi", "atr", "macd_signal", "trend_regime_pct")
    return rounded(out, 6, "ema_fast", "rsi", "atr", "macd_signal", "trend_regime_pct")
