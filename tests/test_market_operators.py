"""Operators on small tables with known results, odd values and plain loops."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import equities, features, flow, identity, indicators, ingest, metrics, models, running, screening, signals
from tidemark.sources import scratch

D = datetime.date


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_a_zero_close_gives_no_return(spark):
    p = spark.createDataFrame([("A", D(2020, 1, k), c, s) for k, (c, s) in enumerate([(10.0, None), (0.0, "EX"), (5.0, "ED"), (1.0, "EX"), (2.0, "EB")], 1)], "ticker string, trade_date date, close double, ex_suffix string")
    events = equities.corporate_events(p)
    assert rows(events, "ex_suffix", "is_level_break") == [("EB", True), ("ED", False), ("EX", True), ("EX", True)]
    moves = equities.implausible_moves(p, events.limit(0))
    assert rows(moves, "trade_date", "from_close", "ret") == [(D(2020, 1, 2), 10.0, -1.0), (D(2020, 1, 4), 5.0, -0.8), (D(2020, 1, 5), 1.0, 1.0)]


def test_class_rules(spark):
    df = spark.createDataFrame([("ON  EB  NM",), ("PNA",), ("UNT ED",), ("DRN",), ("",), (None,), ("  ON ",), ("E",)], "c string")
    got = [tuple(r) for r in df.select(text.is_equity_class(F.col("c")), text.ex_suffix(F.col("c"))).collect()]
    assert got == [(True, "EB"), (True, None), (True, "ED"), (False, None), (False, None), (False, None), (True, None), (False, None)]


def test_names(spark):
    df = spark.createDataFrame([("Companhia  Água & Luz S.A.",), ("straße ÇÃO",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(text.plain_name(F.col("c"))).collect()] == ["COMPANHIA AGUA LUZ S A", "STRAE CAO", "", None]
    assert df.select(text.significant_tokens(F.col("c"))).first()[0] == ["AGUA"]
    ids = spark.createDataFrame([("33000167000101",), (" 12 ",), ("3300016700010x",)], "c string").select(text.company_id(F.col("c")))
    assert [r[0] for r in ids.collect()] == ["33.000.167/0001-01", "12", "3300016700010x"]
    levels = spark.createDataFrame([("a / b / c",), ("a / b",), ("a /  / c",), ("",)], "c string").select(text.three_levels(F.col("c")).alias("x"))
    assert [tuple(r.x) if r.x else None for r in levels.collect()] == [("a", "b", "c"), None, None, None]


def test_filings_become_visible_on_their_day(spark):
    f = spark.createDataFrame(
        [("X", D(2015, 12, 31), "DFP", D(2016, 2, 25), 1, 1), ("X", D(2015, 12, 31), "DFP", D(2016, 3, 28), 2, 2), ("X", D(2015, 12, 31), "DFP", D(2016, 6, 2), 3, 3), ("X", D(2014, 12, 31), "DFP", D(2016, 6, 30), 4, 9)],
        "company string, period date, category string, received date, filing_id int, version int",
    )
    days = spark.createDataFrame([(D(2016, 2, 24),), (D(2016, 2, 25),), (D(2016, 7, 15),)], "decision_date date")
    assert rows(equities.filing_as_of(f, days), "decision_date", "period", "version") == [(D(2016, 2, 25), D(2015, 12, 31), 1), (D(2016, 7, 15), D(2014, 12, 31), 9), (D(2016, 7, 15), D(2015, 12, 31), 3)]
    assert rows(equities.latest_filing_as_of(f, days), "decision_date", "version") == [(D(2016, 2, 25), 1), (D(2016, 7, 15), 3)]


def test_drawdown_exposure_and_ratios(spark):
    curve = spark.createDataFrame([("a", k * 90_000_000, k, 0, float(e)) for k, e in enumerate((1000, 1200, 900, 1100, 1150))] + [("up", k, k, 0, float(k + 1)) for k in range(4)], "run string, ts long, trade_id int, leg int, equity double")
    assert rows(metrics.drawdown(curve)) == [("a", 0.25, 3 * 90_000_000), ("up", 0.0, 0)]
    got = {r.run: r for r in metrics.return_ratios(curve, 1000).collect()}
    assert got["a"].total_return == pytest.approx(0.15) and got["a"].return_over_drawdown == pytest.approx(0.6) and got["up"].return_over_drawdown == 0.0
    t = spark.createDataFrame([("r", Decimal(x), Decimal(100), Decimal(100)) for x in (20, -10, -5)] + [("w", Decimal(1), Decimal(1), Decimal(1))], "run string, pnl decimal(18,4), entry_notional decimal(18,2), exit_notional decimal(18,4)")
    stats = {r.run: r for r in metrics.trade_stats(t).collect()}
    assert stats["r"].profit_factor == 20 / 15 and stats["w"].profit_factor == float("inf") and stats["r"].net_pnl == pytest.approx(5 - 3 * 0.2)


def test_breaker_is_that_of_a_loop(spark):
    rng = random.Random(5)
    data, want = [], {}
    for run in "abc":
        e, ts, history, peak = 1000.0, 0, [], 0.0
        for k in range(400):
            ts += rng.randint(1, 1_500_000)
            e *= 1 + rng.uniform(-0.02, 0.0198)
            data.append((run, ts, k, 0, e))
            history = [x for x in history if ts - x[0] <= 3_600_000] + [(ts, e)]
            peak = max(peak, e)
            top = max(x[1] for x in history)
            if run not in want and ((top - e) / top >= 0.1 or (peak - e) / peak >= 0.1):
                want[run] = ts
    curve = spark.createDataFrame(data, "run string, ts long, trade_id int, leg int, equity double")
    assert {r.run: r.triggered_at for r in metrics.breaker(curve).collect()} == {r: want.get(r) for r in "abc"}


def test_running_values_are_those_of_one_window(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), ts, k, rng.choice([None, 1, 5, -3])) for k, ts in enumerate(sorted(rng.randint(0, 900) for _ in range(300)))]
    df = spark.createDataFrame(data, "key string, ts long, id int, v int")
    out = running.running(df, ["key"], F.expr("ts div 100"), ["ts", "id"], F.col("v"), "sum", "s")
    out = running.running(out, ["key"], F.expr("ts div 100"), ["ts", "id"], F.col("v"), "max", "m", current=False)
    out = running.previous(out, ["key"], F.expr("ts div 100"), ["ts", "id"], ["id", "v"])
    got = {r.id: (r.s, r.m, tuple(r.prev) if r.prev else None) for r in out.collect()}
    state = {}
    for key, _, k, v in data:
        s, m, prev = state.get(key, (None, None, None))
        total = s if v is None else v + (s or 0)
        assert got[k] == (total, m, prev), k
        state[key] = (total, m if v is None else v if m is None else max(m, v), (k, v))


def test_flow_buckets_and_partials(spark):
    t = spark.createDataFrame([("S", 1, 0, Decimal("100"), Decimal("1"), False), ("S", 2, 10, Decimal("200"), Decimal("1"), True), ("S", 3, 1500, Decimal("50"), Decimal("2"), False)], "symbol string, id int, ts long, price decimal(18,2), quantity decimal(18,1), is_buyer_maker boolean")
    b = flow.as_doubles(flow.flow_buckets(t)).collect()
    assert {(r.bucket, r.buy_volume, r.sell_volume, r.vwap) for r in b} == {(0, 1.0, 1.0, 150.0), (1000, 2.0, 0.0, 50.0)}
    parts = [flow.flow_buckets(t.filter(f"id = {k}")).drop("vwap") for k in (1, 2, 3)]
    assert rows(flow.as_doubles(flow.merge_buckets(*parts))) == rows(flow.as_doubles(flow.flow_buckets(t)))


def test_append_only(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "z", 3), (None, "m", 4), (3, "w", 5)], "k int, v string, o int")
    marked = ingest.append_new(new, old, ["k"], ["o"])
    assert rows(marked, "v", "reason") == [("m", "existing"), ("w", None), ("x", "existing"), ("y", None), ("z", "repeated")]
    assert tuple(ingest.ingest_counts(marked).first()) == (2, 3)
    assert tuple(ingest.ingest_counts(ingest.append_new(new, None, ["k"], ["o"])).first()) == (4, 1)


def test_identity_is_never_the_first_of_several(spark):
    asked = spark.createDataFrame([("AAAA3", "x"), ("BBBB3", "x"), ("BBBB4", "x"), ("CCCC3", "Padaria Central Ltda"), ("DDDD3", "Central"), ("EEEE3", "GRUPO SA")], "ticker string, name string")
    registry = {
        "tickers": spark.createDataFrame([("AAAA3", "1"), ("BBBB3", "2"), ("BBBB3", "3")], "ticker string, company string"),
        "roots": spark.createDataFrame([("BBBB", "4"), ("AAAA", "9")], "root string, company string"),
        "names": spark.createDataFrame([("5", "PADARIA CENTRAL LTDA DO SUL"), ("6", "CENTRAL HOTEL"), ("7", "GRUPO SA")], "company string, name string"),
    }
    got = {r.ticker: (r.company, r.source) for r in identity.resolve(asked, registry).collect()}
    assert got == {"AAAA3": ("1", "listing"), "BBBB3": ("4", "root"), "BBBB4": ("4", "root"), "CCCC3": ("5", "name"), "DDDD3": (None, None), "EEEE3": (None, None)}


def test_intervals_include_both_ends(spark):
    iv = spark.createDataFrame([("K", "old", D(2010, 1, 1), D(2019, 10, 10)), ("K", "new", D(2019, 10, 11), None)], "ticker string, company string, valid_from date, valid_to date")
    asked = spark.createDataFrame([("K", D(2009, 12, 31)), ("K", D(2010, 1, 1)), ("K", D(2019, 10, 10)), ("K", D(2019, 10, 11)), ("K", D(2030, 1, 1))], "ticker string, decision_date date")
    assert [r[1] for r in rows(identity.company_as_of(asked, iv), "decision_date", "company")] == [None, "old", "old", "new", "new"]


def test_costs_sizes_and_strategies(spark):
    row = spark.createDataFrame([(1000.0, 100.0, 0.02, 25.0, -0.1, None)], "equity double, price double, stop double, rsi double, pct_b double, trend_regime_pct double")
    risk, costs = signals.Risk(0.01, 0.1), signals.Costs()
    e, p, s = F.col("equity"), F.col("price"), F.col("stop")
    got = row.select(risk.size(e, p, s), risk.size(e, p, F.lit(0.5)), risk.size(e, p, F.lit(None).cast("double")), risk.rejection(e, p, F.lit(0.0)), costs.filled(p, F.lit("buy")), costs.filled(p, F.lit("sell"))).first()
    assert tuple(got) == (1.0, 0.2, None, "missing_stop", pytest.approx(100.05), pytest.approx(99.95))
    s1 = signals.rsi_bollinger()
    assert tuple(s1.signals(row).select("enter", "exit").first()) == (True, False)
    assert tuple(s1.gated(signals.regime_gate(0.0)).signals(row).select("enter", "exit").first()) == (False, False)
    for bad in (lambda: signals.Risk(0), lambda: signals.Risk(0.1, 1.5), lambda: signals.Costs(Decimal(1))):
        with pytest.raises(ValueError):
            bad()


def test_an_empty_book_has_no_imbalance(spark):
    df = spark.createDataFrame([([], [])], "bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    r = df.select(*[c.alias(n) for n, c in signals.depth_fields(F.col("bids"), F.col("asks")).items()]).first()
    assert (r.best_bid, r.spread_pct, r.bid_depth, r.imbalance) == (None, None, 0.0, 0.0)


def test_relative_strength_may_exclude_the_same_time(spark):
    data = [(s, t, c, c, c, c, 1.0) for t in range(4) for s, c in (("R", 100.0 + 10 * t), ("X", 50.0 + t))]
    b = spark.createDataFrame(data, "symbol string, ts long, open double, high double, low double, close double, volume double")
    same = {r.ts: r.reference_return for r in features.relative_strength(b, "R", 1).collect()}
    before = {r.ts: r.reference_return for r in features.relative_strength(b, "R", 1, allow_exact_match=False).collect()}
    assert same == {0: None, 1: pytest.approx(0.1), 2: pytest.approx(10 / 110), 3: pytest.approx(10 / 120)}
    assert before == {0: None, 1: None, 2: pytest.approx(0.1), 3: pytest.approx(10 / 110)}


def test_too_few_rows_to_split_are_an_error(spark):
    one = spark.createDataFrame([("a", 0)], "symbol string, i long")
    with pytest.raises(Exception, match="not enough rows"):
        features.fit_or_calibration(one, ["symbol"]).collect()


def test_folds_purge_and_take_the_rest(spark):
    df = spark.range(500).selectExpr("'a' AS symbol", "id AS ts")
    got = sorted(indicators.walk_forward(df, 5, 0.4, 15).collect(), key=lambda r: r.fold)
    assert [(r.train_end, r.test_start) for r in got] == [(185 + 60 * k, 200 + 60 * k) for k in range(5)] and got[-1].test_end == 500
    assert {r.train_end for r in indicators.walk_forward(df, 5, 0.4, 10_000).collect()} == {0}


def test_gates_come_in_order(spark):
    cols = "config string, fold int, n int, gross_loss double, profit_factor double, max_drawdown double"
    c = spark.createDataFrame([("a", 1, 5, 1.0, 9.0, 0.1), ("a", 2, 40, 0.0, 9.0, 0.1), ("a", 3, 40, 1.0, 0.9, 0.1), ("a", 4, 40, 1.0, 1.1, 0.1), ("a", 5, 40, 1.0, 2.0, 0.5), ("b", 1, 40, 1.0, 2.0, 0.1)], cols)
    base = spark.createDataFrame([(k, 1.2, 0.2) for k in range(1, 6)], "fold int, profit_factor double, max_drawdown double")
    j = screening.judged(c, base, ["fold"])
    assert [r[2] for r in rows(j, "config", "fold", "reason")] == ["too_few_trades", "no_loss", "not_profitable", "not_over_baseline", "deeper_drawdown", None]
    assert rows(screening.promoted(j)) == [("a", False), ("b", True)] and screening.promoted(j.limit(0)).count() == 0


def test_models_learn_in_order_and_repeat(spark):
    rng = random.Random(0)
    data = [("a", k, rng.uniform(0, 100), rng.random()) for k in range(600)]
    df = spark.createDataFrame([(s, t, x, z, int(x + rng.uniform(-5, 5) > 50)) for s, t, x, z in data], "symbol string, ts long, x double, z double, label int")
    parted = scratch.written(features.fit_or_calibration(features.numbered(df), ["symbol"]), "parted")
    assert parted.filter("part = 'fit'").agg(F.max("ts")).first()[0] < parted.filter("part = 'calibration'").agg(F.min("ts")).first()[0]
    m = models.train(parted, ("x", "z"), trees=4, depth=3)
    out = m.score(parted.filter("part = 'calibration'"))
    r = out.agg(F.min("probability"), F.max("probability"), models.brier_score().alias("b")).first()
    assert 0 <= r[0] <= r[1] <= 1 and r.b < 0.12
    again = models.train(parted, ("x", "z"), trees=4, depth=3).score(parted.filter("part = 'calibration'"))
    assert rows(out, "ts", "score") == rows(again, "ts", "score")
    top = models.importance(m, parted.filter("part = 'calibration'")).collect()
    assert top[0].feature == "x" and top[0].impact > top[1].impact and top[0].direction > 0.5
    one, two, other = (models.shuffled_labels(df, s, ["symbol"]) for s in (1, 1, 2))
    assert rows(one) == rows(two) != rows(other) and one.agg(F.sum("label")).first() == df.agg(F.sum("label")).first() and one.columns == df.columns


def test_reports_are_kept_by_run(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    for run in ("one", "two"):
        ingest.save_report({"metrics": df, "trades": df.limit(0)}, str(tmp_path), run)
    assert rows(spark.read.parquet(str(tmp_path / "metrics")), "run_name", "a") == [("one", 1), ("two", 1)]
