"""Faults that the third round found on larger tables."""

import time

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import flow, identity, intervals, metrics
from tidemark.plans import live as kept
from tidemark.plans import market, registry
from tidemark.sources import scratch
from tidemark.streaming import flow as live


def found(df):
    return sorted(map(tuple, df.collect()))


def test_gaps_of_a_symbol_that_comes_in_several_arrow_batches(spark):
    """F1: a micro-batch of a symbol over 10 000 rows, ids that don't rise with time, and several trades of one time."""
    rows = spark.range(60_000).filter("id % 7 > 0").selectExpr("'S' AS symbol", "id", "id % 20000 div 3 * 1000 AS ts", "id % 20000 div 3 * 1000 AS seq")
    got = scratch.drained(live.id_gaps(scratch.streamed(rows, "seq", 2), hole=15_000), "gaps")
    want = flow.id_gaps(rows, hole=15_000)
    assert want.filter("is_hole").count() > 1000 and want.filter("NOT is_hole").count() > 1000
    assert found(got.select(*want.columns)) == found(want)


def test_live_gaps_query_takes_trades_by_time(spark, tmp_path):
    """copies of the events under other ids at the same times; the stream gives what the batch job gives."""
    spark.range(30).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id % 10 * 60000) AS ts", "0L AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    rows = market.src.ticks(spark, str(tmp_path))
    assert found(market.t6_live_gaps(spark, str(tmp_path))) == found(flow.id_gaps(rows)) != []


def test_rows_dont_meet_intervals_one_by_one(spark):
    """rows of a chunk are looked up in its intervals by one sort; intervals overlap, touch chunks' ends and nest, ids are null."""
    sets = spark.sql("SELECT 'a' AS symbol, id * 10 AS lo, id * 10 + 3 AS hi FROM range(30000) UNION ALL SELECT 'a', 95L, 121L UNION ALL SELECT 'b', 99990L, 300005L UNION ALL SELECT 'b', 100L, 100L UNION ALL SELECT 'b', -5L, 2L")
    rows = spark.sql("SELECT s AS symbol, id, id % 3 AS x FROM range(-10, 300010) LATERAL VIEW explode(array('a', 'b', 'c')) AS s UNION ALL SELECT 'a', NULL, 7L UNION ALL SELECT NULL, 5L, 8L")
    held = lambda s, i: i is not None and (s == "a" and (0 <= i < 300_000 and i % 10 < 4 or 95 <= i <= 121) or s == "b" and (99_990 <= i <= 300_005 or i == 100 or -5 <= i <= 2))
    every = [tuple(r) for r in rows.collect()]
    inside, outside = intervals.within(rows, sets), intervals.without(rows, sets)
    assert inside.columns == outside.columns == rows.columns
    order = lambda rs: sorted(map(tuple, rs), key=repr)
    assert order(inside.collect()) == order(r for r in every if held(*r[:2]))
    assert order(outside.collect()) == order(r for r in every if not held(*r[:2]))
    assert "Join" not in inside._jdf.queryExecution().optimizedPlan().toString() + outside._jdf.queryExecution().optimizedPlan().toString()


def by_sql(sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    return [d[0] for d in got.description], sorted(map(tuple, got.fetchall()), key=repr)


def test_trades_behind_the_last_captured_one_are_no_gap(spark, tmp_path):
    """230 trades of a symbol, the last thirty of which are missing."""
    spark.range(230).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id * 60000) AS ts", "0L AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    names, want = by_sql(tmp_path, "t2_backfill")
    assert len(want) == 200 and sorted(found(kept.t2_backfill(spark, str(tmp_path)).select(*names)), key=repr) == want


def test_a_ticker_of_several_suppliers_has_its_first_name(spark, tmp_path):
    """from the 2000th supplier on, tickers come again with other names; listing, root and name are asked for the first."""
    spark.range(2400).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(2400).selectExpr("id AS p_partkey", "concat('large ', CASE WHEN id % 31 = 0 THEN 'solo' ELSE 'part' END, CASE WHEN id < 2000 THEN id ELSE id - 2000 + 31 END) AS p_name", "'STEEL' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2400).selectExpr("id AS l_suppkey", "1.0D AS l_quantity", "2.0D AS l_extendedprice", "'N' AS l_returnflag", "timestamp'1995-01-02' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    names, want = by_sql(tmp_path, "c2_ticker_map")
    got = [tuple(r) for r in registry.queries()["c2_ticker_map"](spark, str(tmp_path)).select(*names).collect()]
    assert len(want) == 2000 and sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[names.index("source")] for r in got} == {"listing", "root", "name", None}


def test_names_of_long_texts_take_no_time_by_character(spark):
    """16 MB of names, which took minutes when every character was looked up among thousands."""
    rows = spark.range(400).select(F.repeat(F.concat(F.lit("Ação ﬁm x\ty-"), "id"), 2500).alias("n"))
    begun = time.monotonic()
    n, longest = rows.select(F.size(text.significant_tokens(F.col("n"))).alias("k"), F.length(text.plain_name(F.col("n"))).alias("c")).agg(F.sum("k"), F.max("c")).first()
    assert n > 400 and longest > 30_000 and time.monotonic() - begun < 20


def test_copies_of_names_dont_meet_each_other(spark):
    """20 000 tickers and 20 000 names of three sets of tokens, which made 200 million pairs."""
    names = spark.range(20_000).selectExpr("CASE WHEN id = 7 THEN 'one' ELSE concat('c', id % 5000) END AS company", "CASE WHEN id = 7 THEN 'ALPHA OMEGA' WHEN id % 2 = 0 THEN 'Alpha Beta' ELSE 'beta gamma' END AS name")
    asked = spark.range(20_000).selectExpr("concat('T', id div 2) AS ticker", "CASE WHEN id < 2 THEN 'omega' WHEN id = 2 THEN 'omega alpha' WHEN id % 2 = 0 THEN 'BETA' ELSE 'Gamma, beta' END AS name")
    begun = time.monotonic()
    assert found(identity.by_name(asked, names)) == [("T0", "one")] and time.monotonic() - begun < 20


def test_breaker_deals_its_rows_to_more_tasks_as_they_grow(spark, monkeypatch):
    """F8: several points of one time, a peak behind the fall in its time, and tasks by the number of rows."""
    curve = spark.createDataFrame([("a", 0, 1, 1, 100.0), ("a", 1000, 1, 1, 95.0), ("a", 1000, 2, 1, 106.0), ("a", 9_000_000, 1, 1, 120.0), ("b", 0, 1, 1, 100.0), ("b", 5, 1, 1, 99.0)], "run string, ts long, trade_id long, leg int, equity double")
    monkeypatch.setattr(metrics, "TASK_ROWS", 1)
    out = metrics.breaker(scratch.written(curve, "curve"))
    assert found(out) == [("a", 1000), ("b", None)]
    assert "RepartitionByExpression" in out._jdf.queryExecution().analyzed().toString()
