"""Stored tables can be written again; interval sets; days read alone; late trades counted."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import flow, ingest, intervals, store
from tidemark.sources import scratch
from tidemark.streaming import features as live_features
from tidemark.streaming import flow as live


def found(df):
    return sorted(map(tuple, df.collect()))


def ids(sets):
    return {(s, i) for s, lo, hi in sets for i in range(lo, hi + 1)}


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_interval_sets(spark, monkeypatch, chunk):
    monkeypatch.setattr(intervals, "CHUNK", chunk)
    rng = random.Random(3)
    have = {(s, i) for s in "ab" for i in range(80) if rng.random() < 0.7}
    rows = spark.createDataFrame([*have, *list(have)[:20]], "symbol string, id long")
    got = found(intervals.covered(rows).select("symbol", "lo", "hi"))
    assert ids(got) == have and all((s, hi + 1) not in have and (s, lo - 1) not in have for s, lo, hi in got)
    more = spark.createDataFrame([("a", 3, 9), ("a", 5, 6), ("a", 10, 12), ("c", 1, 1), ("b", 0, 40)], "symbol string, lo long, hi long")
    both = found(intervals.merged(intervals.covered(rows), more).select("symbol", "lo", "hi"))
    union = have | ids(found(more))
    assert ids(both) == union and all((s, hi + 1) not in union for s, _, hi in both)
    missing = {(s, i) for s in "abc" for i in range(80) if (s, i) not in union and any((s, j) in union for j in range(i)) and any((s, j) in union for j in range(i, 80))}
    gaps = intervals.gaps(intervals.merged(intervals.covered(rows), more), 1)
    assert ids(found(gaps.select("symbol", "lo", "hi"))) == missing and all(r.is_hole == (r.missing > 1) and r.missing == r.hi - r.lo + 1 for r in gaps.collect())
    every = spark.createDataFrame([(s, i) for s in "abc" for i in range(-3, 90)], "symbol string, id long")
    assert set(found(intervals.within(every, more))) == ids(found(more))
    assert len(found(intervals.without(every, more))) == 93 * 3 - len(ids(found(more)))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_upserts_replace_touched_parts_only_and_can_be_repeated(spark, tmp_path):
    path = f"{tmp_path}/sums"
    buckets = lambda ks: flow.flow_buckets(spark.createDataFrame([("S", k * 1000, k) for k in ks], "symbol string, ts long, id long").selectExpr("*", "cast(1 AS decimal(9,2)) AS price", "cast(2 AS decimal(9,1)) AS quantity", "id % 2 = 0 AS is_buyer_maker"))
    store.upsert_buckets(buckets(range(40)), path, 0, 8)
    before, once = files(path), found(store.stored(spark, path).drop("batch"))
    store.upsert_buckets(buckets(range(40)), path, 0, 8)
    assert files(path) == before and found(store.stored(spark, path).drop("batch")) == once
    store.upsert_buckets(buckets([3, 100]), path, 1, 8)
    kept = [f for f, t in files(path).items() if before.get(f) == t]
    assert 0 < len({os.path.dirname(f) for f in kept}) < len({os.path.dirname(f) for f in before})
    store.upsert_buckets(buckets([3, 100]), path, 1, 8)
    rows = {r.bucket: r.buy_count + r.sell_count for r in store.stored(spark, path).collect()}
    assert rows == {k * 1000: 1 + (k == 3) for k in [*range(40), 100]}


def test_a_batch_that_failed_half_way_is_repeated(spark, tmp_path):
    """One part took batch 1, the others didn't: the same batch again completes them and leaves that part alone."""
    path = f"{tmp_path}/t"
    merge = lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))
    rows = spark.range(30).selectExpr("id AS k", "1L AS v")
    store.upsert(rows, path, ["k"], 0, merge, 4)
    part = F.pmod(F.xxhash64("k"), F.lit(4)) == 0
    store.upsert(rows.filter(part), path, ["k"], 1, merge, 4)
    store.upsert(rows, path, ["k"], 1, merge, 4)
    assert {r.v for r in store.stored(spark, path).collect()} == {2} and store.stored(spark, path).count() == 30


def test_orders_keep_their_first_and_latest_state(spark, tmp_path):
    path, schema = f"{tmp_path}/o", "client_order_id string, symbol string, updated_at long, seq long, status string"
    store.upsert_orders(spark.createDataFrame([("x", "A", 5, 1, "NEW"), ("y", "B", 1, 2, "NEW")], schema), path, 0, ["status"], 4)
    store.upsert_orders(spark.createDataFrame([("x", "B", 9, 3, "FILLED"), ("x", "C", 2, 0, "OLD")], schema), path, 1, ["status"], 4)
    got = found(store.stored(spark, path).select("client_order_id", "symbol", "status", "updated_at", "created_at"))
    assert got == [("x", "C", "FILLED", 9, 2), ("y", "B", "NEW", 1, 1)]


def test_a_missing_store_is_none(spark, tmp_path):
    assert store.stored(spark, f"{tmp_path}/nothing") is None
    assert store.experiments(spark, f"{tmp_path}/nothing").collect() == []


def test_runs_are_saved_once(spark, tmp_path):
    trades = spark.range(3).withColumnRenamed("id", "trade_id")
    for run in ("a", "b", "a"):
        ingest.save_report({"trades": trades}, f"{tmp_path}", run)
    assert spark.read.parquet(f"{tmp_path}/trades").count() == 6
    listed = store.run_catalog(spark, f"{tmp_path}/trades")
    assert [r.run_name for r in listed.collect()] == ["a", "b"]
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id * 3600000 AS ts")
    store.write_days(rows, f"{tmp_path}/days")
    days = scratch.written(spark.createDataFrame([("1970-01-03",), ("1970-01-05",)], "d string").selectExpr("cast(d AS date) AS day"), "wanted")
    got = store.in_days(spark.read.parquet(f"{tmp_path}/days"), days)
    assert sorted(r.id for r in got.collect()) == [*range(48, 72), *range(96, 120)]
    q = got._jdf.queryExecution()
    assert "dynamicpruning" in q.executedPlan().toString()
    assert "(day#" in q.executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0] and len(glob.glob(f"{tmp_path}/days/day=*")) == 9


def test_late_trades_are_counted(spark):
    """Two batches set the watermark; what the third brings from before it is dropped and counted."""
    row = lambda b, ts: (b, "S", ts, ts, False)
    data = [row(0, 0), row(1, 100_000_000), row(2, 100_000_500), row(3, 1000), row(3, 99_999_000), row(3, 100_001_000)]
    rows = spark.createDataFrame(data, "batch int, symbol string, id long, ts long, is_buyer_maker boolean").selectExpr("*", "cast(1 AS decimal(9,2)) AS price", "cast(1 AS decimal(9,1)) AS quantity")
    stream = live.live_buckets(scratch.in_batches(rows, "batch", 1), late="1 minute")
    q = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", scratch.path(spark, "late")).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_live_features_leave_out_what_comes_too_late(spark):
    bars = [(0, "S", k * 60_000, 10.0 + k, 9.0 + k, 9.5 + k, 1.0) for k in range(5)]
    again = [(1, "S", 60_000, 99.0, 99.0, 99.0, 9.0), (1, "S", 5 * 60_000, 15.0, 14.0, 14.5, 1.0), (1, "S", 5 * 60_000, 0.0, 0.0, 0.0, 0.0)]
    rows = spark.createDataFrame([*bars, *again[:2]], "batch int, symbol string, ts long, high double, low double, close double, volume double")
    got = scratch.drained(live_features.live_features(scratch.in_batches(rows, "batch", 1), {"2m": 120_000}), "late")
    assert [(r.ts, r.close) for r in got.orderBy("ts").collect()] == [(k * 60_000, 9.5 + k) for k in range(6)]
    with pytest.raises(ValueError):
        live_features.live_features(rows, {}, "S")
