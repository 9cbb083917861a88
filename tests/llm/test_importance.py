"""Importance resampling against brute force, SQL, ties and odd rows."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def buckets(text, longest=1):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [zlib.crc32(" ".join(ws[k : k + n]).encode()) % 10_000 for n in range(1, longest + 1) for k in range(len(ws) - n + 1)], len(ws)


def brute(docs, target, percent=10, least=20, longest=1):
    s, t = [0] * 10_000, [0] * 10_000
    held = [(i, *buckets(x, longest)) for i, x in docs]
    for _, bs, _ in held:
        for b in bs:
            s[b] += 1
    for x in target:
        for b in buckets(x, longest)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)] if held else []
    rows = []
    for i, bs, words in held:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        rows.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    pool = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query_is_brute_force_and_sql(spark):
    docs, target = (pq.read_table(f"{SF}/{n}.parquet").to_pylist() for n in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in queries.op12_importance(spark, SF).collect()), key=repr)
    assert got == brute([(d["doc_id"], d["text"]) for d in docs], [b["text"] for b in target])
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op12_importance"]).fetchall(), key=repr)


@pytest.mark.parametrize("percent,least,longest", [(0, 0, 1), (50, 1, 1), (70, 0, 2), (100, 1, 3)])
def test_odd_rows_and_ties(spark, odd, none, percent, least, longest):
    target = spark.createDataFrame([("hello license",), (None,)], "text string")
    got = importance.importance(odd, target, percent=percent, least_words=least, longest=longest)
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], ["hello license", None], percent, least, longest)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    strip = lambda rs: [r[:4] for r in rs]
    assert strip(rows) == strip(want)
    # Rows that are equal in score and id may change places.
    assert sorted((r[4] or 0, r[3]) for r in rows) == sorted((r[4] or 0, r[3]) for r in want)
    assert importance.importance(none, target).collect() == [] and importance.importance(odd, target.limit(0)).count() == odd.count()


def test_many_ties_are_cut_exactly(spark):
    """One text under one id, many times, and other ids with the same score: any percentage draws exactly that many."""
    rows = spark.range(400).select(F.when(F.col("id") < 300, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"))
    target = spark.createDataFrame([("a",)], "text string")
    for percent in (1, 33, 99):
        got = importance.importance(rows, target, percent=percent, least_words=1)
        assert sorted(r.rank for r in got.filter("rank IS NOT NULL").collect()) == list(range(1, 4 * percent + 1))


def test_bisection_against_sorting(spark):
    values = [(int(v),) for v in (-(2**63), -5, -5, -5, 0, 3, 3, 2**62, 2**63 - 2)]
    df = spark.createDataFrame(values, "v long")
    have = sorted((v for v, in values), reverse=True)
    for k in range(1, len(have) + 1):
        c, over, at = importance._reaching(df, F.col("v"), k)
        assert (c, over, at) == (have[k - 1], sum(v > have[k - 1] for v in have), have.count(have[k - 1]))


def test_drawn_rows_keep_their_columns(spark, odd):
    target = spark.createDataFrame([("hello license",)], "text string")
    got = importance.drawn_documents(odd, target, percent=100, least_words=0)
    assert got.columns == odd.columns and sorted(map(repr, got.collect())) == sorted(map(repr, odd.collect()))
    with pytest.raises(ValueError):
        importance.importance(odd, target, percent=101)
