"""Exact quantiles: numpy's, whatever the sketch says and however one key outweighs the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles


@pytest.mark.parametrize("sketch,margin", [(2000, 0.004), (8, 0.0001)])
def test_quantiles_are_exact(spark, monkeypatch, sketch, margin):
    """A hot key, ties, a key of one value, null values and a null key; with a sketch that errs, wider bounds are taken."""
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    rng = np.random.default_rng(4)
    data = [("hot", float(x)) for x in rng.normal(size=5000)] + [("tied", float(x)) for x in rng.integers(0, 4, 900)] + [("one", 3.5), (None, 2.0), (None, 4.0), ("none", None), ("one", None)]
    rows = spark.createDataFrame(data, "k string, v double").repartition(5)
    wanted = F.array(*[F.struct(F.lit(f"p{p}").alias("name"), F.lit(p).alias("p")) for p in (0.0, 0.3, 0.5, 0.99, 1.0)], F.struct(F.lit("own").alias("name"), (1 / F.col("n")).alias("p")))
    got = {(r.k, r.name): r for r in quantiles.quantiles(rows, ["k"], "v", wanted, [F.max("v").alias("top")], margin).collect()}
    assert len(got) == 4 * 6
    for key in ("hot", "tied", "one", None):
        own = [v for k, v in data if k == key and v is not None]
        for name, p in (("p0.0", 0), ("p0.3", 0.3), ("p0.5", 0.5), ("p0.99", 0.99), ("p1.0", 1), ("own", 1 / len(own))):
            r = got[key, name]
            assert r.n == len(own) and r.top == max(own) and r.quantile == pytest.approx(np.percentile(own, 100 * p), rel=1e-12, abs=1e-12)


def test_a_hot_key_is_counted_not_gathered(spark):
    """Of 200 000 rows of one key, only the values within the bounds of the three ranks leave the first aggregation."""
    rows = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    kept = []
    real = quantiles.written
    quantiles.written = lambda df, name: kept.append((name, real(df, name))) or kept[-1][1]
    try:
        wanted = F.array(*[F.struct(F.lit(str(p)).alias("name"), F.lit(p).alias("p")) for p in (0.5, 0.95, 0.99)])
        got = {r.name: r.quantile for r in quantiles.quantiles(rows, ["k"], "v", wanted).collect()}
    finally:
        quantiles.written = real
    assert got == {"0.5": pytest.approx(99_999.5), "0.95": pytest.approx(0.95 * 199_999), "0.99": pytest.approx(0.99 * 199_999)}
    assert max(df.count() for name, df in kept if name == "counts") < 10_000
