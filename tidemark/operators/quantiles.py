"""Exact quantiles without a sort or a list of a key's values.

A mergeable sketch per key bounds the place of each quantile: rows below the bounds are only counted, those within them are
counted by value. Running sums over the few values within, in chunks, then find the values at the exact ranks. Should a
sketch's bounds miss a rank, which shows in the counts, wider ones are taken; so the result never depends on the sketch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

from .running import running

#: Size of the sketches, and what is added to a rank on either side: some three times the error of such a sketch.
SKETCH, MARGIN = 2000, 0.004
#: Parts of the range within the bounds; rows of bounds that are broadcast at most.
_PARTS, _BROADCAST, _GRID = 64, 100_000, 1000


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: Column, more: list[Column] | None = None, margin: float = MARGIN) -> DataFrame:
    """keys, n, what ``more`` aggregates, name, p and quantile, linear between values, for every key and element of wanted.

    wanted is an array of structs (name, p) with p from 0 to 1, over the columns of the aggregation, so it may differ by key. Null values don't
    count, and a key without any has no row.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), *[c for c in rows.columns if c not in {*keys}])
    per = written(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_s"), *(more or [])), "sketches")
    # A sketch answers ranks that are literals only, so each key gets its values at even ranks.
    per = written(per.withColumn("_s", F.kll_sketch_get_quantile_double("_s", F.lit([k / _GRID for k in range(_GRID + 1)]))), "grids")
    extra = [c for c in per.columns if c not in {*keys, "n", "_s"}]
    asked = per.select("*", F.explode(wanted).alias("_w")).select("*", F.col("_w.name").alias("name"), F.col("_w.p").cast("double").alias("p"))
    asked = written(asked.withColumn("_k", (F.col("n") - 1) * F.col("p")).drop("_w"), "asked")
    found, open_ = None, asked
    while True:
        low = F.when(F.col("p") > margin, F.get("_s", F.floor((F.col("p") - margin) * _GRID).cast("int")))
        high = F.when(F.col("p") < 1 - margin, F.get("_s", F.ceil((F.col("p") + margin) * _GRID).cast("int")))
        bounds = written(open_.select(*[F.col(k).alias(f"_{k}") for k in keys], "name", low.alias("_low"), high.alias("_high")), "bounds")
        few = bounds.count() <= _BROADCAST
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        inside = ~F.coalesce(F.col("_v") < F.col("_low"), F.lit(False)) & ~F.coalesce(F.col("_v") > F.col("_high"), F.lit(False))
        met = known.select(*keys, "_v").join(F.broadcast(bounds) if few else bounds, same)
        met = met.filter(inside | F.coalesce(F.col("_v") < F.col("_low"), F.lit(False)))
        counts = written(met.groupBy(*keys, "name", F.when(inside, F.col("_v")).alias("_at")).agg(F.count(F.lit(1)).alias("_c")), "counts")
        # A place within the bounds as a part of them: it never falls along the values.
        spans = counts.filter("_at IS NOT NULL").groupBy(*keys, "name").agg(F.min("_at").alias("_a"), F.max("_at").alias("_b"))
        below = counts.filter("_at IS NULL").select(*keys, "name", F.col("_c").alias("_below"))
        on = lambda x, y: reduce(lambda a, b: a & b, [x[k].eqNullSafe(y[k]) for k in [*keys, "name"]])

        def beside(left: DataFrame, right: DataFrame, how: str = "inner", on=on) -> DataFrame:
            return left.join(right, on(left, right), how).drop(*[right[k] for k in [*keys, "name"]])

        values = written(beside(counts.filter("_at IS NOT NULL"), spans), "values")
        part = F.when(F.col("_b") > F.col("_a"), F.least(F.lit(_PARTS - 1), F.floor((F.col("_at") - F.col("_a")) / (F.col("_b") - F.col("_a")) * _PARTS))).otherwise(0).cast("int")
        summed = running(values.withColumn("_key", F.struct(*keys, "name")), ["_key"], part, ["_at"], F.col("_c"), "sum", "_upto").drop("_key", "_a", "_b")
        placed = beside(beside(summed, open_.select(*keys, "name", "_k")), below, "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
        first = lambda k: F.min(F.when(F.col("_below") + F.col("_upto") > k, F.col("_at")))
        got = placed.groupBy(*keys, "name").agg(
            F.when(F.max("_below") <= F.floor(F.max("_k")), first(F.floor("_k"))).alias("_x"), F.when(F.max("_below") <= F.floor(F.max("_k")), first(F.ceil("_k"))).alias("_y")
        )
        out = written(beside(open_, got, "left").withColumn("quantile", F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_k") - F.floor("_k"))), "quantiles")
        good = out.filter("quantile IS NOT NULL").select(*keys, "n", *extra, "name", "p", "quantile")
        found = good if found is None else found.unionByName(good)
        open_ = out.filter("quantile IS NULL").select(asked.columns)
        if margin >= 1 or open_.isEmpty():
            return found
        margin = min(1.0, margin * 16)
