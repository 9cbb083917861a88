"""Models of the label by MLlib: boosting, calibration, scores, thresholds, importance and label permutation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

from . import running
from .indicators import DAY_MS
from .quantiles import quantiles
from .running import previous


@dataclass
class Scorer:
    """A fitted booster with its calibrator."""

    features: tuple[str, ...]
    booster: GBTClassificationModel
    calibrator: IsotonicRegressionModel

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with score (raw) and probability (calibrated; scores beyond the fitted range get its ends)."""
        raw = _raw(self.booster, rows, self.features)
        made = self.calibrator.setFeaturesCol("score").setPredictionCol("probability").transform(raw)
        return made


def _assembled(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)


def _raw(booster: GBTClassificationModel, rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    out = booster.setProbabilityCol("_p").setRawPredictionCol("_r").transform(_assembled(rows, features))
    return out.withColumn("score", vector_to_array("_p")[1]).drop("_x", "_r", "_p", "_y")


def train(rows: DataFrame, features: tuple[str, ...], seed: int = 7, trees: int = 20, depth: int = 4, balance: bool = True) -> Scorer:
    """rows (label, part fit or calibration): boost on the earlier part, the positive class weighted by negatives over
    positives, then fit an isotonic calibrator to the scores of the later part. Equal rows and seed give an equal model."""
    fit = rows.filter("part = 'fit'")
    n, positive = fit.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    weight = (n - positive) / positive if balance and positive else 1.0
    booster = GBTClassifier(
        featuresCol="_x", labelCol="label", weightCol="_w", predictionCol="_y", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.1
    ).fit(_assembled(fit.withColumn("_w", F.when(F.col("label") == 1, float(weight)).otherwise(1.0)), features))
    later = _raw(booster, rows.filter("part = 'calibration'"), features)
    calibrator = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="probability").fit(later.select("score", F.col("label").cast("double").alias("label")))
    return Scorer(features, booster, calibrator)


def label_rate() -> Column:
    return F.avg(F.col("label").cast("double"))


def brier_score(probability: str = "probability") -> Column:
    return F.avg((F.col(probability) - F.col("label")) ** 2)


def score_noise(scored: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """Population deviation of the differences between consecutive scores; 0 with fewer than two differences. order is a time
    in milliseconds."""
    seen = previous(scored.select(*keys, order, "score"), keys, F.expr(f"{order} div {DAY_MS}"), [order], ["score"], "_prev")
    rows = seen.withColumn("_d", F.col("score") - F.col("_prev.score")).groupBy(*keys)
    return rows.agg(F.when(F.count("_d") > 1, F.stddev_pop("_d")).otherwise(0.0).alias("noise"))


def thresholds(scored: DataFrame, keys: list[str], percentile: float = 80.0, multiple: float = 3.0, hysteresis: float = 3.0, order: str = "ts") -> DataFrame:
    """Entry and exit thresholds of every key from its calibration scores.

    The entry is the score at the given percentile, or at 100 less ``multiple`` times the label rate in percent if that is
    stricter, 99.9 at most, linear between scores. The exit is ``hysteresis`` times the noise below, 0 at least.
    """
    p = F.greatest(F.lit(percentile), F.least(F.lit(99.9), 100 - multiple * 100 * F.col("label_rate")))
    held = quantiles(scored, keys, "score", F.array(F.struct(F.lit("entry").alias("name"), (p / 100).alias("p"))), [label_rate().alias("label_rate")])
    held = held.select(*keys, "n", "label_rate", (F.col("p") * 100).alias("percentile"), F.col("quantile").alias("entry")).join(score_noise(scored, keys, order), keys)
    return held.withColumn("exit", F.greatest(F.lit(0.0), F.col("entry") - hysteresis * F.col("noise")))


#: Rounds of the bijection, and steps of its walk.
_ROUNDS, _WALK = 4, 64


def permuted(i: Column, n: Column, seed: Column) -> Column:
    """A bijection of 0 .. n - 1, drawn by the seed: a Feistel network over pairs of digits to the base floor(sqrt(n)) + 1,
    walked until it comes back below n. Few numbers lie beyond n, so nearly all rows take one step; of 4 rows or more, none
    takes 64 with a probability over 1e-16, and it would be an error."""
    base = F.floor(F.sqrt(n.cast("double"))).cast("long") + 1
    drawn = lambda x, k: F.conv(F.substring(F.md5(F.concat_ws(":", x.cast("string"), seed.cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("long")

    def step(x: Column) -> Column:
        high, low = F.floor(x / base).cast("long"), F.pmod(x, base)
        for k in range(_ROUNDS):
            if k % 2:
                low = F.pmod(low + drawn(high, k), base)
            else:
                high = F.pmod(high + drawn(low, k), base)
        return high * base + low

    first = step(i.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), first, lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))
    found = F.when(first < n, first).otherwise(walked)
    return F.when(n <= 1, F.lit(0).cast("long")).when(found < n, found).otherwise(F.raise_error(F.lit("the walk didn't come back")).cast("long"))


def shuffled_labels(rows: DataFrame, seeds: int | list[int], keys: list[str], order: str = "ts") -> DataFrame:
    """rows with their labels dealt anew within every key, once per seed (a column, if there are several): the same labels, in
    an order drawn by the seed. order is a time in milliseconds; rows of one time take an order of their own once.

    Rows are numbered by chunks of time, and number i takes the label of number permuted(i): one join on numbers, whatever
    the number of seeds.
    """
    many = isinstance(seeds, list)
    held = written(running.numbered(rows, keys, F.expr(f"`{order}` div {DAY_MS}"), [order], "_i"), "numbered")
    sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    asked = held.join(sizes, keys).withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in (seeds if many else [seeds])])))
    asked = asked.drop("label").withColumn("_i", permuted(F.col("_i"), F.col("_n"), F.col("seed")))
    out = asked.join(held.select(*keys, "_i", "label"), [*keys, "_i"])
    return out.select(*rows.columns, *["seed"] * many)


def importance(scorer: Scorer, held_out: DataFrame, seed: int = 11) -> DataFrame:
    """Per feature, largest first: the booster's share, how far scores move on the mean when the feature is dealt anew among
    held-out rows, and the sign of its correlation with the score (0 without variance).

    Rows are scored and numbered once. Every row then comes once per feature, with that feature taken from the row whose
    number is its own under a bijection drawn for the feature; all are scored together.
    """
    spark, names = held_out.sparkSession, list(scorer.features)
    base = written(scorer.score(held_out).select(*names, "score"), "raw")
    groups = base.count() // 50_000 + 1  # features are dealt anew within groups of some 50 000 rows
    base = base.withColumn("_g", F.pmod(F.xxhash64(*names, "score"), F.lit(groups)))
    base = written(base.withColumn("_i", (F.row_number().over(Window.partitionBy("_g").orderBy(*names)) - 1).cast("long")), "scored")
    sizes = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    features = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in enumerate(names)])
    each = base.join(sizes, "_g").withColumn("_f", F.explode(features))
    each = each.withColumn("_to", permuted(F.col("_i"), F.col("_n"), F.col("_f.k") + seed))
    others = base.select("_g", F.col("_i").alias("_to"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f).cast("double") for f in names])).alias("_v"))
    dealt = each.join(others, ["_g", "_to"])
    dealt = dealt.withColumns({f: F.when(F.col("_f.f") == f, F.col("_v")[f]).otherwise(F.col(f)) for f in names}).withColumnRenamed("score", "_s")
    impact = _raw(scorer.booster, dealt, scorer.features).groupBy(F.col("_f.f").alias("feature")).agg(F.avg(F.abs(F.col("score") - F.col("_s"))).alias("impact"))
    sides = base.agg(*[F.when((F.stddev_pop(f) > 0) & (F.stddev_pop("score") > 0), F.corr(f, "score")).otherwise(0.0).alias(f) for f in names]).first()
    shares = scorer.booster.featureImportances.toArray()
    known = spark.createDataFrame([(f, float(shares[k]), float(sides[f] or 0.0)) for k, f in enumerate(names)], "feature string, share double, direction double")
    out = known.join(impact, "feature", "left").select("feature", "share", F.coalesce("impact", F.lit(0.0)).alias("impact"), "direction")
    return out.orderBy(F.desc("impact"), "feature")
