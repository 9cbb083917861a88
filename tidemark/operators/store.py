"""Tables that are kept: keyed stores with replaced partitions, an order-flow store with back-fill, days, runs, experiments.

Every write can be repeated: a batch has a number, and what it has already changed isn't changed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flow, ingest, intervals


def stored(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame | None:
    """The table at path; None (or no rows of like's columns) if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None if like is None else like.limit(0)


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Write df, replacing the partitions that it has and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(rows: DataFrame, path: str, key: list[str], batch: int, merge: Callable[[DataFrame], DataFrame], parts: int = 64) -> None:
    """Merge rows into a store that is parted by a hash of their key.

    merge makes one row per key of old and new rows together. Only parts with new rows are read and replaced. A part knows the
    last batch that it took: a batch that comes again, or an older one, leaves it as it is, so a batch that failed half way
    is simply repeated. Batches must come in ascending numbers, one at a time.
    """
    spark = rows.sparkSession
    new = rows.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    old = stored(spark, path)
    if old is not None:
        touched = [r[0] for r in new.select("part").distinct().collect()]  # at most ``parts`` numbers
        done = [r[0] for r in old.filter(F.col("part").isin(touched)).groupBy("part").agg(F.max("batch").alias("b")).filter(F.col("b") >= batch).collect()]
        new = new.filter(~F.col("part").isin(done))
        new = old.filter(F.col("part").isin([p for p in touched if p not in done])).drop("batch").unionByName(new)
    made = merge(new.drop("part")).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    _replace(made.withColumn("batch", F.lit(batch).cast("long")).repartition("part"), path, "part")


def upsert_buckets(buckets: DataFrame, path: str, batch: int, parts: int = 64) -> None:
    """Add order-flow buckets to a store of sums; vwap follows from the sums when they are read."""
    cols = ["symbol", "bucket", "buy_volume", "sell_volume", "buy_count", "sell_count", "notional"]
    wide = {"buy_volume": "decimal(38,6)", "sell_volume": "decimal(38,6)", "notional": "decimal(38,6)"}

    def merge(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("symbol", "bucket").agg(*[F.sum(c).alias(c) for c in cols[2:]])
        return sums.withColumns({c: F.col(c).cast(t) for c, t in wide.items()})

    upsert(buckets.select(*[F.col(c).cast(wide[c]).alias(c) if c in wide else F.col(c) for c in cols]), path, ["symbol", "bucket"], batch, merge, parts)


def upsert_orders(states: DataFrame, path: str, batch: int, mutable: list[str], parts: int = 64) -> None:
    """Order states into a store of one row per order: what may change from its latest state, everything else from its first.

    A stored row stands for its first and its latest state; states are ordered by updated_at and seq.
    """
    time = ["updated_at", "seq"]
    fixed = [c for c in states.columns if c not in {"client_order_id", *mutable, *time}]
    new = states.withColumns({"created_at": F.col("updated_at"), "first_seq": F.col("seq")})

    def merge(rows: DataFrame) -> DataFrame:
        first = F.min_by(F.struct(*fixed, "created_at", "first_seq"), F.struct("created_at", "first_seq"))
        latest = F.max_by(F.struct(*mutable, *time), F.struct(*time))
        return rows.groupBy("client_order_id").agg(first.alias("a"), latest.alias("b")).select("client_order_id", "a.*", "b.*")

    upsert(new, path, ["client_order_id"], batch, merge, parts)


def capture(trades: DataFrame, path: str, batch: int, bucket_ms: int = 1000) -> None:
    """A batch of trades, live or back-filled, into a store of partial buckets and captured id intervals.

    Trades whose id is in an interval of another batch are replays and go; of one id in the batch one stays. Partials and
    intervals lie under the number of their batch, which a repeated write replaces.
    """
    spark = trades.sparkSession
    known = stored(spark, f"{path}/ids")
    if known is not None:
        trades = intervals.without(trades, known.filter(F.col("batch") != batch).select("symbol", "lo", "hi"))
    fresh = trades.dropDuplicates(["symbol", "id"]).persist()
    number = F.lit(batch).cast("long").alias("batch")
    _replace(flow.flow_buckets(fresh, bucket_ms).drop("vwap").select("*", number), f"{path}/partials", "batch")
    _replace(intervals.covered(fresh).select("*", number), f"{path}/ids", "batch")
    fresh.unpersist()


def captured(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(buckets, intervals) of a capture store: partials added up, intervals merged."""
    return flow.merge_buckets(spark.read.parquet(f"{path}/partials").drop("batch")), intervals.merged(spark.read.parquet(f"{path}/ids").drop("batch"))


def backfill(spark: SparkSession, path: str, source: DataFrame, batch: int, hole: int = 50_000) -> None:
    """Capture what source has of the missing ids. Gaps wider than ``hole`` are accepted as holes and not asked for."""
    _, have = captured(spark, path)
    wanted = intervals.gaps(have, hole).filter("NOT is_hole")
    capture(intervals.within(source, wanted), path, batch)


def write_days(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """rows below path by UTC day, days replaced as a whole."""
    day = F.to_date(F.timestamp_millis(ts))
    _replace(rows.withColumn("day", day).repartition("day"), path, "day")


#: Days that are looked up by a broadcast table, a century of them.
MOST_DAYS = 36_525


def in_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of a table by day on the days of a small table (day). Days outside its span are pruned by the plan, those
    inside it that it doesn't have at run time."""
    wanted = days.select("day").distinct()
    first, last, n = wanted.agg(F.min("day"), F.max("day"), F.count("day")).first()
    if n > MOST_DAYS:
        raise ValueError("too many days to choose partitions by")
    spanned = F.col("day").between(F.lit(first), F.lit(last))
    return rows.filter(spanned).join(F.broadcast(wanted.filter(spanned)), "day")


def run_catalog(spark: SparkSession, path: str) -> DataFrame:
    """run_name, files and modified of every run that ingest.save_report() wrote, newest first, from names and times of its files alone."""
    rows = spark.read.parquet(path).select("run_name", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"))
    return rows.groupBy("run_name").agg(F.count_distinct("f").alias("files"), F.max("t").alias("modified")).orderBy(F.desc("modified"), "run_name")


def append_experiments(rows: DataFrame, path: str, batch: int) -> None:
    """Log rows (tool, params map, outcome, at) as JSON lines under the number of their batch."""
    log = rows.withColumn("batch", F.lit(batch).cast("long"))
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """The log: tool, params, outcome, at; no rows if there is none yet."""
    schema = "tool string, params map<string, string>, outcome string, at bigint, batch bigint"
    try:
        return spark.read.schema(schema).json(path).drop("batch")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).drop("batch")


def untried(candidates: DataFrame, path: str) -> DataFrame:
    """candidates (tool, params) that the log at path doesn't hold with the same parameters."""
    return ingest.already_tried(candidates, experiments(candidates.sparkSession, path)).filter("NOT tried").drop("tried")
