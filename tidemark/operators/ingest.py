"""Append-only tables, latest states, and logs of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(rows: DataFrame, existing: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """rows with ``is_new``: the first of its key in order, whose key existing doesn't hold. Null keys are keys.

    The reasons for both are kept apart: ``reason`` is null, 'existing' or 'repeated'.
    """
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    marked = rows.withColumn("_first", first)
    if existing is None:
        marked = marked.withColumn("_old", F.lit(False))
    else:
        old = existing.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).distinct().withColumn("_old", F.lit(True))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
        marked = marked.join(old, same, "left").drop(*[f"_k{i}" for i in range(len(key))]).withColumn("_old", F.coalesce("_old", F.lit(False)))
    reason = F.when(F.col("_old"), "existing").when(~F.col("_first"), "repeated")
    return marked.withColumn("reason", reason).withColumn("is_new", F.col("reason").isNull()).drop("_first", "_old")


def ingest_counts(marked: DataFrame, *by: str) -> DataFrame:
    """How many rows of append_new go in and how many are rejected as duplicates."""
    return marked.groupBy(*by).agg(F.count_if("is_new").alias("inserted"), F.count_if(~F.col("is_new")).alias("rejected_duplicate"))


def latest_state(states: DataFrame, key: str, time: list[str], mutable: list[str]) -> DataFrame:
    """One row per key: what may change from its latest state, everything else from its first."""
    fixed = [c for c in states.columns if c not in {key, *mutable, *time}]
    out = states.groupBy(key).agg(
        F.min_by(F.struct(*fixed), F.struct(*time)).alias("a"), F.max_by(F.struct(*mutable, *time), F.struct(*time)).alias("b"), F.min(time[0]).alias("created_at")
    )
    return out.select(key, "a.*", "b.*", "created_at")


def canonical(params: Column) -> Column:
    """A map of parameters as JSON text that doesn't depend on the order of its keys."""
    pairs = F.array_sort(F.map_entries(params))
    return F.to_json(F.map_from_entries(pairs))


def already_tried(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """candidates (tool, params map) with ``tried``: whether the log holds the same tool with the same parameters."""
    done = log.select(F.col("tool").alias("_tool"), canonical(F.col("params")).alias("_p")).distinct().withColumn("_t", F.lit(True))
    rows = candidates.withColumn("_q", canonical(F.col("params")))
    return rows.join(done, (F.col("tool") == F.col("_tool")) & (F.col("_q") == F.col("_p")), "left").withColumn("tried", F.coalesce("_t", F.lit(False))).drop("_tool", "_p", "_q", "_t")


def save_report(parts: dict[str, DataFrame], path: str, run: str) -> None:
    """Write the tables of a run (metrics, trades, equity curve, rejected signals) below path, each in its own folder, by run.
    A run that is saved again replaces itself and no other."""
    for name, df in parts.items():
        df.withColumn("run_name", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name").parquet(f"{path}/{name}")
