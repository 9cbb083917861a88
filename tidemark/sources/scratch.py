"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet and read it again."""
    where = path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def streamed(rows: DataFrame, order: str, batches: int, parts: int = 3) -> DataFrame:
    """rows as a stream of micro-batches, ranges of the order column, the first range first; a batch is ``parts`` files."""
    spark, where = rows.sparkSession, path(rows.sparkSession, "stream")
    held = written(rows, "rows")
    cuts = [float("-inf"), *held.approxQuantile(order, [k / batches for k in range(1, batches)], 0.0), float("inf")]
    for a, b in zip(cuts, cuts[1:]):  # batches are few; files of later ones must be newer
        some = held.filter((held[order] > a) & (held[order] <= b))
        some.repartition(parts).sortWithinPartitions(order).write.mode("append").parquet(where)
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", parts).parquet(where)


def in_batches(rows: DataFrame, batch: str, parts: int = 3) -> DataFrame:
    """rows as a stream of one micro-batch per number in the batch column, in order, ``parts`` files each; without that column."""
    spark, where = rows.sparkSession, path(rows.sparkSession, "stream")
    held = written(rows, "rows")
    for (k,) in held.select(batch).distinct().orderBy(batch).collect():  # batches are few; files of later ones must be newer
        held.filter(held[batch] == k).drop(batch).repartition(parts).write.mode("append").parquet(where)
    return spark.readStream.schema(held.drop(batch).schema).option("maxFilesPerTrigger", parts).parquet(where)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table."""
    spark = stream.sparkSession
    out, state = path(spark, name), path(spark, f"{name}-state")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
