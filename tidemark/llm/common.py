"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class of regular expressions and as plain characters.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
BATCH_ROWS, ARROW_ROWS = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot when it has more than this share of all rows; so fewer than 1000 keys are.
HOT = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passing(columns: Iterable[str], new: Iterable[str]) -> list[str]:
    """The columns that stay beside new ones: a new column replaces those of its name, which Spark compares without case."""
    taken = {n.lower() for n in new}
    return [c for c in columns if c.lower() not in taken]


def row_of(columns: Iterable[str]) -> Column:
    """A struct r of columns, so that no name of theirs can meet one that an operator uses. It is never empty."""
    held = [F.col(f"`{c}`") for c in columns]
    return F.struct(*(held or [F.lit(True).alias("-")])).alias("r")


def unpacked(columns: Iterable[str], at: str = "r") -> list[Column]:
    """The columns of row_of again."""
    return [F.col(f"{at}.`{c}`") for c in columns]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; other texts are translated."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local master, whose tasks all run on this
    machine, may do without that setting and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def arrow_rows(before: str) -> str:
    """BATCH_ROWS, or fewer if the session asks for fewer rows a batch."""
    return str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Python stages of df get Arrow batches of at most BATCH_ROWS rows: whole texts by the ten thousand fill memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, arrow_rows(before))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def salt_count(spark: SparkSession) -> int:
    """Salts per hot key: as many as there are shuffle partitions, which are sized to the input."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(counts: DataFrame, key: str, size: str, total: int) -> list:
    """The keys that more than HOT of all ``total`` rows have, by ``size`` in counts: fewer than 1000, whatever the data."""
    return [r[0] for r in counts.filter(F.col(size) > HOT * total).select(key).collect()]


def hot_and_rest(rows: DataFrame, groups: DataFrame, key: str, hot: list) -> tuple[DataFrame, DataFrame]:
    """rows joined with groups, which has one light row per key: those of the hot keys, and the rest.

    Groups of hot keys, fewer than 1000, are broadcast, so their rows stay where they are, and rows of hot keys without a
    group go; all others are shuffled by key.
    """
    among = F.col(key).isin(hot) if hot else F.lit(False)
    return rows.filter(among).join(F.broadcast(groups.filter(among)), key), rows.filter(~among).join(groups.filter(~among), key)


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with groups, which holds every key of the rows that may be hot, and in ``size`` how many rows have it.

    As hot_and_rest. groups is read several times: pass a written table.
    """
    hot = hot_keys(groups, key, size, total)
    if not hot:
        return rows.join(groups, key)
    some, rest = hot_and_rest(rows, groups, key, hot)
    return some.unionByName(rest)


def slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole texts, cut where another ``size`` bytes of its first column are full."""
    sizes = pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
