"""Exact deduplication by skew-safe combining.

Three stages, each of which compares full content, as the text itself is part of every grouping key:

1. local: each input partition merges its own copies before anything moves;
2. salted: groups of (digest, salt, text) merge. Digests with more than a thousandth of all rows, fewer than 1000, are
   spread over many salts; all others have one, and are done;
3. global: the winners of a hot digest's salts, at most one per salt and text, are combined.

The digest is SHA-256 of the normalised text, so spellings that differ in the case of A-Z meet from the first stage on.
Rows find their group again by digest, which moves no text; hot groups go to their rows by a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, ascii_lower, hot_join, row_of, salt_count, unpacked, written


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _salt(salts: int) -> Column:
    """A salt that repeated ids can't share as a whole: rows of one input partition take turns."""
    return F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(salts)).cast("int")


def _counted(digests: DataFrame) -> tuple[DataFrame, int]:
    """Rows per digest as a written table, and rows in all."""
    per = written(digests.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best")), "digests")
    return per, per.agg(F.sum("n")).first()[0] or 0


def _parted(rows: DataFrame, per: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """rows of common digests and rows of hot ones."""
    hot = F.broadcast(per.filter(F.col("n") > HOT * total).select("sha"))
    return rows.join(hot, "sha", "left_anti"), rows.join(hot, "sha", "left_semi")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id stays.
    Rows repeated with the same id and an equal text: exactly one of them is kept. Null ids lose against
    all others; if a group has only null ids, keep_id is null and one row stays. An empty table gives no rows. Two texts
    with one digest raise an error. Other columns play no part.
    """
    salts = salts or salt_count(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), _norm(text_col).alias("norm")).select("id", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"))
    light = written(rows.select("id", "sha", F.monotonically_increasing_id().alias("row")), "rows")
    per, total = _counted(light.select("sha", F.struct(F.col("id").isNotNull().alias("has"), "id", "row").alias("best")))
    common, hot = _parted(rows, per, total)
    agg = lambda df, *keys: df.groupBy(*keys).agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    one = F.lit(1).alias("n")
    done = agg(common.select("sha", "norm", "id", one), "sha", "norm")
    spread = agg(hot.select("sha", "norm", "id", one, _salt(salts).alias("salt")), "sha", "salt", "norm")
    whole = done.unionByName(agg(spread, "sha", "norm"))
    differ = F.raise_error(F.lit("two texts have one SHA-256")).cast("bigint")
    groups = per.join(whole.select("sha", F.col("id").alias("keep_id"), F.col("n").alias("of_text")), "sha")
    groups = groups.select("sha", "keep_id", F.when(F.col("n") == F.col("of_text"), F.col("n")).otherwise(differ).alias("group_size"), F.col("best.row").alias("winner"))
    out = hot_join(light, written(groups, "groups"), "sha", "group_size", total)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("winner")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: one per distinct text, the one with the largest id.

    Null and empty texts, null ids, repeated rows and empty tables count as in exact_groups. A text moves once, one with
    a hot digest twice.
    """
    salts = salts or salt_count(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    per, total = _counted(docs.select(F.unhex(F.sha2(_norm(text_col), 256)).alias("sha"), F.lit(None).cast("int").alias("best")))
    rows = docs.select(row_of(others), F.col(text_col).alias("text"), F.col(id_col).alias("id"), _norm(text_col).alias("norm"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))

    def best(df: DataFrame, *keys: str) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("id").desc_nulls_last()))
        return df.withColumn("rank", first).filter("rank = 1").drop("rank")

    common, hot = _parted(rows, per, total)
    spread = best(hot.withColumn("salt", _salt(salts)), "sha", "salt", "norm").drop("salt")
    kept = best(common, "sha", "norm").unionByName(best(spread, "sha", "norm"))
    place = dict(zip(others, unpacked(others)))
    return kept.select(*[place.get(c, F.col("text").alias(c)) for c in docs.columns])
