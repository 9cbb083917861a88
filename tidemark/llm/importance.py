"""Target-distribution importance resampling over hashed word runs.

Every run of words falls into a bucket. What a bucket gains a document is the logarithm of its share of the target over
its share of all documents; a document's weight is the mean gain of its runs. Drawing the best of weight plus Gumbel noise
is drawing without replacement in proportion to the weights, and the noise is a hash of the id, so that reruns agree.

The draw takes no sort of all documents: a cutoff is found by bisection, whose steps count persisted scores exactly, and
among ties goes on with the ids. Only what is drawn is sorted, by ranges, for its ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, passing, row_of, unpacked, written
from .license_scan import GAP

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Midpoints that one count job holds rows against: four halvings at once.
_MIDS = 15


def run_buckets(text: Column, buckets: int = BUCKETS, longest: int = 1) -> Column:
    """Buckets of all runs of 1 to ``longest`` consecutive words, repeats included; none for a null text."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")
    hashed = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int")
    runs = [F.transform(words, hashed)]
    for n in range(2, longest + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, lambda i, n=n: hashed(F.array_join(F.slice(words, i, n), " "))))
    return F.concat(*runs) if len(runs) > 1 else runs[0]


def bucket_counts(rows: DataFrame, buckets_col: str, buckets: int) -> list[int]:
    """How many runs each bucket holds: one number per bucket comes to the driver."""
    out = [0] * buckets
    for b, n in rows.select(F.explode(buckets_col).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[b] = n
    return out


def gains(raw: list[int], target: list[int], buckets: int) -> list[int]:
    """Thousandths of a nat that a run of each bucket adds."""
    s_all, t_all = sum(raw), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(raw, target)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel variate, by the first 32 bits of a SHA-256. A null id hashes as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _floored_mean(total: Column, n: Column) -> Column:
    some = F.when(n > 0, n)
    return F.coalesce(F.floor((total - F.pmod(total, some)) / some).cast("long"), F.lit(0).cast("long"))


def scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, buckets: int, longest: int, seed: int, keep: list[str]) -> DataFrame:
    """id, r (the columns in keep), row, words, n_features, weight and score of every document, written."""
    words = F.size(F.filter(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP), lambda w: w != "")) if longest > 1 else F.size("b")
    cut = docs.select(F.col(id_col).alias("id"), row_of(keep), F.col(text_col), run_buckets(F.col(text_col), buckets, longest).alias("b"))
    cut = written(cut.withColumn("words", words).drop(text_col), "runs")
    gain = gains(bucket_counts(cut, "b", buckets), bucket_counts(target.select(run_buckets(F.col(text_col), buckets, longest).alias("b")), "b", buckets), buckets)
    # One text literal that is folded to an array of numbers, not one expression per bucket.
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate("b", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    n = F.size("b").cast("long")
    rows = cut.select("id", "r", F.col("words").cast("long").alias("words"), n.alias("n_features"), _floored_mean(total, n).alias("weight"))
    return written(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scored")


def _reaching(rows: DataFrame, key: Column, k: int) -> tuple[int, int, int]:
    """The largest c that k rows or more reach (key >= c), how many are over it, and how many are at it; rows hold k or more.

    Each job counts the rows that reach each of the midpoints of what is left.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    reach = {low: n, high + 1: 0}
    above = high + 1
    while above - low > 1:
        mids = sorted({low + (above - low) * i // (_MIDS + 1) for i in range(1, _MIDS + 1)} - {low})
        counts = rows.agg(*[F.count_if(key >= F.lit(m)) for m in mids]).first()
        reach.update(zip(mids, counts))
        low = max([low, *(m for m in mids if reach[m] >= k)])
        above = min([above, *(m for m in mids if reach[m] < k)])
    return low, reach[above], reach[low] - reach[above]


def _keys() -> list[Column]:
    """Numbers that order rows, best first where they are largest: score, then known ids, the smallest first, then rows."""
    return [F.col("score"), F.when(F.col("id").isNotNull(), 1).otherwise(0).cast("long"), F.bitwise_not(F.coalesce(F.col("id"), F.lit(0)).cast("long")), F.bitwise_not("row")]


def best(rows: DataFrame, k: int) -> Column:
    """A condition that holds for the k best of rows (id, score, row), which hold k or more; exact whatever the ties."""
    tied, cut, keys = rows, [], _keys()
    for key in keys:
        c, over, at = _reaching(tied, key, k)
        cut.append(c)
        k -= over
        if at == k:
            break
        tied = tied.filter(key == F.lit(c))
    out = keys[len(cut) - 1] >= F.lit(cut[-1])
    for key, c in reversed(list(zip(keys, cut[:-1]))):
        out = (key > F.lit(c)) | ((key == F.lit(c)) & out)
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, 1 for the best: ranges of scores are sorted each by itself, and a range's first rank follows from the
    numbers of rows in the ranges before it."""
    order = [k.desc() for k in _keys()]
    at = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("at", 33)
    sizes = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per range
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part bigint, before bigint")
    numbered = at.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "part", "before")


def importance(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of docs: id_col (an integer), n_features, weight, score, rank, and the columns in keep.

    Of the documents with least_words words or more, percent of a hundred are drawn, rounded down: those with the highest
    scores, of equal ones those with the smallest ids; null ids come last, and of rows with one id each counts by itself. rank
    is null for the others. A null or empty text has no run and weight 0. An empty table gives no rows, an empty target a
    target without runs. Other columns play no part; a new column replaces one in keep of its name, in whatever case.
    """
    if not (0 <= percent <= 100 and longest >= 1):
        raise ValueError("percent must be from 0 to 100 and longest at least 1")
    new = [id_col, "n_features", "weight", "score", "rank"]
    keep = passing(keep or [], new)
    rows = scored(docs, target, id_col, text_col, buckets, longest, seed, keep)
    pool = rows.filter(F.col("words") >= least_words)
    k = percent * pool.count() // 100
    drawn = best(pool, k) & (F.col("words") >= least_words) if k else F.lit(False)
    out = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked(rows.filter(drawn))) if k else rows.withColumn("rank", F.lit(None).cast("long"))
    return out.select(F.col("id").alias(id_col), *unpacked(keep), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are drawn, with all their columns, in no order. Odd rows count as in importance."""
    held = docs.select(F.col(id_col), F.col(text_col), row_of(docs.columns))
    return importance(held, target, id_col, text_col, keep=["r"], **how).filter("rank IS NOT NULL").select(*unpacked(docs.columns))
