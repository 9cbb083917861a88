"""Quality rules: fixed counts, and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

The n-grams are all runs of ``N`` bytes of the whole UTF-8 text, white space too, hashed into ``buckets`` buckets. Two
multinomials over the buckets are counted, with add-one smoothing: one over all documents (raw), one over the trusted
documents (target). A document's score is the mean, over its n-grams, of ln(target) - ln(raw); the mean is the length
normalisation. One threshold decides every document. It is fitted by cross-validation: every trusted document is scored by
the others, and what is clearly below nearly all of those scores is rejected.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, passing, row_of, written

N = 4
BUCKETS = 1 << 13
#: Bound on the labelled documents that the target is counted from; those with the smallest hashes are taken.
MAX_TRUSTED = 20_000
#: Trusted documents are dealt to FOLDS parts by a hash of their id, and each part is scored without its own counts.
FOLDS = 10
#: The threshold stands MARGIN nats per n-gram below the LOW quantile of those scores.
LOW = 0.001
MARGIN = 0.05


class Ratios(NamedTuple):
    """ln(target) - ln(raw) of every bucket, and the score below which a document is rejected (None: no document is)."""

    table: list[float]
    threshold: float | None


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WS_CHARS))
    return F.when(bare != "", F.split(bare, WS + "+")).otherwise(F.array().cast("array<string>"))


def _bucket(data: Column, at: Column, buckets: int) -> Column:
    """Bucket of the n-gram at a place, from 1. In bytes a place is found at once, in characters only from the start."""
    return F.pmod(F.xxhash64(F.substring(data, at, F.lit(N))), F.lit(buckets)).cast("int")


def _places(data: Column) -> Column:
    """Places of the n-grams of a binary; none in a shorter one."""
    n = F.octet_length(data) - (N - 1)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most max_trusted ids of documents with quality 1."""
    return (
        labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    )


def _log_ratios(target: list[int], raw: list[int]) -> list[float]:
    n_raw, n_target = sum(raw) + len(raw), sum(target) + len(target)
    return [math.log((t + 1) / n_target) - math.log((r + 1) / n_raw) for r, t in zip(raw, target)]


def _mean_ratio(text: Column, table: list[float], buckets: int, skip: Column | int = 0) -> Column:
    """Mean over the n-grams of a text of the table's entries, from the entry numbered skip on; null without an n-gram."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded to one constant
    total = lambda d: F.aggregate(_places(d), F.lit(0.0), lambda acc, at: acc + F.get(ratios, skip + _bucket(d, at, buckets)))
    bound = F.transform(F.array(text.cast("binary")), total)  # the bytes are made once a text, not once an n-gram
    size = F.octet_length(text) - (N - 1)
    return F.when(size > 0, F.get(bound, F.lit(0)) / size)


def fit_ratios(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, folds: int = FOLDS, low: float = LOW, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text"
) -> Ratios | None:
    """The ratios, counted over all documents, and the threshold; None if no trusted document has an n-gram.

    Only trusted documents that pass the base rules have a say in the threshold. Without one, or without a trusted document
    in another fold to score it by, nothing but the base rules rejects. With some dozens of them it is low and
    rejects little, as each is scored by too few others; ``_replace(threshold=...)`` states one instead.
    What reaches the driver is one row per bucket and fold, whatever the corpus.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int").alias("fold")
    known = texts.join(F.broadcast(trusted.select("doc_id")), "doc_id").select("text", fold)

    def places(rows: DataFrame, *keys: str) -> DataFrame:
        at = rows.select(*keys, F.col("text").cast("binary").alias("d")).select(*keys, "d", F.explode(_places(F.col("d"))).alias("at"))
        return at.select(*keys, _bucket(F.col("d"), F.col("at"), buckets).alias("b")).groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"))

    raw, parts = [0] * buckets, [[0] * buckets for _ in range(folds)]
    for k, b, n in places(known, "fold").collect():
        parts[k][b] = n
    target = [sum(x) for x in zip(*parts)]
    if not sum(target):
        return None
    for b, n in places(texts).collect():
        raw[b] = n
    others = [x for part in parts for x in _log_ratios([t - p for t, p in zip(target, part)], raw)]
    alone = [k for k, part in enumerate(parts) if sum(part) == sum(target)]
    score = F.when(~F.col("fold").isin(alone), _mean_ratio(F.col("text"), others, buckets, F.col("fold") * buckets))
    # Written first: a filter would be pushed below the rules and have them computed over and over.
    scored = written(score_quality(known, None, keep=["text", "fold"]).select("_q.base_failed", score.alias("s")), "trusted")
    at = scored.filter("NOT base_failed").agg(F.percentile("s", low)).first()[0]
    return Ratios(_log_ratios(target, raw), None if at is None else round(at - margin, 6))


def score_quality(
    docs: DataFrame, ratios: Ratios | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: str = "_q"
) -> DataFrame:
    """docs (or its columns in keep) with a struct column out: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, llr, base_failed, kept.

    Null and empty texts have no words: all counts are 0, llr is null and base_failed holds (under 50 words).
    Without trusted n-grams (ratios None) llr is null and the base rules decide alone. Every row is decided by its own
    text, so repeated rows get equal results, an empty table gives none, and other columns pass through untouched; a
    column of docs with that name, in whatever case, is replaced.
    """
    keep = passing(docs.columns if keep is None else keep, [out])
    one = docs.select(row_of(keep), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "r", "t", _words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda s: F.btrim(s, F.lit(WS_CHARS)) != "").alias("lines")
    )
    w = F.col("w")
    grams = F.when(
        F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    )
    llr = F.when(F.size(w) > 0, _mean_ratio(F.col("t"), ratios.table, len(ratios.table))) if ratios else F.lit(None).cast("double")
    two = one.select(
        "r",
        "w",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        llr.alias("llr"),
        grams.alias("g"),
    )
    # Distinct hashes mean distinct windows. Only other texts are looked at again: sorted by hash, windows that are
    # found twice are neighbours, and neighbours with equal hashes are compared word by word.
    g = F.col("g")
    three = two.withColumn(
        "s", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    ).drop("g")
    s = F.col("s")

    def same(x: Column, y: Column) -> Column:
        equal = x["h"] == y["h"]
        for k in range(3):
            equal = equal & (F.get(w, x["i"] + k) == F.get(w, y["i"] + k))
        return F.coalesce(equal, F.lit(False))

    twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | ((i > 0) & same(x, F.get(s, i - 1))))
    four = three.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s", "w")
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    five = four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.lit(ratios.threshold if ratios else None), F.lit(True))
    return five.select(
        "r.*",
        F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", kept.alias("kept")).alias(out),
    )


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, out: str = "_q") -> DataFrame:
    """docs (or its columns in keep) with a struct column ``out``: the base counts, score and kept of every row.

    A null, empty or blank text has no word and fails the base rule; texts of any length are scored whole. Repeated rows count
    in the corpus and get equal results; an empty table gives none. Without a trusted document llr is null and the base rules
    decide alone. Other columns pass through; one named like ``out``, in whatever case, is replaced.
    """
    return score_quality(docs, fit_ratios(docs, trusted_ids(labels)), keep=keep, out=out)
