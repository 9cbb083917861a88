"""From tickers to companies: by listing, by root, by name; validity intervals; and the universe with all its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import significant_tokens

from .equities import universe, validity


def _unique(pairs: DataFrame, key: str) -> DataFrame:
    """Keys with exactly one company; an ambiguous key resolves nothing."""
    return pairs.groupBy(key).agg(F.count_distinct("company").alias("n"), F.min("company").alias("company")).filter("n = 1").select(key, "company")


def by_name(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(ticker, company) where all significant tokens of the ticker's name are among those of one name of exactly one company.

    Names and asked names count once per set of tokens; of a set's companies the least and the largest say whether it is one.
    An inverted index of sets is probed by each asked set's rarest token alone; what it finds is verified on the sets. A token
    that is in very many sets is probed only by sets that have no rarer one. A token that no name has ends the search: it is
    the rarest.
    """
    ends = lambda a, b: [F.min(a).alias("least"), F.max(b).alias("most")]
    tokens = F.array_sort(significant_tokens(F.col("name")))
    known = names.select("company", tokens.alias("of")).filter("size(of) > 0").groupBy("of").agg(*ends("company", "company"))
    index = known.select("of", "least", "most", F.explode("of").alias("token"))
    sizes = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("ticker", tokens.alias("t")).filter("size(t) > 0")
    ranked = asked.select("t").distinct().select("t", F.explode("t").alias("token")).join(sizes, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token"))
    probes = ranked.groupBy("t").agg(rarest.alias("token"))
    held = probes.join(index, "token").filter(F.size(F.array_except("t", "of")) == 0).groupBy("t").agg(*ends("least", "most"))
    found = asked.join(held, "t").groupBy("ticker").agg(*ends("least", "most"))
    return found.filter("least = most").select("ticker", F.col("least").alias("company"))


def resolve(queries: DataFrame, registry: dict[str, DataFrame], root_len: int = 4) -> DataFrame:
    """queries (ticker, name) with company and how it was found: listing, then root, then name; null if none is unambiguous."""
    listed = _unique(registry["tickers"], "ticker").withColumnRenamed("company", "c1")
    roots = _unique(registry["roots"], "root").withColumnRenamed("company", "c2")
    rows = queries.withColumn("root", F.substring("ticker", 1, root_len)).join(listed, "ticker", "left").join(roots, "root", "left")
    open_ = rows.filter("c1 IS NULL AND c2 IS NULL").select("ticker", "name")
    named = by_name(open_, registry["names"]).withColumnRenamed("company", "c3")
    source = F.when(F.col("c1").isNotNull(), "listing").when(F.col("c2").isNotNull(), "root").when(F.col("c3").isNotNull(), "name")
    return rows.join(named, "ticker", "left").select(*queries.columns, F.coalesce("c1", "c2", "c3").alias("company"), source.alias("source"))


def first_seen(names: DataFrame) -> DataFrame:
    """ticker, name and year of the first year in which a ticker is seen, from (ticker, name, year)."""
    return names.groupBy("ticker").agg(F.min_by("name", F.struct("year", "name")).alias("name"), F.min("year").alias("year"))


def ticker_map(names: DataFrame, registry: dict[str, DataFrame], prices: DataFrame, tolerance_days: int = 180) -> DataFrame:
    """Every ticker of names with a price: company, source and validity; unresolved ones have no company and a reason."""
    resolved = resolve(first_seen(names), registry)
    reason = F.when(F.col("company").isNull(), "unresolved")
    return resolved.join(validity(prices, tolerance_days), "ticker").withColumn("reason", reason)


def company_as_of(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """asked (ticker, decision_date, ...) with company: that of the interval that holds the date, both ends included, a null
    end open; of several the latest start counts."""
    keys = ["ticker", "decision_date"]
    i = intervals.filter("company IS NOT NULL").select("ticker", F.col("company").alias("_c"), "valid_from", "valid_to")
    held = asked.select(*keys).distinct().join(i, "ticker").filter((F.col("valid_from") <= F.col("decision_date")) & (F.col("decision_date") <= F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))))
    best = held.groupBy(*keys).agg(F.max_by("_c", F.struct("valid_from", "_c")).alias("company"))
    return asked.join(best, keys, "left")


def full_universe(
    prices: DataFrame, decisions: DataFrame, intervals: DataFrame, recovery: DataFrame, sectors: DataFrame, least_volume: float, least_sessions: int = 252, **how
) -> DataFrame:
    """Candidates of every decision date with company, sector and the first gate that fails: liquidity, one class per root,
    identity, recovery, history. reason is null for the eligible, whose sector may be null."""
    rows = universe(prices, decisions, least_volume, least_sessions=0, **how)
    rows = company_as_of(rows, intervals)
    rows = rows.join(F.broadcast(recovery.select("company", F.lit(True).alias("_bad")).distinct()), "company", "left")
    rows = rows.join(sectors.select("company", "sector").dropDuplicates(["company"]), "company", "left")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("company").isNull(), "unresolved_identity").when(F.col("_bad"), "judicial_recovery")
        .when(F.col("history") < least_sessions, "short_history")
    )
    return rows.select("decision_date", "ticker", "company", "sector", "median_volume", "history", reason.alias("reason"))


def universe_faults(accepted: DataFrame, excluded: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows (decision_date, ticker, fault) that break the rule that every candidate is accepted or excluded, once."""
    key = ["decision_date", "ticker"]
    both = accepted.select(*key).withColumn("a", F.lit(1)).unionByName(excluded.select(*key).withColumn("a", F.lit(1)))
    n = both.groupBy(*key).agg(F.sum("a").alias("n")).join(candidates.select(*key).distinct().withColumn("c", F.lit(True)), key, "full")
    fault = F.when(F.col("c").isNull(), "no candidate").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice")
    return n.select(*key, fault.alias("fault")).filter("fault IS NOT NULL")
