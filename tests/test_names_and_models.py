"""Names by full decomposition, containment by rarest tokens, permutations, and models on held-out rows."""

import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import identity, models
from tidemark.plans import market, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_names_are_decomposed_like_nfkd_for_every_character(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    names = ["x".join(["", *chars[k : k + 500], "y"]) for k in range(0, len(chars), 500)]
    plain = lambda s: re.sub(r" +", " ", re.sub(r"[^A-Z0-9 ]", " ", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().upper())).strip()
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.plain_name(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [plain(r.n) for r in got]
    odd = spark.createDataFrame([("Ősi Şirket ﬁm Āb ①",), ("Łódź ½",), (None,)], "n string").select(text.plain_name(F.col("n")))
    assert [r[0] for r in odd.collect()] == ["OSI SIRKET FIM AB 1", "ODZ 12", None]


def test_a_word_in_all_names_probes_nothing(spark):
    """Names are looked up by their rarest token, so one that all share adds no row; a name of it alone meets all."""
    names = spark.range(300).select(F.concat(F.lit("c"), "id").alias("company"), F.concat(F.lit("COMUM PALAVRA"), F.lpad("id", 5, "0")).alias("name"))
    asked = spark.createDataFrame([("A", "Comum Palavra00007"), ("B", "COMUM"), ("C", "COMUM AUSENTE"), ("D", "palavra00009 comum"), ("E", "S A"), ("F", None)], "ticker string, name string")
    assert sorted(map(tuple, identity.by_name(asked, names).collect())) == [("A", "c7"), ("D", "c9")]
    one = names.filter("company = 'c3'")
    assert sorted(map(tuple, identity.by_name(asked, one).collect())) == [("B", "c3")]


def test_permutations_are_bijections(spark):
    rows = spark.createDataFrame([(n, s) for n in (1, 2, 3, 4, 5, 8, 9, 10, 99, 100, 101, 1000) for s in (1, 2, 3)], "n long, seed long")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("p", models.permuted(F.col("i"), F.col("n"), F.col("seed")))
    held: dict = {}
    for r in rows.collect():
        held.setdefault((r.n, r.seed), {})[r.i] = r.p
    assert all(sorted(p.values()) == list(range(n)) for (n, _), p in held.items())
    big = [held[1000, s] for s in (1, 2, 3)]
    assert all(sum(p[i] == i for i in p) < 10 and sum(abs(p[i + 1] - p[i]) == 1 for i in range(999)) < 15 for p in big)
    assert sum(big[0][i] == big[1][i] for i in range(1000)) < 10


def test_model_query_on_held_out_rows(spark):
    """Calibrated probabilities of later rows: within bounds, and no worse than always saying the label rate of earlier rows."""
    rows = registry.queries()["m1_model_scores"](spark, SF).collect()
    assert len(rows) > 300 and all(0 <= r.score <= 1 and 0 <= r.probability <= 1 for r in rows) and len({r.score for r in rows}) > 20
    rate = sum(r.label for r in rows) / len(rows)
    brier = sum((r.probability - r.label) ** 2 for r in rows) / len(rows)
    assert brier <= rate * (1 - rate) + 1e-9  # the calibrator has seen these rows' labels, in the order of their scores only
    by_score = sorted(rows, key=lambda r: r.score)
    assert all(a.probability <= b.probability + 1e-12 for a, b in zip(by_score, by_score[1:]))
    assert len(market.MODEL_FEATURES) == 21


def test_importance_names_every_feature(spark):
    rows = registry.queries()["m5_importance"](spark, SF).collect()
    assert {r.feature for r in rows} == set(market.MODEL_FEATURES) and abs(sum(r.share for r in rows) - 1) < 1e-9
    assert all(r.impact >= 0 and -1 <= r.direction <= 1 for r in rows) and max(r.impact for r in rows) > 0
