"""Collocations against brute force and SQL; transducers by themselves; odd rows, hot words, shards and ranges of any size."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import collocations, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
T = collocations.Transducer


def brute(rows, least=10, share=50, first=2000):
    out, by = [], {}
    for text, lang in rows:
        by.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, texts in by.items():
        f, n = Counter(), 0
        for t in texts:
            for p in re.split(r"[.,;:!?\x0A-\x0D]", t.translate({c: c + 32 for c in range(65, 91)})):
                w = re.findall(r"[^\x20\x09]+", p)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * f[q]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, x[2], x[1], x[3], x[4], n, x[0]) for i, x in enumerate(best[:first])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_is_brute_force_and_sql(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows = got(queries.op13_collocations(spark, SF))
    assert len(rows) > 100 and rows == brute([(d["text"], d["lang"]) for d in docs])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows == sorted(con.execute(queries.oracle_sql()["op13_collocations"]).fetchall())


@pytest.mark.parametrize("words,places,size,least,share,first", [(50, 1 << 22, 100, 10, 50, 2000), (1 << 18, 300, 1 << 18, 2, 10, 40), (1000, 5000, 7, 1, 100, 2000)])
def test_shards_and_ranges_of_any_size(spark, monkeypatch, words, places, size, least, share, first):
    """Small ranges make the pairs of common words hot: those are cut by third words."""
    rng = random.Random(5)
    vocabulary = ["of", "the", "of", "the", "of", "the", "A", "é", "日本", "\x01", "x\x0by", "a\x01", "z" * 300, *map(str, range(20))]
    texts = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "  "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(150)]
    monkeypatch.setattr(collocations, "SHARD_WORDS", words)
    monkeypatch.setattr(collocations, "SHARD_PLACES", places)
    monkeypatch.setattr(collocations, "RANGE", size)
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    assert got(collocations.collocations(docs, least=least, share=share, first=first)) == brute(texts, least, share, first)


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert got(collocations.collocations(odd)) == brute(rows)
    assert got(collocations.collocations(odd, least=1)) == brute(rows, 1)
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(odd.filter("doc_id < 4")).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(odd, least=0)


def made(counts):
    """A transducer of a Counter of two- and three-word tuples whose triples' pairs are there."""
    pairs, triples = sorted(p for p in counts if len(p) == 2), sorted(p for p in counts if len(p) == 3)
    column = lambda ps, k: np.array([p[k] for p in ps], np.int64)
    at = np.array([pairs.index(p[:2]) for p in triples], np.int64)
    number = lambda ps: np.array([counts[p] for p in ps], np.int64)
    return T.build(column(pairs, 0), column(pairs, 1), number(pairs), at, column(triples, 2), number(triples))


def counted(t):
    a, b, c = (x.tolist() for x in t.pairs())
    out = {(x, y): n for x, y, n in zip(a, b, c) if n}
    at, d, e = (x.tolist() for x in t.triples())
    return Counter(out | {(a[k], b[k], w): n for k, w, n in zip(at, d, e)})


def test_transducers(monkeypatch):
    rng = random.Random(1)
    word = lambda: rng.randrange(9) << rng.randrange(40)
    total, parts = Counter(), []
    for _ in range(6):
        c = Counter()
        for _ in range(300):
            a, b, d = word(), word(), word()
            c[a, b] += 1
            c[a, b, d] += 1
        parts.append(made(c))
        assert counted(parts[-1]) == c == counted(T.load(parts[-1].dump())) and len(parts[-1]) == len(c)
        total += c
    assert counted(T.union(parts)) == total == counted(T.union([T.union(parts[:2]), T.union(parts[2:])]))
    assert counted(T.union(parts, 4)) == Counter({p: n for p, n in total.items() if n >= 4})
    cut = T.union(parts).split(3)
    assert counted(T.union(cut)) == total and sum(len(counted(x)) for x in cut) == len(total)
    pairs = [p for p in total if len(p) == 2] + [(1, 3), (2**50, 1), (0, 2**50)]
    assert T.union(parts).compose(*(np.array(x) for x in zip(*pairs))).tolist() == [total[p] for p in pairs]


def test_states_with_equal_arcs_are_one():
    c = Counter({(a, b): 1 for a in range(20) for b in range(20)}) + Counter({(a, b, 5): 1 for a in range(20) for b in range(20)})
    assert len(made(c).size) == 1 and counted(made(c)) == c
