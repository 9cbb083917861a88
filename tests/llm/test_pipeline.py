"""The pipeline against brute force, stage by stage."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

import corpus_pipeline
from tidemark.llm import bagminhash, quality
from tidemark.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute_kept(docs, good):
    """Ids that the quality rules keep: base rules, and the mean log ratio of all 4-byte n-grams, by the threshold that ten
    folds of the good documents give."""
    import numpy as np
    import xxhash

    n = quality.BUCKETS
    grams = {}
    for i, t in docs.items():
        d = t.encode()
        grams[i] = [((xxhash.xxh64_intdigest(d[k : k + 4], seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)) % n for k in range(len(d) - 3)]
    raw, seed = Counter(), xxhash.xxh64_intdigest(b"fold", seed=42)
    for g in grams.values():
        raw.update(g)
    fold = {i: ((xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=seed) + (1 << 63)) % (1 << 64) - (1 << 63)) % quality.FOLDS for i in good & docs.keys()}

    def ratios(ids):
        target = Counter()
        for i in ids:
            target.update(grams[i])
        return [math.log((target[b] + 1) / (sum(target.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n)) for b in range(n)]

    mean = lambda ratio, i: sum(ratio[b] for b in grams[i]) / len(grams[i])
    passed = {i for i, t in docs.items() if base_passes(t)}
    scores = []
    for k in range(quality.FOLDS):
        others = ratios(i for i in fold if fold[i] != k)
        scores += [mean(others, i) for i in fold if fold[i] == k and i in passed]
    low = np.quantile(scores, quality.LOW)
    ratio = ratios(fold)
    return {i for i in passed if mean(ratio, i) >= low - quality.MARGIN}


def base_passes(t):
    ws = t.split()
    tri = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    c = Counter(tri)
    twice = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
    return len(ws) >= 50 and 2 * len(twice) <= len(ws)


def brute_near(docs):
    words = bagminhash._Words()
    bags = {i: Counter(bagminhash.shingles(t, words).tolist()) for i, t in docs.items()}
    boss = {i: i for i in docs}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bags[a].keys() & bags[b].keys() and bagminhash.weighted_jaccard(bags[a], bags[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                boss[y] = x
    return {top(i) for i in docs}


def test_every_stage_is_its_brute_force(spark):
    import sentencepiece

    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    text = {i: r.text or "" for i, r in rows.items()}
    kept = brute_kept(text, {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()})
    last = {}
    for i in sorted(kept):
        last[lower(text[i])] = i
    exact = set(last.values())
    near = brute_near({i: text[i] for i in exact})
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, exact, near)):
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        got = docs.collect()
        assert docs.columns == columns and sorted(r.doc_id for r in got) == sorted(want) and all(r == rows[r.doc_id] for r in got), name
    mixed = corpus_pipeline.written(corpus_pipeline.mixing_stage(spark, docs, SF), "test")
    copies = Counter(r.doc_id for r in mixed.collect())
    size = {i: len(text[i].split()) for i in near}
    of_source, taken = Counter(), Counter()
    for i in near:
        of_source[rows[i].source] += size[i]
        taken[rows[i].source] += size[i] * copies[i]
    names, goal = sorted(of_source), {}
    left = set(names)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while True:
        rest = sum(of_source.values()) - sum(goal.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * of_source[s]}
        if not over:
            break
        goal |= {s: 3 * of_source[s] for s in over}
        left -= over
    goal |= share
    assert set(copies) <= near and max(copies.values()) <= 3
    assert all(abs(taken[s] - goal[s]) <= 16 + max(size[i] for i in near if rows[i].source == s) for s in names)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == copies
    for r in out:
        ids = sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert (r.source, r.n_tokens) == (rows[r.doc_id].source, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_good_documents_pass_the_quality_stage(spark):
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    long = {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 50}
    assert good & long <= kept


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_take_odd_rows_and_empty_tables(spark, odd, none, rows):
    docs = odd if rows else none
    long = random.Random(3)
    more = [(20 + k, " ".join(long.choice("abcdefgh") * 3 + str(long.randint(0, 999)) for _ in range(80)), None, None) for k in range(3)] if rows else []
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert rows or not docs.collect()
    assert corpus_pipeline.encoding_stage(spark, docs, SF).count() == docs.count()
