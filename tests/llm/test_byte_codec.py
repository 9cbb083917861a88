"""Byte-level BPE against the tiktoken library, whole documents and odd ones."""

import base64
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex

from tidemark.llm import byte_codec, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(text, library):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_query_is_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = queries.op11_byte_codec(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(texts[r.doc_id], library) for r in rows)


def test_every_character_splits_and_merges_alike(library):
    """Every third of the code points here; all were tried once."""
    ranks, split = byte_codec.Ranks.of(PATH), regex.compile(PATTERN).findall
    chars = [chr(c) for c in range(0, 0x110000, 3) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 5000):
        text = "".join(f"a{c}b {c}{c}1{c} " for c in chars[k : k + 5000])
        assert [i for w in ranks.encode([p.encode() for p in split(text)]) for i in w] == library.encode_ordinary(text)


@pytest.mark.parametrize("n", [1, 2, 47, 48, 49, 50, 700, 20_000])
def test_long_words(library, n):
    rng = random.Random(n)
    for word in ("a" * n, "".join(rng.choice("abcdethé") for _ in range(n))):
        assert byte_codec.Ranks.of(PATH).encode([word.encode()]) == [library.encode_ordinary(word)]


@pytest.mark.parametrize("block", [1, 20, 1 << 18])
def test_odd_rows_in_blocks_of_any_size(spark, odd, none, library, monkeypatch, block):
    monkeypatch.setattr(byte_codec, "BLOCK_WORDS", block)
    monkeypatch.setattr(byte_codec, "_LISTED", 3)
    rows = byte_codec.encode_decode(odd, PATH, PATTERN, with_bytes=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(r.text, library)
        assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert rows[0].asDict().keys() >= {"r", "Key", "_r"} and "N_TOKENS" not in rows[0].asDict()
    assert byte_codec.encode_decode(none, PATH, PATTERN).collect() == []


def test_decoding(spark):
    rows = spark.createDataFrame([(1, [0, 5, 50255]), (2, []), (3, None)], "id long, token_ids array<int>")
    ranks = byte_codec.Ranks.of(PATH)
    known = {i: t for t, i in ranks.ids.items()}
    got = {r.id: r.decoded for r in byte_codec.decoded(rows, PATH).collect()}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {1: known[0] + known[5] + known[50255], 2: b"", 3: None}
    for bad in ([60_000], [-1], [None]):
        with pytest.raises(Exception, match="no token"):
            byte_codec.decoded(spark.createDataFrame([(bad,)], "token_ids array<int>"), PATH).collect()


def test_documents_stay_where_they_are(spark):
    """The grouping by block reads its buckets: only words and their ids are shuffled."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = byte_codec.encode_decode(docs.withColumn("text", F.upper("text")), PATH, PATTERN, keep=["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Exchange hashpartitioning(word" in plan
