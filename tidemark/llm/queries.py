"""The contract queries of the operators: thin digests over whole tables, and SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, byte_codec, collocations, exact_dedup, importance, langid, license_scan, mixing, pii, piece_codec, quality, token_tree, warc
from .common import shared_dir, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document. Odd rows count as in license_scan.license_digest: a null text has no label."""
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and back. A null text has the begin and end ids only, as in piece_codec.encode_documents."""
    import public_tokenizers

    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back. A null page is a record without payload; a gap in the archives is an error."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.whole(warc.read_warc(spark, path))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document. A null text has no span, as in pii.pii_digest."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. A document without a word has size and taken 0, as in mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "_m.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents. Null counts as empty; null ids lose, as in exact_dedup.exact_groups."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every document. A text without a word fails the base rule, as in quality.quality."""
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "_q.*")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits: a heading from its source, a word in its middle, its language at its end."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").withColumn("edits", three_edits())
    return token_tree.count_with_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def three_edits() -> Column:
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.coalesce(F.col("source"), F.lit("none")), F.lit(":\n"))
    mid = F.expr("length(coalesce(text, '')) div 2") + F.length(head)
    edit = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), new.alias("new"))
    last = size + F.length(head) + 1000
    return F.array(edit(F.lit(0), F.lit(0), head), edit(mid, mid + 10, F.lit(" edited ")), edit(last, last, F.concat(F.lit("\n"), F.coalesce(F.col("lang"), F.lit("und")))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. A text that is null or has no letter is und, as in langid.identify."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs), keep=["doc_id"])


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies. Null counts as empty; equal texts are one class, as in bagminhash.near_duplicates."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document, and back. A null text has none, as in byte_codec.encode_decode."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return byte_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of every document. A null text has weight 0; short ones aren't drawn, as in importance.importance."""
    return importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language. A null text has no word, a null language is und, as in collocations.collocations."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run(); each stage says what becomes of odd rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_license_scan, op2_piece_codec, op3_warc, op4_pii, op5_mixing, op6_exact_dedup, op7_quality, op8_token_counts, op9_language_id,
        op10_near_duplicates, op11_byte_codec, op12_importance, op13_collocations, pipeline,
    ]
    return {f.__name__: f for f in named}


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = rf"regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB has no CRC-32: a table of 256 steps, then a fold over the bytes of every distinct word.
_IMPORTANCE = f"""
    WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
    w AS (SELECT true AS raw, doc_id, unnest({_WORDS}) AS word FROM documents UNION ALL SELECT false, NULL, unnest({_WORDS}) FROM benchmark),
    h AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
    b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
    c AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM w JOIN b USING (word) GROUP BY 1),
    g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
    d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE raw GROUP BY 1),
    x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
    y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
    SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)"""

_COLLOCATIONS = rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_NORM}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x != '') AS w FROM p),
    f AS (SELECT lang, g, count(*) AS a FROM (SELECT lang, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS g FROM w) GROUP BY ALL),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
    c AS (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND a >= 10),
    s AS (SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
    b AS (SELECT lang, g, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM s GROUP BY ALL),
    i AS (SELECT lang, q, max(a) AS longer FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS q, a FROM b WHERE len(g) = 3) GROUP BY ALL),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.q = b.g WHERE longer IS NULL OR 100 * longer < 50 * a)
    SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexed: str) -> str:
    """Base32 of 20 bytes in hex, in DuckDB: 5 hex digits are 4 symbols."""
    part = lambda g: f"('0x' || substr({hexed}, {5 * g + 1}, 5))::INT"
    return " || ".join(f"substr('{_B32}', (({part(g)} >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
            d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, first FROM p JOIN g USING (html))
            SELECT page_id, payload_bytes, {_base32("h")} AS payload_digest,
                CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to
            FROM d""",
        "op6_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
            g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
            FROM d JOIN g USING (norm)""",
        "op12_importance": _IMPORTANCE,
        "op13_collocations": _COLLOCATIONS,
    }
