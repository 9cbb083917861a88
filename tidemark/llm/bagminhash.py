"""Near-duplicate detection with BagMinHash signatures over multisets of word shingles.

A document is the multiset of its five-word shingles. Every (shingle, level) is a Poisson process: weights are
discretised at the integers and gathered in dyadic rings (0, 1], (1, 2], (2, 4], (4, 8], ...; a ring's process has the
ring's width as its rate, and a point carries a time, a component of the signature and a level, all hashed from shingle,
ring and point number. A document sees the points whose level is at most the shingle's count, and a component holds
the earliest point it sees. Equal components have a probability of the weighted Jaccard similarity. Points later than
the latest component can't matter, so most shingles cost one hash: a first arrival beyond the horizon.

Signatures are cut into bands. Buckets are searched from leaders (the members that meet most others) instead of by all
pairs; texts of buckets that then still hold several classes go through an exact prefix join, so no link between
different texts that share a bucket is lost. Every link is verified on the whole texts. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, hot_and_rest, hot_join, hot_keys, row_of, unpacked, written

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8, 28 bands of 4 miss a pair with a probability of 3e-7.
BANDS, ROWS = 28, 4

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class _Words(dict):
    """Hash of every word met so far; starts anew when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        h = _word_hash(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included: windows of lower-cased words between white space.

    A text of fewer words than a window is one shingle of all its words; a text without words has none.
    """
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    size = min(size, len(h))
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for k in range(1, size):
            s = s * _M1 + h[k : k + n]
    return _mix(s)


def _ring(keys: np.ndarray, counts: np.ndarray, ring: int, horizon: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and components of the points of one ring that the counts reach, up to the horizon."""
    low, rate = (0, 1) if ring == 0 else (1 << (ring - 1), 1 << (ring - 1))
    with np.errstate(over="ignore"):
        base = _mix(keys + np.uint64(ring + 1) * _GOLD)
    at, number = np.zeros(len(base)), 0
    times, slots = [], []
    while len(base):
        mean = max(0.0, (horizon - float(at.min())) * rate)
        block = 1 if mean < 0.5 else int(mean + 3 * mean**0.5) + 2
        steps = np.arange(number, number + block, dtype=np.uint64)
        with np.errstate(over="ignore"):
            draws = _mix(base[:, None] + (steps[None, :] + np.uint64(1)) * _M2)
        gaps = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        # Summed from the last point on, one by one: a point's time doesn't depend on how many are drawn at once.
        t = np.cumsum(np.concatenate([at[:, None], gaps], axis=1), axis=1)[:, 1:]
        row, col = np.nonzero(t <= horizon)
        if len(row):
            with np.errstate(over="ignore"):
                marks = _mix(draws[row, col] ^ _GOLD)
            level = low + 1 + (marks >> np.uint64(40)).astype(np.int64) % rate
            seen = level <= counts[row]
            times.append(t[row, col][seen])
            slots.append((marks[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m)
        more = t[:, -1] <= horizon
        base, at, counts, number = base[more], t[more, -1], counts[more], number + block
    if not times:
        return np.empty(0), np.empty(0, np.int64)
    return np.concatenate(times), np.concatenate(slots)


def signature(hashes: np.ndarray, m: int) -> np.ndarray:
    """m components as unsigned 64-bit integers; all 0 for a document without shingles."""
    if not len(hashes):
        return np.full(m, _EMPTY)
    keys, counts = np.unique(hashes, return_counts=True)
    horizon = m * (np.log(m) + 5) / len(hashes)
    while True:
        best = np.full(m, np.inf)
        for ring in range(int(counts.max() - 1).bit_length() + 1):
            reach = counts > ((1 << (ring - 1)) if ring else 0)
            t, slot = _ring(keys[reach], counts[reach], ring, horizon, m)
            np.minimum.at(best, slot, t)
        if np.isfinite(best).all():
            return _mix(best.view(np.uint64))
        horizon *= 2


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Sum of minima over sum of maxima; two documents without shingles are equal."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 1.0


def _node(text: Column) -> Column:
    """A text's node: 128 bits of its SHA-256. Rows with the same text share it; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    """UTF-8 texts under zstd: texts move between executors several times, and prose packs far better so than under lz4."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    return texts.map(pack, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def _unpacked(packs: pd.Series) -> pd.Series:
    import zstandard

    return packs.map(zstandard.ZstdDecompressor().decompress, na_action="ignore")


def signed(docs: DataFrame, text_col: str, bands: int, rows: int) -> DataFrame:
    """One row per distinct text with a shingle: node, key (a number that stands for the node), buckets, n (rows with it).

    Copies meet by node alone, before any signature moves; the keys are fixed by writing them.
    """
    m = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        tag = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for batch in batches:
            nodes, out = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingles(text.as_py(), words)
                if not len(h):
                    continue
                s = signature(h, m).reshape(bands, rows)
                with np.errstate(over="ignore"):
                    key = tag.copy()
                    for k in range(rows):
                        key = _mix(key * _M2 + s[:, k])
                nodes.append(node)
                out.append(key.view(np.int64))
            if nodes:
                flat = pa.array(np.concatenate(out))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), lists], names=["node", "buckets"])

    texts = docs.select(_node(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = texts.mapInArrow(sign, "node binary, buckets array<bigint>").groupBy("node").agg(F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("n"))
    return written(made.withColumn("key", F.monotonically_increasing_id()), "signed")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) of keys whose weighted Jaccard similarity reaches the bound.

    Hot leaders, fewer than 1000, are salted: such a leader's text is copied to as many salts as its pairs fill parts of
    HOT of all pairs, fewer than 2000 copies in all.
    """
    total = pairs.count()
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT * total)
    hot = written(hot.select("a", F.ceil(F.col("n") / max(1.0, HOT * total)).cast("int").alias("salts")), "hot")

    @F.pandas_udf("double")
    def overlap(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import zstandard

        words, last, bag, plain = _Words(), None, Counter(), zstandard.ZstdDecompressor().decompress
        for left, right in parts:
            out = []
            for x, y in zip(left, right):
                if x != last:
                    last, bag = x, Counter(shingles(plain(x).decode(), words).tolist())
                out.append(weighted_jaccard(bag, Counter(shingles(plain(y).decode(), words).tolist())))
            yield pd.Series(out, dtype="float64")

    salted = pairs.join(F.broadcast(hot), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    lead = texts.select(F.col("key").alias("a"), F.col("pack").alias("left")).join(F.broadcast(hot), "a", "left")
    lead = lead.select("a", "left", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = salted.join(texts.select(F.col("key").alias("b"), F.col("pack").alias("right")), "b").join(lead, ["a", "salt"])
    return both.select("a", "b", overlap("left", "right").alias("similarity")).filter(F.col("similarity") >= similarity)


def prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different comp among texts (key, pack, comp) that can reach the similarity t.

    The k-th repeat of a shingle counts as an element of its own, so multisets become sets. With elements in a common
    order, rarest first, two sets of sizes m <= n that reach t share ceil(t / (1 + t) * (m + n)) elements; the first
    they share then stands so early in both that as many still follow. Edits make rare elements, so a family of copies
    that are far from each other has no element in common at places that early, and its pairs never arise.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        words, plain = _Words(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sets = []
            for pack in batch.column(2):
                keys, counts = np.unique(shingles(plain(pack.as_py()).decode(), words), return_counts=True)
                many = np.repeat(keys, counts)
                nth = np.arange(len(many)) - np.repeat(np.cumsum(counts) - counts, counts)
                with np.errstate(over="ignore"):
                    sets.append(_mix(many + nth.astype(np.uint64) * _GOLD).view(np.int64))
            for k in range(0, len(sets), 50):
                part = sets[k : k + 50]
                at = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k : k + 50], batch.column(1)[k : k + 50], pa.ListArray.from_arrays(at, np.concatenate(part))], names=["key", "comp", "e"]
                )

    sets = written(texts.select("key", "comp", "pack").mapInArrow(elements, "key bigint, comp bigint, e array<bigint>"), "elements")
    loose = sets.select("key", F.explode("e").alias("e"))
    common = loose.groupBy("e").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # An element of one text only comes first and matches nothing: its number is all that is needed of such elements.
    shared = loose.join(common, "e").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    sized = sets.select("key", "comp", F.size("e").alias("n")).join(shared, "key").withColumn("own", F.col("n") - F.size("s"))
    ahead = F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(similarity) * F.col("n")).cast("int") + 1 - F.col("own"))
    early = sized.select("key", "comp", "n", "own", F.posexplode(F.slice("s", F.lit(1), ahead))).select(
        "key", "comp", "n", F.col("col.e").alias("e"), (F.col("n") - F.col("own") - F.col("pos")).alias("left")
    )
    x, y = early.alias("x"), early.alias("y")
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    return (
        x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.comp") < F.col("y.comp")) & (F.least("x.left", "y.left") >= need))
        .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for every node with a link; labels spread and jump until stable."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    degrees = written(both.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("a").alias("least")), "degrees")
    ends = both.count()
    nodes = degrees.count()
    labels = degrees.select("node", "degree", F.least("node", "least").alias("comp"))
    while True:
        near = hot_join(both.withColumnRenamed("b", "node"), labels, "node", "degree", ends).groupBy("a").agg(F.min("comp").alias("best"))
        hop = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "degree", "comp", F.least("comp", F.coalesce("best", "comp")).alias("to"))
        hop = written(hop, "hops")
        named = hop.groupBy("to").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("node").alias("to"), F.col("comp").alias("far")), "to")
        step = written(hot_join(hop, written(named, "named"), "to", "n", nodes).select("node", "degree", "comp", F.least("to", "far").alias("new")), "labels")
        labels = step.select("node", "degree", F.col("new").alias("comp"))
        if not step.filter("new != comp").limit(1).count():
            return labels.select("node", "comp")


def near_classes(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(classes, links): node and comp of every text that is linked to a different text; links (a, b, similarity).

    Inside, nodes go by their keys, which are half as long and pack better; texts move packed. Members of hot buckets
    stay where they are: what is known of such a bucket is broadcast to them.
    """
    signs = signed(docs, text_col, bands, rows)
    names = signs.select("key", "node")
    single = signs.select("key", F.explode("buckets").alias("bucket"))
    sizes = written(single.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    members = written(hot_join(single, sizes, "bucket", "n", signs.count() * bands), "members")
    total = members.count()
    met = written(members.groupBy("key").agg(F.sum("n").alias("met")), "met")
    texts = docs.select(_node(F.col(text_col)).alias("node"), _packed(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("pack"))
    wanted = written(signs.select("key", "node").join(met.select("key"), "key"), "wanted")
    hot, rest = hot_and_rest(texts, wanted, "node", hot_keys(signs, "node", "n", signs.agg(F.sum("n")).first()[0] or 0))
    one = lambda df: df.groupBy("key").agg(F.first("pack").alias("pack"))
    texts = written(one(hot).unionByName(rest.dropDuplicates(["node"]).select("key", "pack")), "texts")
    leaders = members.join(met, "key").groupBy("bucket").agg(F.max_by("key", F.struct("met", "key")).alias("a"), F.count(F.lit(1)).alias("size"))
    pairs = hot_join(members, written(leaders, "leaders"), "bucket", "size", total).filter("key != a")
    pairs = written(pairs.select("a", F.col("key").alias("b")).distinct(), "pairs")
    links = written(_verified(pairs, texts, similarity), "links")
    comps = components(links)
    # Buckets that still hold several classes: their texts are joined exactly, by prefixes, across classes alone.
    held = members.select("bucket", "key").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    mixed = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket")
    some, others = hot_and_rest(held, written(mixed, "mixed"), "bucket", hot_keys(sizes, "bucket", "n", total))
    rest = some.unionByName(others).select("key", "comp").distinct()
    across = prefix_pairs(texts.join(rest, "key"), similarity)
    across = across.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(_verified(written(across, "across"), texts, similarity), "links")
    every = links.unionByName(more)
    if more.limit(1).count():
        comps = components(every)
    named = lambda df, c: df.withColumnRenamed(c, "key").join(names, "key").drop("key").withColumnRenamed("node", c)
    owned = comps.withColumnRenamed("node", "key").join(names, "key").drop("key")
    return named(owned.withColumnRenamed("node", "own"), "comp").withColumnRenamed("own", "node"), named(named(every, "a"), "b")


def _leads(ids: DataFrame, comps: DataFrame) -> DataFrame:
    """One row per node of ids (id, node, row): n rows, and of its class the leader's id, node and row, and its size."""
    nodes = ids.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("first"))
    owned = written(nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "owned")
    lead = F.min(F.struct("first.no", "first.id", "node", "first.row")).alias("lead")
    classes = owned.groupBy("comp").agg(lead, F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("nodes"))
    joined = hot_join(owned.select("node", "n", "comp"), written(classes, "classes"), "comp", "nodes", owned.count())
    return joined.select("node", "n", "class_size", F.col("lead.id").alias("class_id"), F.col("lead.node").alias("lead"), F.col("lead.row").alias("winner"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: id_col, class_id, class_size, kept.

    class_id is the smallest id in the class and class_size counts its rows; the row with id class_id stays, exactly one
    if several have it. Equal texts (null counts as empty) are one node,
    whatever their number, and null ids never name a class unless it has no other. Texts without words form a class of
    equal texts each; texts under five words are near copies only of texts with the same words. Empty tables give no rows.
    Other columns play no part.
    """
    comps, _ = near_classes(docs, text_col, **how)
    ids = written(docs.select(F.col(id_col).alias("id"), _node(F.col(text_col)).alias("node"), F.monotonically_increasing_id().alias("row")), "ids")
    out = hot_join(ids, written(_leads(ids, comps), "leads"), "node", "n", ids.count())
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("row") == F.col("winner")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the one with the smallest id.

    Null and empty texts, null ids, repeated rows and empty tables count as in near_duplicates.
    """
    comps, _ = near_classes(docs, text_col, **how)
    ids = docs.select(F.col(id_col).alias("id"), _node(F.col(text_col)).alias("node"), F.lit(0).alias("row"))
    best = _leads(ids, comps).filter("node = lead").select("node", F.col("class_id").alias("id"))
    others = [c for c in docs.columns if c != text_col]
    whole = docs.select(row_of(others), _packed(F.col(text_col).cast("binary")).alias("text"), F.col(id_col).alias("i"), _node(F.col(text_col)).alias("n"))
    # Of rows that are equal in id and text, one stays: a rank that each task begins before anything moves.
    one = F.row_number().over(Window.partitionBy("n", "i").orderBy(F.lit(1)))
    kept = whole.join(best, (F.col("n") == F.col("node")) & F.col("i").eqNullSafe(F.col("id")), "left_semi").withColumn("k", one).filter("k = 1")
    place = dict(zip(others, unpacked(others)))
    return kept.select(*[place.get(c, _unpacked("text").cast("string").alias(c)) for c in docs.columns])
