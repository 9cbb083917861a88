"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts fall apart into pre-tokens, which are words here. A task numbers the words of a block of documents and keeps every
document as the numbers of its words, in order of position; blocks are written, and so fixed. The blocks' words are then
shuffled by word and sorted, so that each distinct word of the corpus is encoded once, however often it stands anywhere; a
frequent word has a row per block, not one per place. Its ids go back to the blocks, where numbers are replaced by ids in
order of position. Decoding looks every id up in the table of token bytes, which is as small as the vocabulary.

Blocks are written in buckets, so the documents never move: only words do, to their encoder and back.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_ROWS, BATCH_ROWS, arrow_rows, passing, row_of, shared_dir, slices, unpacked

#: A block is closed when it holds so many distinct words or so many characters.
BLOCK_WORDS, BLOCK_CHARS = 1 << 19, 1 << 25
#: Words of a row of a block's list; places of a document that are turned into ids at one time; rows of words packed together.
_LISTED, _STRETCH, _PACKED = 4096, 1 << 16, 200_000
#: Longest word, in bytes, that is merged in an array with others of its length.
_LONGEST = 48
_NEVER = np.int64(1) << 40


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes: small numbers leave planes of zeros, which any codec packs."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def short_bytes(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in seven bits a byte, the lowest first; all bytes of a number but its last have the eighth bit."""
    many = np.ones(len(numbers), np.int64)
    for k in range(1, 5):
        many += numbers >= 1 << 7 * k
    at = np.repeat(np.cumsum(many) - many, many)
    nth = np.arange(len(at)) - at
    bits = (np.repeat(numbers, many) >> 7 * nth) & 127
    return (bits | np.where(nth + 1 < np.repeat(many, many), 128, 0)).astype(np.uint8).tobytes()


def from_short_bytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    nth = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * nth, starts)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts and have the given sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Ranks:
    """Tokens by rank: ids of byte strings, the bytes of ids, and which pairs of tokens make a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = sorted(self.ids.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        self.sizes = np.zeros(size, np.int64)
        for t, i in tokens:
            self.sizes[i] = len(t)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join([t for t, _ in tokens]), np.uint8)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        found = {}
        for t, i in tokens:
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = i
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int64)

    @staticmethod
    @lru_cache(maxsize=4)
    def of(path: str) -> Ranks:
        """The table of a file, read once by each Python worker."""
        return Ranks(path)

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, which is its rank too; _NEVER where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NEVER)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: a word that is a token is that token, others merge the pair of the lowest rank first, the
        leftmost of equal ones. Words of one length are the rows of an array, and each step merges a pair of every row."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            i = self.ids.get(w)
            if i is not None:
                out[k] = [i]
            elif not w:
                out[k] = []
            elif len(w) > _LONGEST:
                out[k] = self.merge(w)
            else:
                by_length.setdefault(len(w), []).append(k)
        for n, own in by_length.items():
            at = np.array(own)
            sym = self.single[np.frombuffer(b"".join([words[k] for k in own]), np.uint8).reshape(len(own), n)]
            rank = self._look(sym[:, :-1], sym[:, 1:])
            while len(at):
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(at), np.int64)
                least = rank[np.arange(len(at)), best] if rank.shape[1] else np.full(len(at), _NEVER)
                go = least < _NEVER
                for k, ids in zip(at[~go].tolist(), sym[~go].tolist()):
                    out[k] = ids
                at, sym, rank, best, least = at[go], sym[go], rank[go], best[go], least[go]
                if not len(at):
                    break
                rows, width = np.arange(len(at)), sym.shape[1]
                sym[rows, best] = least
                stay = np.ones(sym.shape, bool)
                stay[rows, best + 1] = False
                sym = sym[stay].reshape(len(at), width - 1)
                stay = np.ones(rank.shape, bool)
                stay[rows, best] = False
                rank = rank[stay].reshape(len(at), width - 2)
                for place, there in ((best - 1, best > 0), (best, best < width - 2)):
                    r, c = rows[there], place[there]
                    rank[r, c] = self._look(sym[r, c], sym[r, c + 1])
        return out

    def merge(self, word: bytes) -> list[int]:
        """One word by a heap of pairs; entries whose symbols have changed since are stale."""
        sym = [int(self.single[b]) for b in word]
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            made = self.pairs.get(sym[i] << 32 | sym[j])
            if made is not None:
                heapq.heappush(heap, (made, i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s in sym if s >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, from the table of token bytes."""
        ids = ids.astype(np.int64)
        return gathered(self.flat, self.starts[ids], self.sizes[ids]).tobytes()


class _Block(dict):
    """Numbers of the words met, from 0 on."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_CUT = [T.StructField(n, t) for n, t in (("block", T.LongType()), ("places", T.BinaryType()), ("first", T.LongType()), ("words", T.ArrayType(T.BinaryType())))]


def blocks(docs: DataFrame, text_col: str, pattern: str, keep: list[str]) -> DataFrame:
    """Rows of documents (block, r, places) and of words (block, first, words), written in buckets of blocks.

    A block has the documents that a task met one after the other, until it holds BLOCK_WORDS distinct words or BLOCK_CHARS
    characters: a longer text fills one by itself. Words are numbered from the most frequent one on, so most places take a
    byte or two. The number of the first word of a row of words is first.
    """
    held = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), row_of(keep))
    schema = T.StructType([*_CUT, T.StructField("r", held.schema["r"].dataType)])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        name, block, chars, texts = TaskContext.get().partitionId() << 32, _Block(), 0, []
        row_type = None

        def closed(rows: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            numbers = np.concatenate(texts) if texts else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(numbers, minlength=len(block)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ends, held = np.cumsum([len(x) for x in texts]).tolist(), pa.concat_arrays(rows)
            for k in range(0, len(texts), BATCH_ROWS):
                some = [short_bytes(place[numbers[b - len(x) : b]]) for x, b in zip(texts[k : k + BATCH_ROWS], ends[k : k + BATCH_ROWS])]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(some, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.binary())), held.slice(k, n)], names=names)
            words = list(block)
            for k in range(0, len(words), _LISTED):
                some = [words[i].encode() for i in order[k : k + _LISTED].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int64()), pa.array([some], pa.list_(pa.binary())), pa.nulls(1, row_type)], names=names)

        rows: list[pa.Array] = []
        for batch in (x for whole in batches for x in slices(whole)):
            row_type, begin = batch.column(1).type, 0
            for at, text in enumerate(batch.column(0).to_pylist(), 1):
                parts = split(text)
                texts.append(np.fromiter(map(block.__getitem__, parts), np.uint32, len(parts)))
                chars += len(text)
                if len(block) >= BLOCK_WORDS or chars >= BLOCK_CHARS or at == batch.num_rows:
                    rows.append(batch.column(1).slice(begin, at - begin))
                    begin = at
                if len(block) >= BLOCK_WORDS or chars >= BLOCK_CHARS:
                    yield from closed(rows)
                    name, block, chars, texts, rows = name + 1, _Block(), 0, [], []
        if texts:
            yield from closed(rows)

    return _in_buckets(held.mapInArrow(cut, schema), "blocks", "block")


def _in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As written(), in buckets of key: a later grouping by key reads its bucket instead of a shuffle."""
    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, arrow_rows(before))
    try:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", f"{shared_dir(spark)}/{unique}").option("compression", "zstd").saveAsTable(unique)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.table(unique)


def word_ids(words: DataFrame, ranks_path: str) -> DataFrame:
    """(block, packed): ids of the words of every block, from rows (word, block, no) of all blocks.

    Words are shuffled and sorted, so equal ones follow each other and are encoded once. What a task has encoded goes back
    in packs of one block each: numbers as differences, sizes and ids, under zstd.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ranks, pack = Ranks.of(ranks_path), zstandard.ZstdCompressor(level=3).compress
        last, ids = None, b""
        held: tuple[list, list, list, list] = ([], [], [], [])

        def packed() -> pa.RecordBatch:
            block, no, size = (np.concatenate(x).astype(np.int64) for x in held[:3])
            flat = np.concatenate(held[3])
            order = np.lexsort((no, block))
            flat = gathered(flat, (np.cumsum(size) - size)[order], size[order])
            block, no, size = block[order], no[order], size[order]
            cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            ends, at = np.append(cuts[1:], len(block)), np.append(0, np.cumsum(size))
            out = []
            for a, b in zip(cuts.tolist(), ends.tolist()):
                out.append(tuple(pack(planes(x)) for x in (np.diff(no[a:b], prepend=0), size[a:b], flat[at[a] : at[b]])))
            return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int64()), *[pa.array(x, pa.binary()) for x in zip(*out)]], names=["block", "no", "size", "ids"])

        for batch in batches:
            every = batch.column(0).to_pylist()
            if not every:
                continue
            fresh = [w for before, w in zip([last, *every], every) if w != before]
            codes = ranks.encode(fresh)
            table = [ids if last is not None else [], *codes]
            which = np.cumsum([w != before for before, w in zip([last, *every], every)])
            size = np.array([len(x) for x in table], np.int64)
            flat = np.array([i for x in table for i in x], np.int64)
            held[0].append(batch.column(1).to_numpy())
            held[1].append(batch.column(2).to_numpy())
            held[2].append(size[which])
            held[3].append(gathered(flat, (np.cumsum(size) - size)[which], size[which]))
            last, ids = every[-1], table[int(which[-1])]
            if sum(map(len, held[0])) >= _PACKED:
                yield packed()
                for x in held:
                    x.clear()
        if held[0]:
            yield packed()

    by_word = words.select("word", "block", "no").repartition("word").sortWithinPartitions("word")
    return by_word.mapInArrow(encode, "block bigint, no binary, size binary, ids binary")


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True, with_bytes: bool = False
) -> DataFrame:
    """docs (or its columns in keep) with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes that the ids stand for) and, as asked, token_ids and decoded.

    Every match of the pattern is encoded by itself, without special tokens; what the pattern doesn't match is left out. A null
    text counts as empty and has no ids. Repeated rows get equal results, an empty table gives none, and other columns pass
    through; of a clashing name, in whatever case, the new column replaces the old one. A task holds a block of documents at
    a time; of a text, ids and bytes are made in stretches.
    """
    keep = docs.columns if keep is None else keep
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.BinaryType())] * with_bytes
    keep = passing(keep, [f.name for f in new])
    cut = blocks(docs, text_col, pattern, keep)
    listed = cut.filter("words IS NOT NULL").select("block", "first", F.posexplode("words").alias("pos", "word"))
    codes = word_ids(listed.select("word", "block", (F.col("first") + F.col("pos")).alias("no")), ranks_path)
    schema = T.StructType([cut.schema["r"], *new])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        ranks, plain = Ranks.of(ranks_path), zstandard.ZstdDecompressor().decompress
        parts = [[from_planes(plain(x.as_py())).astype(np.int64) for x in right.column(c)] for c in ("no", "size", "ids")]
        no, size, flat = (np.concatenate(p) if p else np.empty(0, np.int64) for p in ([np.cumsum(x) for x in parts[0]], parts[1], parts[2]))
        starts, sizes = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
        starts[no], sizes[no] = np.cumsum(size) - size, size
        made: list[list] = [[] for _ in new]
        for cell in left.column("places"):
            places = from_short_bytes(cell.as_py())
            n, ids_hash, text_hash, every, texts = 0, hashlib.sha256(), hashlib.sha256(), [], []
            for k in range(0, len(places), _STRETCH):
                some = places[k : k + _STRETCH]
                ids = gathered(flat, starts[some], sizes[some])
                text = ranks.decode(ids)
                n += len(ids)
                ids_hash.update(ids.astype("<u4").tobytes())
                text_hash.update(text)
                if with_ids:
                    every.append(ids.astype(np.int32))
                if with_bytes:
                    texts.append(text)
            row = [n, ids_hash.hexdigest(), text_hash.hexdigest(), *[np.concatenate(every) if every else np.empty(0, np.int32)] * with_ids, *[b"".join(texts)] * with_bytes]
            for x, v in zip(made, row):
                x.append(v)
        types = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids, *[pa.binary()] * with_bytes]
        return pa.Table.from_arrays([left.column("r"), *[pa.chunked_array([pa.array(x, t)]) for x, t in zip(made, types)]], names=schema.names)

    texts = cut.filter("places IS NOT NULL").select("block", "places", "r")
    out = texts.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(assemble, schema)
    return out.select(*unpacked(keep), *[f.name for f in new])


def decoded(rows: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """rows with ``decoded``, the bytes of the ids in an array column: every id joins the table of token bytes, in order.

    A null array gives null, an empty one no bytes; a null or unknown id is an error. Other columns pass through; the new
    column replaces one of its name, in whatever case.
    """
    keep = passing(rows.columns, ["decoded"])
    held = rows.select(F.col(ids_col).cast("array<bigint>").alias("ids"), row_of(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.of(ranks_path)
        for batch in batches:
            out = []
            for cell in batch.column(0):
                if cell.is_valid:
                    ids = cell.values
                    if ids.null_count or len(ids) and not (0 <= min(found := ids.to_numpy()) and max(found) < len(ranks.sizes) and ranks.sizes[found].all()):
                        raise ValueError("an id has no token")
                    out.append(ranks.decode(ids.to_numpy(zero_copy_only=False)))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["r", "decoded"])

    return held.mapInArrow(run, T.StructType([held.schema["r"], T.StructField("decoded", T.BinaryType())])).select(*unpacked(keep), "decoded")
