"""Phrase collocations by weighted acyclic automata over words.

A shard is a bounded run of documents of one language. Its words are numbered, its documents kept as numbers. Words that
stand often enough get global numbers in order of language and bytes, and those go back to the shards that hold the words:
a phrase as frequent as asked has only such words. A shard's phrases, sorted, build a transducer from phrases to counts:
first words lead to second words, whose arcs carry counts and lead to states of third words with theirs; states with equal
arcs are one. It is cut into ranges of prefixes; the union of all shards' transducers of a range sums their weights, and
what stays under the least count is pruned. Candidates are the paths of the unions. The counts of their parts come from
composing the parts with the transducer of the part's own range.

Ranges are equal shares of the words, first words in proportion to their counts and within one by second words, so that a
frequent first word has many ranges. A range that still holds too many phrases, as that of a very common pair, is cut once
more by third words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_codec import gathered
from .common import slices, written

LEAST, SHARE, FIRST = 10, 50, 2000
#: A shard is closed at so many distinct words or places; a task holds as many places of all languages together.
SHARD_WORDS, SHARD_PLACES = 1 << 18, 1 << 22
#: Places that a range stands for on the mean; phrases beyond four times as many make it hot.
RANGE = 1 << 18
_LISTED = 4096

#: What ends a piece is a line feed, what ends a word a space; A-Z become a-z.
_BYTES = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SKIP = 0xFFFFFFFF
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers as planes of bytes, under zstd, behind their lengths."""
    import zstandard

    body = b"".join([np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays])
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(a) for a in arrays], "<i8").tobytes() + body)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * n
    for size in np.frombuffer(raw[: 8 * n], "<i8").tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw[at : at + 8 * size], np.uint8).reshape(8, -1).T).view("<i8").ravel())
        at += 8 * size
    return out


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


class Transducer:
    """Counts of two- and three-word phrases as a deterministic acyclic automaton.

    symbols are the words; heads lead to fans of seconds, a second has the weight of the pair and leads to a state, whose
    arcs have a label and the weight of the triple. A weight of 0 is no phrase but a way to longer ones.
    """

    PARTS = ("symbols", "head", "fan", "second", "weight", "state", "size", "label", "count")

    def __init__(self, *parts: np.ndarray) -> None:
        for name, x in zip(self.PARTS, parts, strict=True):
            setattr(self, name, x)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, c: np.ndarray, at: np.ndarray, d: np.ndarray, e: np.ndarray) -> Transducer:
        """From sorted pairs (a, b) of count c, and triples of pair number at, third word d and count e, sorted alike."""
        symbols = np.unique(np.concatenate([a, b, d]))
        head, fan = np.unique(a, return_counts=True)
        sizes = np.bincount(at, minlength=len(a)).astype(np.int64)
        # The register of states: equal lists of arcs have one sum of hashes; whether all are right is checked below.
        starts = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            nth = (np.arange(len(d)) - np.repeat(starts, sizes)).astype(np.uint64)
            x = (d.astype(np.uint64) * _MIX[0]) ^ (e.astype(np.uint64) * _MIX[1] + nth * _MIX[2])
            x = (x ^ (x >> np.uint64(29))) * _MIX[1]
            x = x ^ (x >> np.uint64(32))
        sums = np.zeros(len(a), np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            with np.errstate(over="ignore"):
                sums[full] = np.add.reduceat(x, starts[full]) * _MIX[2] + sizes[full].astype(np.uint64)
        _, first, state = np.unique(sums, return_index=True, return_inverse=True)
        if not (np.array_equal(sizes[first][state], sizes) and np.array_equal(gathered(d, starts[first][state], sizes), d) and np.array_equal(gathered(e, starts[first][state], sizes), e)):
            first = state = np.arange(len(a))
        rank = lambda v: np.searchsorted(symbols, v)
        label, count = gathered(d, starts[first], sizes[first]), gathered(e, starts[first], sizes[first])
        return cls(symbols, rank(head), fan, rank(b), c, state, sizes[first], rank(label), count)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.symbols[np.repeat(self.head, self.fan)], self.symbols[self.second], self.weight

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair numbers, third words and counts."""
        sizes = self.size[self.state]
        starts = (np.cumsum(self.size) - self.size)[self.state]
        return np.repeat(np.arange(len(self.second)), sizes), self.symbols[gathered(self.label, starts, sizes)], gathered(self.count, starts, sizes)

    def __len__(self) -> int:
        return len(self.second) + int(self.size[self.state].sum())

    @classmethod
    def union(cls, parts: list[Transducer], least: int = 0) -> Transducer:
        """One that takes the phrases of all parts, with their weights added up; phrases under the least count go."""
        pairs, triples = [p.pairs() for p in parts], [p.triples() for p in parts]
        a, b, c = (np.concatenate(x) for x in zip(*pairs))
        shift = np.cumsum([0, *[len(p[0]) for p in pairs]])[:-1]
        at = np.concatenate([t[0] + s for t, s in zip(triples, shift)])
        d, e = (np.concatenate([t[k] for t in triples]) for k in (1, 2))
        symbols = np.unique(np.concatenate([a, b, d]))
        rank, m = lambda v: np.searchsorted(symbols, v), len(symbols)
        if m >= 1 << 31:
            raise ValueError("too many words in one range")
        every = rank(a) * m + rank(b)
        keys, weights = _summed(every, c)
        own = np.searchsorted(keys, every)[at]
        longer, counts = _summed(own * m + rank(d), e)
        if least:
            keep = counts >= least
            longer, counts = longer[keep], counts[keep]
            on = np.zeros(len(keys), bool)
            on[longer // m] = True
            weights = np.where(weights >= least, weights, 0)
            stay = on | (weights > 0)
            number = np.cumsum(stay) - 1
            keys, weights, longer = keys[stay], weights[stay], number[longer // m] * m + longer % m
        return cls.build(symbols[keys // m], symbols[keys % m], weights, longer // m, symbols[longer % m], counts)

    def split(self, n: int) -> list[Transducer]:
        """n transducers with the triples dealt by their third words; the first has the pairs' own weights."""
        a, b, c = self.pairs()
        at, d, e = self.triples()
        with np.errstate(over="ignore"):
            side = ((d.astype(np.uint64) * _MIX[1]) >> np.uint64(33)).astype(np.int64) % n
        out = []
        for k in range(n):
            own = side == k
            stay = np.bincount(at[own], minlength=len(a)) > 0 if k else np.ones(len(a), bool)
            out.append(Transducer.build(a[stay], b[stay], c[stay] if not k else np.zeros(int(stay.sum()), np.int64), (np.cumsum(stay) - 1)[at[own]], d[own], e[own]))
        return out

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weights of the pairs (a, b): both automata are walked word by word; 0 where the path breaks off."""
        one, two = (np.searchsorted(self.symbols, x) for x in (a, b))
        m = len(self.symbols)
        known = (one < m) & (two < m)
        known[known] &= (self.symbols[one[known]] == a[known]) & (self.symbols[two[known]] == b[known])
        paths = np.repeat(self.head, self.fan) * m + self.second
        key = np.where(known, one * m + two, -1)
        at = np.minimum(np.searchsorted(paths, key), max(0, len(paths) - 1))
        return np.where(known & (paths[at] == key), self.weight[at], 0) if len(paths) else np.zeros(len(a), np.int64)

    def dump(self) -> bytes:
        gaps = np.diff(self.symbols, prepend=0)
        return _packed([gaps, *[getattr(self, n) for n in self.PARTS[1:]]])

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        parts = _unpacked(data, len(cls.PARTS))
        return cls(np.cumsum(parts[0]), *parts[1:])


class _Shard(dict):
    """Numbers of words from 1 on; 0 ends a piece."""

    def __init__(self, name: int) -> None:
        super().__init__({b"": _SKIP, b"\n": 0})
        self.name, self.parts, self.places = name, [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n

    def add(self, text: str) -> None:
        words = text.encode().translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        numbers = numbers[numbers != _SKIP]
        self.parts += [numbers.astype(np.uint32), np.zeros(1, np.uint32)]
        self.places += len(numbers) + 1


_SHARD = "shard bigint, lang string, numbers binary, first bigint, words array<binary>, counts array<bigint>"


def shards(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Written rows of shards: their documents as numbers of words, or a list of words with their numbers and counts."""
    held = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(F.col(lang_col), F.lit("und")).alias("l"))
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = T._parse_datatype_string(_SHARD).names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shards_open = TaskContext.get().partitionId() << 32, {}

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            shard = shards_open.pop(lang)
            numbers = np.concatenate(shard.parts).astype(np.int64)
            counts, words = np.bincount(numbers, minlength=len(shard) - 1).tolist(), list(shard)[2:]
            row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard.name, lang, *x), types)], names=names)
            if words:
                yield row(_packed([numbers]), None, None, None)
            for k in range(0, len(words), _LISTED):
                yield row(None, k + 1, words[k : k + _LISTED], counts[k + 1 : k + 1 + _LISTED])

        for batch in (x for whole in batches for x in slices(whole)):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = shards_open.get(lang)
                if shard is None:
                    shard = shards_open[lang] = _Shard(made)
                    made += 1
                shard.add(text)
                if len(shard) > SHARD_WORDS or shard.places > SHARD_PLACES:
                    yield from closed(lang)
                elif len(shards_open) > 1 and sum(s.places for s in shards_open.values()) > SHARD_PLACES:
                    yield from closed(max(shards_open, key=lambda x: shards_open[x].places))
        for lang in list(shards_open):
            yield from closed(lang)

    return written(held.mapInArrow(cut, _SHARD), "shards")


def frequent_words(listed: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(words, sizes, mass): words (lang, word, f, gid, pos, width, u) that stand least times or more, sizes (lang, n) of all
    words, and the number of places of the former.

    gid orders words by language and bytes. pos and width are where a word's share of all places begins and how wide it is,
    from 0 to 1; u is where it begins within its language.
    """
    counted = written(listed.groupBy("lang", "word").agg(F.sum("c").alias("f")), "words")
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    often = counted.filter(F.col("f") >= least).repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    often = written(often.withColumn("gid", F.monotonically_increasing_id()), "often").withColumn("part", F.shiftrightunsigned("gid", 33))
    parts = often.groupBy("part").agg(F.sum("f").alias("f")).orderBy("part").collect()  # a row per range
    starts, mass = [], 0
    for p, f in parts:
        starts.append((p, mass))
        mass += f
    before = F.coalesce(F.sum("f").over(Window.partitionBy("part").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = often.withColumn("cum", before).join(F.broadcast(listed.sparkSession.createDataFrame(starts, "part bigint, start bigint")), "part")
    at = at.withColumn("cum", F.col("cum") + F.col("start"))
    langs = at.groupBy("lang").agg(F.min("cum").alias("from"), F.sum("f").alias("of"))
    at = at.join(langs, "lang")
    total = float(max(1, mass))
    out = at.select(
        "lang", "word", "f", "gid", (F.col("cum") / total).alias("pos"), (F.col("f") / total).alias("width"), ((F.col("cum") - F.col("from")) / F.col("of")).alias("u")
    )
    return written(out, "frequent"), sizes, mass


def _range(pos, width, u, ranges: int):
    """The range of a prefix: of equal shares of all places, the one where its own begins. Columns and arrays alike."""
    share = (pos + width * u) * float(ranges)
    return F.least(F.floor(share), F.lit(ranges - 1)).cast("bigint") if isinstance(share, Column) else np.minimum(share.astype(np.int64), ranges - 1)


def pieces(cut: DataFrame, listed: DataFrame, words: DataFrame, ranges: int) -> DataFrame:
    """(range, piece, n): the transducer of every shard in pieces, one for each range of prefixes."""
    known = listed.join(words.drop("f"), ["lang", "word"]).select(F.col("shard").alias("of"), "no", "gid", "pos", "width", "u")
    numbers = cut.filter("numbers IS NOT NULL").select("shard", "numbers")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            no, gid, pos, width, u = (right.column(c).to_numpy() for c in ("no", "gid", "pos", "width", "u"))
            order = np.argsort(gid)
            no, gid, pos, width, u = no[order], gid[order], pos[order], width[order], u[order]
            m = len(gid)
            numbers = _unpacked(left.column("numbers")[0].as_py(), 1)[0]
            look = np.full(int(numbers.max(initial=0)) + 1, -1, np.int64)
            look[no] = np.arange(m)
            seq = look[numbers]
            ok = (seq[:-1] >= 0) & (seq[1:] >= 0)
            pair = seq[:-1] * m + seq[1:]
            keys, counts = np.unique(pair[ok], return_counts=True)
            three = ok[:-1] & ok[1:]
            longer, more = np.unique((pair[:-1] * m + seq[2:])[three], return_counts=True)
            at = np.searchsorted(keys, longer // m)
            a, b, d = keys // m, keys % m, longer % m
            place = _range(pos[a], width[a], u[b], ranges)
            # Ranges ascend with prefixes; a stable sort keeps order within each, whatever rounding does at their borders.
            order = np.argsort(place, kind="stable")
            turned = np.empty(len(order), np.int64)
            turned[order] = np.arange(len(order))
            at = turned[at]
            by_pair = np.argsort(at, kind="stable")
            at, d, more = at[by_pair], d[by_pair], more[by_pair]
            a, b, counts, place = gid[a[order]], gid[b[order]], counts[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            ends = np.append(cuts[1:], len(place))
            lo, hi = np.searchsorted(at, cuts), np.searchsorted(at, ends)
            for x, y, s, t in zip(cuts.tolist(), ends.tolist(), lo.tolist(), hi.tolist()):
                made = Transducer.build(a[x:y], b[x:y], counts[x:y], at[s:t] - x, gid[d[s:t]], more[s:t])
                out.append((int(place[x]), made.dump(), len(made)))
        return pa.table({"range": pa.array([r[0] for r in out], pa.int64()), "piece": pa.array([r[1] for r in out], pa.binary()), "n": pa.array([r[2] for r in out], pa.int64())})

    held = numbers.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(count, "range bigint, piece binary, n bigint")
    return written(held, "pieces")


def unions(held: DataFrame, least: int, limit: int | None = None) -> DataFrame:
    """(range, sub, automaton): the union of all pieces of each range, pruned. Ranges with more phrases than the limit are
    cut by third words into as many parts as that takes; part 0 has their pairs."""
    limit = limit or 4 * RANGE
    sums = held.groupBy("range").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
    hot = written(sums.select("range", F.ceil(F.col("n") / limit).cast("int").alias("subs")), "hot")
    small = hot.count() <= 1000

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, piece, n in zip(*[c.to_pylist() for c in batch.columns]):
                parts = Transducer.load(piece).split(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([p.dump() for p in parts], pa.binary())], names=["range", "sub", "piece"]
                )

    if hot.isEmpty():
        every = held.select("range", F.lit(0).alias("sub"), "piece")
    else:
        of = F.broadcast(hot) if small else hot
        split = held.join(of, "range").select("range", "piece", "subs").mapInArrow(cut, "range bigint, sub int, piece binary")
        every = held.join(of, "range", "left_anti").select("range", F.lit(0).alias("sub"), "piece").unionByName(split)

    def unite(rows: pa.Table) -> pa.Table:
        done, waiting, size = None, [], 0
        for cell in rows.column("piece"):
            part = Transducer.load(cell.as_py())
            waiting.append(part)
            size += len(part)
            if size > limit:
                done = Transducer.union(([done] if done else []) + waiting)
                waiting, size = [], 0
        done = Transducer.union(([done] if done else []) + waiting, least)
        return pa.table({"range": rows.column("range").slice(0, 1), "sub": rows.column("sub").slice(0, 1), "automaton": pa.array([done.dump()], pa.binary())})

    return written(every.groupBy("range", "sub").applyInArrow(unite, "range bigint, sub int, automaton binary"), "automata")


def paths(automata: DataFrame) -> DataFrame:
    """(w1, w2, w3, a): the phrases of the automata, w3 null for pairs."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                one = Transducer.load(cell.as_py())
                a, b, c = one.pairs()
                at, d, e = one.triples()
                on = c > 0
                none = pa.nulls(int(on.sum()), pa.int64())
                for x in ((a[on], b[on], none, c[on]), (a[at], b[at], d, e)):
                    for k in range(0, len(x[0]), 10_000):
                        yield pa.RecordBatch.from_arrays([v[k : k + 10_000] if isinstance(v, pa.Array) else pa.array(v[k : k + 10_000]) for v in x], names=["w1", "w2", "w3", "a"])

    return automata.select("automaton").mapInArrow(walk, "w1 bigint, w2 bigint, w3 bigint, a bigint")


def part_counts(parts: DataFrame, automata: DataFrame) -> DataFrame:
    """(q1, q2, f) of distinct pairs (range, q1, q2), by composing them with the automaton of their range."""

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (left.column(c).to_numpy() for c in ("q1", "q2"))
        if len(a) and not right.num_rows:
            raise ValueError("a part lies in a range without phrases")
        f = Transducer.load(right.column("automaton")[0].as_py()).compose(a, b) if len(a) else np.empty(0, np.int64)
        if (f == 0).any():
            raise ValueError("a part of a candidate has no count")
        return pa.table({"q1": pa.array(a, pa.int64()), "q2": pa.array(b, pa.int64()), "f": pa.array(f, pa.int64())})

    whole = automata.filter("sub = 0").select("range", "automaton")
    return parts.groupBy("range").cogroup(whole.groupBy("range")).applyInArrow(compose, "q1 bigint, q2 bigint, f bigint")


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact up to counts of 10^15."""
    whole = lambda c, n: F.col(c).cast(f"decimal({n},0)")
    squared = (whole(a, 15) * whole(a, 15)).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", squared, whole(l, 15) * whole(r, 15))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """The best phrases of two or three words of every language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts fall into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs. a counts a
    phrase within pieces, overlaps included; a phrase that stands least times or more is scored by its weakest cut into a
    first part (l) and a rest (r). Phrases inside a longer candidate with share per cent of their count go. Ties in score go
    to the larger a, then to the smaller phrase in bytes. n is the number of words of the language; a null language is
    und. A null or empty text has no words, repeated rows count each, a text of one word or an empty table gives no phrase.
    Other columns play no part. least must be positive.
    """
    if least < 1:
        raise ValueError("least must be positive")
    cut = shards(docs, text_col, lang_col)
    listed = cut.filter("words IS NOT NULL").select("shard", "lang", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("p", "x"))
    listed = listed.select("shard", "lang", (F.col("first") + F.col("p")).alias("no"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words, sizes, mass = frequent_words(listed, least)
    ranges = max(1, -(-mass // RANGE))
    automata = unions(pieces(cut, listed, words, ranges), least)
    found = written(paths(automata), "candidates")
    of = lambda k: words.select(*[F.col(c).alias(f"{c}{k}") for c in ("lang", "word", "f", "pos", "width", "u")], F.col("gid").alias(f"w{k}"))
    named = written(found.join(of(1), "w1").join(of(2).drop("lang2"), "w2").join(of(3).drop("lang3"), "w3", "left"), "named")
    two, three = named.filter("w3 IS NULL"), named.filter("w3 IS NOT NULL")
    column = lambda k: [F.col(f"{c}{k}") for c in ("pos", "width")]
    ahead = three.select(_range(*column(1), F.col("u2"), ranges).alias("range"), F.col("w1").alias("q1"), F.col("w2").alias("q2"))
    behind = three.select(_range(*column(2), F.col("u3"), ranges).alias("range"), F.col("w2").alias("q1"), F.col("w3").alias("q2"))
    counts = written(part_counts(ahead.unionByName(behind).distinct(), automata), "parts")
    as_part = lambda x, y, f: counts.select(F.col("q1").alias(x), F.col("q2").alias(y), F.col("f").alias(f))
    three = three.join(as_part("w1", "w2", "f12"), ["w1", "w2"]).join(as_part("w2", "w3", "f23"), ["w2", "w3"])
    cuts = [F.struct(_score("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, l, r in ((1, "f1", "f23"), (2, "f12", "f3"))]
    three = three.withColumn("cut", F.least(*cuts))
    inside = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    alone = two.join(inside, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    alone = alone.withColumn("cut", F.struct(_score("a", "f1", "f2").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r")))
    cols = [F.col("lang1").alias("lang"), F.concat_ws(" ", *[F.col(f"word{k}").cast("string") for k in (1, 2, 3)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"]
    every = alone.select(*cols).unionByName(three.select(*cols))
    order = (F.desc("score"), F.desc("a"), "phrase")
    # The best of parts of a language, then the best of those: one task sees at most ``first`` rows of each part.
    parts = max(1, round(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    dealt = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    top = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
