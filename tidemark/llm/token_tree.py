"""Edit-aware token counts.

A document is kept as its pre-tokens in blocks under two segment trees, of token counts and of lengths. An edit finds its
place by descending the lengths, re-splits from two pre-tokens before it until a new boundary meets an old one behind it,
counts only what is new, and updates the sums on the way to the root. The splitting pattern looks ahead, never behind, so
equal boundaries mean equal splits from there on. Trees can be stored beside their texts (lengths and counts of the
pre-tokens) and edited later without another look at what an edit doesn't touch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passing, row_of, slices, unpacked

#: Pre-tokens in a new block; a block that has grown to four times as many is cut again.
BLOCK = 64
_CACHED = 500_000


class Counter:
    """Tokens of a pre-token, remembered; and the splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > _CACHED:
            known.clear()
        for p in parts:
            if p not in known:
                known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in parts]


class Sums:
    """A segment tree of sums over a fixed number of leaves."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.tree = [0] * self.size + leaves + [0] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    def set(self, leaf: int, value: int) -> None:
        i = leaf + self.size
        step = value - self.tree[i]
        while i:
            self.tree[i] += step
            i //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds place at, and the sum of all leaves before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at >= before + self.tree[i]:
                before += self.tree[i]
                i += 1
        return i - self.size, before

    @property
    def total(self) -> int:
        return self.tree[1]


class TokenTree:
    """Pre-tokens and their counts in blocks, under trees of the blocks' sums."""

    def __init__(self, parts: list[str], counts: list[int], counter: Counter) -> None:
        self.counter = counter
        self.blocks = [parts[k : k + BLOCK] for k in range(0, len(parts), BLOCK)] or [[]]
        self.counts = [counts[k : k + BLOCK] for k in range(0, len(parts), BLOCK)] or [[]]
        self.recounted = 0
        self._sum()

    @classmethod
    def of(cls, text: str, counter: Counter) -> TokenTree:
        parts = counter.split(text)
        return cls(parts, counter.counts(parts), counter)

    @classmethod
    def stored(cls, text: str, lengths: list[int], counts: list[int], counter: Counter) -> TokenTree:
        """A tree again from its text and what was stored of it; nothing is split or encoded."""
        ends = np.cumsum([0, *lengths]).tolist()
        return cls([text[a:b] for a, b in zip(ends, ends[1:])], counts, counter)

    def _sum(self) -> None:
        self.sums = Sums([sum(c) for c in self.counts])
        self.lengths = Sums([sum(map(len, b)) for b in self.blocks])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end; places beyond the text are its end."""
        size = self.lengths.total
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        b, before = self.lengths.find(min(start, max(0, size - 1)))
        b = min(b, len(self.blocks) - 1)
        k, at = 0, before
        while k < len(self.blocks[b]) and at + len(self.blocks[b][k]) < start:
            at += len(self.blocks[b][k])
            k += 1
        for _ in range(2):  # boundary context: a split can look past its own end
            if not k:
                if not b:
                    break
                b -= 1
                while b and not self.blocks[b]:
                    b -= 1
                k = len(self.blocks[b])
                if not k:
                    break
            k -= 1
            at -= len(self.blocks[b][k])
        old: list[str] = []
        last, j = b, k
        reach, ahead = end, 8
        while True:
            pos = at + sum(map(len, old))
            while (pos < reach or ahead) and last < len(self.blocks):
                if j < len(self.blocks[last]):
                    old.append(self.blocks[last][j])
                    ahead -= pos >= reach
                    pos += len(old[-1])
                    j += 1
                elif last + 1 < len(self.blocks):
                    last, j = last + 1, 0
                else:
                    break
            whole = last + 1 >= len(self.blocks) and j >= len(self.blocks[last])
            window = "".join(old)
            parts = self.counter.split(window[: start - at] + new + window[end - at :])
            if whole:
                cut, kept = len(parts), len(old)
                break
            # Old boundaries behind the edit, in new places; the last few splits of a window may still change.
            shift, p, marks = len(new) - (end - start), at, {}
            for i, x in enumerate(old):
                if p >= end:
                    marks[p + shift] = i
                p += len(x)
            p, cut = at, -1
            for i, x in enumerate(parts):
                if p in marks and p >= start + len(new) and len(old) - marks[p] > 3:
                    cut, kept = i, marks[p]
                    break
                p += len(x)
            if cut >= 0:
                break
            ahead = 2 * len(old) + 8
        fresh = parts[:cut]
        self.recounted += len(fresh)
        self._replace(b, k, kept, fresh)

    def _replace(self, b: int, k: int, n: int, fresh: list[str]) -> None:
        """Put fresh in place of n pre-tokens from the k-th of block b on; the first block touched takes what is new."""
        first, changed = b, {b}
        while n:
            block = self.blocks[b]
            gone = min(n, len(block) - k)
            if gone:
                del block[k : k + gone], self.counts[b][k : k + gone]
                changed.add(b)
                n -= gone
            if n:
                b, k = b + 1, 0
        at = k if first == b else len(self.blocks[first])
        self.blocks[first][at:at] = fresh
        self.counts[first][at:at] = self.counter.counts(fresh)
        block, counts = self.blocks[first], self.counts[first]
        if len(block) > 4 * BLOCK:
            self.blocks[first : first + 1] = [block[i : i + BLOCK] for i in range(0, len(block), BLOCK)]
            self.counts[first : first + 1] = [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)]
            self._sum()
            return
        for i in changed:
            self.sums.set(i, sum(self.counts[i]))
            self.lengths.set(i, sum(map(len, self.blocks[i])))

    @property
    def n_tokens(self) -> int:
        return self.sums.total

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)


EDITS = "array<struct<start:int,end:int,new:string>>"
_TREE = [T.StructField("lengths", T.ArrayType(T.IntegerType(), False)), T.StructField("counts", T.ArrayType(T.IntegerType(), False))]


def _lists(rows: list[list[int]]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.fromiter((v for x in rows for v in x), np.int32, int(at[-1]))))


def token_trees(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with token_tree: the lengths and token counts of the text's pre-tokens, in order.

    Null and empty texts have empty lists. Rows are independent of each other, an empty table gives none, and a column
    token_tree of docs, in whatever case, is replaced. A task holds the lists of 1 MB of text, or of one longer text.
    """
    keep = passing(docs.columns if keep is None else keep, ["token_tree"])
    held = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), row_of(keep))
    schema = T.StructType([held.schema["r"], *_TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks_path, pattern)
        for batch in (x for whole in batches for x in slices(whole)):
            parts = [counter.split(t.as_py()) for t in batch.column(0)]
            made = [_lists([list(map(len, p)) for p in parts]), _lists([counter.counts(p) for p in parts])]
            yield pa.RecordBatch.from_arrays([batch.column(1), *made], names=schema.names)

    return held.mapInArrow(run, schema).select(*unpacked(keep), F.struct("lengths", "counts").alias("token_tree"))


def edit_trees(
    trees: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", edits_col: str = "edits", keep: list[str] | None = None, with_trees: bool = False
) -> DataFrame:
    """trees (or its columns in keep) with n_tokens, n_pretokens, n_tokens_after, n_recounted and, if asked, token_tree
    and the text as they are after the edits. The column token_tree is that of token_trees over text_col.

    edits_col holds each document's edits in the order in which they apply, with places in code points of the text as it
    is by then. Null texts count as empty, null edits or edit lists change nothing, nulls in token_tree count as empty
    lists. Rows are independent of each other; an empty table gives none; a column of a clashing name, in whatever case,
    is replaced. A task holds one document's tree at a time.
    """
    names = ["n_tokens", "n_pretokens", "n_tokens_after", "n_recounted"]
    keep = passing(trees.columns if keep is None else keep, [*names, edits_col, "token_tree", *([text_col] if with_trees else [])])
    none = F.array().cast("array<int>")
    held = trees.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(edits_col).cast(EDITS).alias("e"),
        F.coalesce("token_tree.lengths", none).alias("l"), F.coalesce("token_tree.counts", none).alias("c"), row_of(keep),
    )
    schema = T.StructType([held.schema["r"], *[T.StructField(n, T.LongType()) for n in names], *([*_TREE, T.StructField("t", T.StringType())] if with_trees else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks_path, pattern)
        for batch in (x for whole in batches for x in slices(whole)):
            rows, after = [], []
            for text, edits, lengths, counts in zip(*batch.columns[:4]):
                tree = TokenTree.stored(text.as_py(), lengths.as_py(), counts.as_py(), counter)
                n, parts = tree.n_tokens, sum(map(len, tree.blocks))
                for e in edits.as_py() or []:
                    if e and e["start"] is not None:
                        tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["new"] or "")
                rows.append((n, parts, tree.n_tokens, tree.recounted))
                if with_trees:
                    after.append(([len(p) for b in tree.blocks for p in b], [c for b in tree.counts for c in b], tree.text()))
            made = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if with_trees:
                made += [_lists([x[0] for x in after]), _lists([x[1] for x in after]), pa.array([x[2] for x in after], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(4), *made], names=schema.names)

    out = held.mapInArrow(run, schema)
    return out.select(*unpacked(keep), *names, *([F.struct("lengths", "counts").alias("token_tree"), F.col("t").alias(text_col)] if with_trees else []))


def count_with_edits(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", edits_col: str = "edits", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with the counts of edit_trees, over trees made on the way.

    A null text counts as empty, null edits as none; places beyond a text are its end. Repeated rows get equal results, an
    empty table gives none; a column of a new name, in whatever case, is replaced.
    """
    names = ["n_tokens", "n_pretokens", "n_tokens_after", "n_recounted"]
    keep = passing(docs.columns if keep is None else keep, [*names, edits_col])
    held = docs.select(row_of(keep), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
    made = edit_trees(token_trees(held, ranks_path, pattern), ranks_path, pattern, keep=["r"])
    return made.select(*unpacked(keep), *names)
