"""SentencePiece encoding and decoding of merge-type vocabularies.

A piece never crosses from other characters into a space mark or into a line feed, so a text falls apart into chunks,
each of which is encoded once per task: a score-ordered agenda of adjacent symbol pairs merges the best pair first, the
leftmost of equal ones. Short chunks of one length are merged together: their agendas are the rows of an array of pair
ranks, each step takes every row's best entry, and each open row gets one symbol shorter; long chunks have a heap each.
Symbols without a piece become byte pieces. In every Arrow batch, all chunks seen for the first
time are encoded by the sentencepiece library too, in one call, and any difference raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passing, row_of, slices, unpacked

MARK = "▁"
_CACHED, _LONGEST = 500_000, 48
#: Bytes of text that are chunks and ids at one time; a longer text is a slice of its own.
_SLICE = 1 << 20
#: Ids from here on stand for characters without a piece; the rank of pairs without one.
_NO_PIECE, _NEVER = 1 << 20, 1 << 40


class Vocabulary:
    """A merge-type vocabulary: pieces with scores, bytes for what has no piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)]
        hidden = set(special)
        self.pieces = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if i not in hidden}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in special if sp.is_byte(i)}
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        inner = [p for p in self.pieces if MARK in p.lstrip(MARK) or ("\n" in p and p != "\n")]
        # Where pieces do cross chunks, whole texts are one chunk: slower, still right.
        self.splits = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not inner else r"(?s).+")
        self.plain = not inner
        self._pairs()

    def _pairs(self) -> None:
        """For the arrays: ids of characters, and a sorted table of the pairs that make a piece, ranked by score."""
        self.chars = np.arange(0x110000, dtype=np.int64) + _NO_PIECE
        for p, (_, i) in self.pieces.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        rank = {x: k for k, x in enumerate(sorted({x for x, _ in self.pieces.values()}, reverse=True))}

        def part(x: str) -> int | None:
            return int(self.chars[ord(x)]) if len(x) == 1 else self.pieces[x][1] if x in self.pieces else None

        found = {}
        for p, (score, i) in self.pieces.items():
            for k in range(1, len(p)):
                a, b = part(p[:k]), part(p[k:])
                if a is not None and b is not None:
                    found[a << 22 | b] = (rank[score], i)
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([found[k][1] for k in self.keys.tolist()], np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; the rank is _NEVER where there is no piece."""
        key = a << 22 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NEVER), self.merged[at]

    def encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of every chunk as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            n = len(c)
            if n > _LONGEST or "\0" in c or not len(self.keys):
                out[c] = np.array(self.encode_chunk(c), "<u4").tobytes()
            else:
                by_length.setdefault(n, []).append(c)
        for n, own in by_length.items():
            names = np.array(own, dtype=object)
            sym = self.chars[np.array(own, dtype=f"<U{n}").view(np.uint32).reshape(len(own), n)]
            rank, piece = self._look(sym[:, :-1], sym[:, 1:]) if n > 1 else (np.empty((len(own), 0), np.int64),) * 2
            while True:
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(names), np.int64)
                done = rank[np.arange(len(names)), best] == _NEVER if rank.shape[1] else np.ones(len(names), bool)
                self._emit(names[done], sym[done], out)
                if done.all():
                    break
                go = ~done
                names, sym, rank, piece, best = names[go], sym[go], rank[go], piece[go], best[go]
                rows, width = np.arange(len(names)), sym.shape[1]
                sym[rows, best] = piece[rows, best]
                stay = np.ones(sym.shape, bool)
                stay[rows, best + 1] = False
                sym = sym[stay].reshape(len(names), width - 1)
                stay = np.ones(rank.shape, bool)
                stay[rows, best] = False
                rank, piece = (x[stay].reshape(len(names), width - 2) for x in (rank, piece))
                for at, there in ((best - 1, best > 0), (best, best < width - 2)):
                    r, c = rows[there], at[there]
                    rank[r, c], piece[r, c] = self._look(sym[r, c], sym[r, c + 1])
        return out

    def _emit(self, names: np.ndarray, sym: np.ndarray, out: dict[str, bytes]) -> None:
        if not len(names):
            return
        odd = (sym >= _NO_PIECE).any(axis=1)
        flat, step = sym[~odd].astype("<u4").tobytes(), 4 * sym.shape[1]
        out.update((c, flat[k * step : (k + 1) * step]) for k, c in enumerate(names[~odd]))
        for c, row in zip(names[odd], sym[odd].tolist()):
            ids: list[int] = []
            for i in row:
                if i < _NO_PIECE:
                    ids.append(i)
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in chr(i - _NO_PIECE).encode("utf-8"))
                else:
                    ids.append(self.unknown)
            out[c] = np.array(ids, "<u4").tobytes()

    def encode_chunk(self, chunk: str) -> list[int]:
        """Merge by agenda. Symbols are kept as linked positions; stale agenda entries no longer match their span."""
        sym = list(chunk)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        pieces = self.pieces

        def offer(i: int, j: int) -> None:
            found = pieces.get(both := sym[i] + sym[j])
            if found:
                heapq.heappush(agenda, (-found[0], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or right[i] != j or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        ids: list[int] = []
        for s in sym:
            if s:
                if s in pieces:
                    ids.append(pieces[s][1])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in s.encode("utf-8"))
                else:
                    ids.append(self.unknown)
        return ids


class Encoder:
    """Encodes batches of texts to arrays of ids with begin and end; remembers chunks, up to a bound."""

    def __init__(self, path: str, check: bool = True) -> None:
        self.vocabulary, self.check = Vocabulary(path), check
        self.known: dict[str, bytes] = {}
        self._edge = [np.array([i] if i >= 0 else [], "<u4").tobytes() for i in (self.vocabulary.begin, self.vocabulary.end)]

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        v = self.vocabulary
        if not v.plain or "  " in text or MARK in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text:
            return v.splits.findall(MARK + text.replace(" ", MARK))
        # Single spaces between words: the common case, without a regular expression.
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            if line:
                words = line.split(" ")
                if k:
                    out.append(words[0])
                    out.extend([MARK + w for w in words[1:]])
                else:
                    out.extend([MARK + w for w in words])
            elif not k:
                out.append(MARK)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > _CACHED:
            self.known.clear()
        cut = [self._chunks(t) for t in texts]
        known = self.known
        fresh = self.vocabulary.encode_chunks([c for c in {c for chunks in cut for c in chunks} if c not in known])
        if self.check and fresh:
            self._compare(fresh)
        long = {c: ids for c, ids in fresh.items() if len(c) > _LONGEST}
        known.update(fresh)
        out = [b"".join([self._edge[0], *map(known.__getitem__, chunks), self._edge[1]]) for chunks in cut]
        for c in long:
            del known[c]
        return out

    def _compare(self, fresh: dict[str, bytes]) -> None:
        """All fresh chunks in one text, a line each, must get the same ids from the library."""
        v = self.vocabulary
        if v.plain:
            own = {c: ids for c, ids in fresh.items() if c != "\n"}
            feed = np.array(v.encode_chunk("\n"), "<u4").tobytes()
            want = np.array(v.encode_chunk(MARK), "<u4").tobytes() + b"".join([feed + ids for ids in own.values()])
            got = v.library.encode("".join(["\n" + c.replace(MARK, " ") for c in own])) if own else None
        else:
            got = [i for c in fresh for i in v.library.encode(c[1:].replace(MARK, " "))]
            want = b"".join(fresh.values())
        if got is not None and np.array(got, "<u4").tobytes() != want:
            raise ValueError("the agenda and the sentencepiece library disagree on a chunk of this batch")

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.vocabulary.library.decode([np.frombuffer(b, "<u4").tolist() for b in ids], num_threads=1)


def encode_documents(
    docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True, with_text: bool = False, check: bool = True
) -> DataFrame:
    """docs (or its columns in keep) with n_tokens, ids_sha256, decoded_sha256 and, as asked, piece_ids and decoded.

    A null text counts as empty and has the begin and end ids only. Rows are independent of each other: repeated rows get
    equal results, an empty table gives none, and other columns pass through; of a clashing name, in whatever case, the new
    column replaces the old one. Memory is bounded by an Arrow batch, chunks and ids of one slice of it, and the remembered chunks.
    """
    keep = docs.columns if keep is None else keep
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text
    keep = passing(keep, [f.name for f in new])
    held = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), row_of(keep))
    schema = T.StructType([held.schema["r"], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path, check)
        for batch in (x for whole in batches for x in slices(whole, _SLICE)):
            ids = encoder.encode(batch.column(0).to_pylist())
            texts = encoder.decode(ids)
            made = [
                pa.array([len(b) // 4 for b in ids], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                made.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32), flat))
            if with_text:
                made.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=schema.names)

    return held.mapInArrow(run, schema).select(*unpacked(keep), *[f.name for f in new])
