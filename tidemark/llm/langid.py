"""Language identification by a bidirectional gated recurrent network over bytes.

A text is one sequence of bytes, white space and all. It runs in stretches of ``STRETCH`` positions; each direction starts
``LEAD`` positions before its stretch on the text's own bytes, so a position sees its neighbours across words and across
stretches. At every position the network gives a distribution over languages; a document's distribution is the mean over
all of its positions. One gate per unit decides how much of the state a candidate replaces; both are squashed by
x / (1 + |x|). Training is plain numpy: backpropagation through time with Adam, from a fixed seed, on windows that Spark
cuts from the drawn texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passing, row_of, slices, unpacked, written

#: Bounds on what is learned from: documents, of every language alike, and windows of their texts, in characters.
MAX_DOCUMENTS, MAX_WINDOWS, WINDOW = 3000, 12_000, 80
HIDDEN, STRETCH, LEAD = 12, 256, 32
#: Stretches that run at one time, and bytes of text whose stretches are gathered.
_ROWS, _SLICE = 1024, 1 << 20
_PAD = 0


class Gated:
    """One direction. Of w[byte] + u h + b, the first half makes the gate g, the second the candidate n; h += g (n - h)."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.h = hidden
        self.w = rng.normal(0, 0.3, (2 * hidden, 256)).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (2 * hidden, hidden)).astype(np.float32)
        self.b = np.zeros((2 * hidden, 1), np.float32)

    def forward(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, hidden, rows) for bytes (steps, rows). trace gets what backward needs of every step."""
        (steps, rows), k = x.shape, self.h
        table, u = self.w + self.b, self.u
        h, out = np.zeros((k, rows), table.dtype), np.empty((steps, k, rows), table.dtype)
        a, m = np.empty((2 * k, rows), table.dtype), np.empty((2 * k, rows), table.dtype)
        for t in range(steps):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=m)
            a += m
            np.abs(a, out=m)
            m += 1
            a /= m
            if trace is not None:
                trace.append((h, a.copy(), m.copy()))
            g, n = a[:k], a[k:]
            g += 1
            g *= 0.5
            n -= h
            n *= g
            np.add(h, n, out=out[t])
            h = out[t]
        return out

    def backward(self, x: np.ndarray, trace: list, dout: np.ndarray) -> list[np.ndarray]:
        k, du = self.h, np.zeros_like(self.u)
        every = np.empty((2 * k, *x.shape), dout.dtype)
        carry = np.zeros(dout.shape[1:], dout.dtype)
        for t in range(len(x) - 1, -1, -1):
            h, a, m = trace[t]
            g, n = 0.5 * (a[:k] + 1), a[k:]
            d = carry + dout[t]
            da = every[:, t]
            np.multiply(d, 0.5 * (n - h), out=da[:k])
            np.multiply(d, g, out=da[k:])
            da /= m * m
            du += da @ h.T
            carry = d * (1 - g) + self.u.T @ da
        flat, at = every.reshape(2 * k, -1), x.reshape(-1)
        dw = np.stack([np.bincount(at, row, 256) for row in flat]).astype(self.w.dtype)
        return [dw, du, flat.sum(1, keepdims=True)]


class Tagger:
    """Two directions and a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gated(hidden, rng), Gated(hidden, rng)
        self.v = rng.normal(0, 0.2, (len(languages), 2 * hidden)).astype(np.float32)
        self.c = np.zeros((len(languages), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.c]

    def _soft(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        k = self.ahead.h
        s = np.matmul(self.v[:, :k], ahead)
        s += np.matmul(self.v[:, k:], back)
        s += self.c
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def positions(self, x: np.ndarray, lead: int = 0) -> np.ndarray:
        """Distributions at the positions of equally long sequences: (steps, rows) to (steps, languages, rows).

        The first and last lead positions only lead in: a direction begins with those that lie before it.
        """
        n = len(x) - lead
        return self._soft(self.ahead.forward(x[:n])[lead:], self.back.forward(x[lead:][::-1])[lead:][::-1])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over weighted positions (steps, rows), and its gradient by backpropagation through time."""
        ta: list = []
        tb: list = []
        one, two = self.ahead.forward(x, ta), self.back.forward(x[::-1], tb)[::-1]
        p = self._soft(one, two)
        rows, k = np.arange(x.shape[1]), self.ahead.h
        w = weight / weight.sum()
        loss = float(-(np.log(p[:, y, rows] + 1e-9) * w).sum())
        d = p.copy()
        d[:, y, rows] -= 1
        d *= w[:, None, :]
        ga = self.ahead.backward(x, ta, np.matmul(self.v[:, :k].T, d))
        gb = self.back.backward(x[::-1], tb, np.matmul(self.v[:, k:].T, d)[::-1])
        flat = lambda z: z.transpose(1, 0, 2).reshape(z.shape[1], -1)
        dv = np.concatenate([flat(d) @ flat(one).T, flat(d) @ flat(two).T], axis=1)
        return loss, [*ga, *gb, dv, d.sum((0, 2))[:, None]]


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = 600, batch: int = 128, seed: int = 5, long: int = WINDOW) -> Tagger:
    """A tagger from (bytes, language) rows, every language drawn alike. Equal input gives an equal model.

    A draw is up to ``long`` bytes of a sample; padding, which isn't learned to be tagged, stands around those that are
    shorter, and half of the draws are made shorter, so that beginnings and ends of texts are known.
    """
    languages = sorted({x[1] for x in samples})
    model = Tagger(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    texts = [np.frombuffer(t, np.uint8) for t, _ in samples]
    ys = np.array([languages.index(y) for _, y in samples])
    draw = 1 / np.bincount(ys, minlength=len(languages))[ys] / len(languages)
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.choice(len(texts), batch, p=draw / draw.sum())
        x, weight = np.full((long, batch), _PAD, np.int64), np.zeros((long, batch), np.float32)
        for k, i in enumerate(pick):
            n = min(long, len(texts[i]))
            n = n if k % 2 else int(rng.integers(min(n, 8), n + 1))
            at, to = rng.integers(0, len(texts[i]) - n + 1), rng.integers(0, long - n + 1)
            x[to : to + n, k], weight[to : to + n, k] = texts[i][at : at + n], 1
        _, grads = model.gradients(x, ys[pick], weight)
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def predict(model: Tagger, texts: list[bytes]) -> list[tuple[str | None, float]]:
    """Language and mean probability over all positions; None for an empty text. Before and after a text are padding bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    parts = -(-size // STRETCH)
    total = np.zeros((len(model.languages), len(texts)))
    pad = bytes([_PAD])
    data = np.frombuffer(b"".join([pad * LEAD + t + pad * (LEAD + STRETCH) for t in texts]), np.uint8)
    base = np.concatenate([[0], np.cumsum(size + 2 * LEAD + STRETCH)])[:-1]
    doc = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, reach = base[doc] + nth * STRETCH, np.minimum(STRETCH, size[doc] - nth * STRETCH)
    order = np.argsort(reach, kind="stable")  # the last stretches of short texts run together, no further than they reach
    for k in range(0, len(order), _ROWS):
        own = order[k : k + _ROWS]
        long = int(reach[own].max())
        x = data[starts[own][None, :] + np.arange(long + 2 * LEAD)[:, None]]
        p = model.positions(x, LEAD)
        seen = np.arange(long)[:, None] < reach[own][None, :]
        if not seen.all():
            p *= seen[:, None, :]
        np.add.at(total.T, doc[own], p.sum(axis=0, dtype=np.float64).T)
    out: list[tuple[str | None, float]] = []
    for i, n in enumerate(size.tolist()):
        best = int(total[:, i].argmax()) if n else -1
        out.append((model.languages[best], float(min(1.0, total[best, i] / n))) if n else (None, 0.0))
    return out


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_documents: int = MAX_DOCUMENTS, max_windows: int = MAX_WINDOWS
) -> Tagger | None:
    """A tagger from labelled documents that aren't held out: windows of WINDOW characters from anywhere in their texts.

    Every language gives about the same number of documents, and of windows, so rare languages are learned too; together
    about max_documents and max_windows at most. A language's share is drawn by a threshold on hashes, of different ids and
    then of different windows, so nothing is ranked or gathered on the way and copies count once. Drawn ids are broadcast
    to find their texts, which Spark cuts into windows. Rows without an id, text or label are not learned from.
    """
    ok = F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False))
    able = docs.filter(ok & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("y"))

    def drawn(df: DataFrame, most: int, on: str) -> DataFrame:
        """About most / languages of every language's rows."""
        per = df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
        quota = most / max(1, len(per))
        shares = df.sparkSession.createDataFrame([(r.y, min(1.0, quota / r.n)) for r in per], "y string, share double")
        known = df.join(F.broadcast(shares), "y")
        return known.filter(F.pmod(F.xxhash64(on, F.lit(most)), F.lit(1 << 30)) < F.col("share") * float(1 << 30)).drop("share")

    ids = able.select(F.col("y").cast("string").alias("y"), "i").distinct()
    some = able.join(F.broadcast(drawn(ids, max_documents, "i")), ["i", "y"], "left_semi")
    places = F.sequence(F.lit(0), F.expr(f"(length(t) - 1) div {WINDOW}"))
    cut = some.filter("length(t) > 0").select("y", F.explode(places).alias("at"), "t")
    cut = cut.select("y", F.substring("t", F.col("at") * WINDOW + 1, F.lit(WINDOW)).alias("t")).distinct()
    rows = drawn(written(cut, "windows"), max_windows, "t").select("t", "y").collect()
    return train(sorted((r.t.encode(), r.y) for r in rows)) if rows else None


def identify(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with held_out, lang_pred and score.

    A null text, or one without a letter, is und with score 0, as is everything if there was nothing to learn from.
    A null id is not held out. Texts are used whole and rows are independent of each other: repeated rows get equal
    results, an empty table none. A column of a clashing name is replaced. Stretches of 1 MB of text, or of one longer
    text, are gathered at one time.
    """
    keep = passing(docs.columns if keep is None else keep, ["held_out", "lang_pred", "score"])
    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary"))
    held = docs.select(text.alias("t"), row_of(keep), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    schema = T.StructType([*held.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, _SLICE)):
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            found = predict(model, texts) if model else [(None, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([p or "und" for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names
            )

    return held.mapInArrow(run, schema).select(*unpacked(keep), "held_out", "lang_pred", "score")
