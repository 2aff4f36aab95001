"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (n = 2, 3, 4, none across a
blank), hashed into a fixed table. Embeddings and softmax are trained together with
stochastic gradient descent in numpy, on a bounded sample of the labelled rows; a part
of the sample is kept for calibration: a temperature, and the score below which a
prediction is rejected. As everything after the embeddings is linear, prediction adds
one table entry for each language and n-gram; texts are read whole, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import tokens
from weftlink.llm.text import dealt_sample
from weftlink.session import checkpointed

BUCKETS, SIZE = 1 << 15, 16
GRAMS = (2, 3, 4)
_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit; about ``rows`` labelled rows at most are used.

    They are dealt out to the ``labels`` most frequent languages in equal parts, so a rare
    language is learned from all its rows; of each text the ``terms`` most frequent n-grams
    count.
    """

    rows: int = 4000
    labels: int = 200
    terms: int = 2048
    epochs: int = 4
    batch: int = 32
    rate: float = 0.3
    calibration: float = 0.2
    precision: float = 0.99
    seed: int = 5


def grams(body: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the hashed n-gram at each byte, and whether it is one; lower-case ASCII, blanks alike."""
    low = tokens.LOWER[body].astype(np.uint32)
    blank = ~tokens.NON_BLANK[body]
    low[blank] = 0x20
    for n in GRAMS:
        m = len(body) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        fine = np.ones(m, bool)
        for j in range(n):
            h = (h ^ low[j : j + m]) * _FACTOR[j % 4]
            h ^= h >> np.uint32(15)
            if 0 < j < n - 1:
                fine &= ~blank[j : j + m]
        if n == 2:
            fine &= ~(blank[:m] & blank[1 : m + 1])
        yield (h >> np.uint32(17)).astype(np.int32), fine


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    body = np.frombuffer(text.encode(), np.uint8)
    found = [h[ok] for h, ok in grams(body)]
    at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
    return at, (n / max(1, n.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for first, end, body, offsets in tokens.chunks(texts, tokens.CHUNK // 2):
            n, total = np.zeros(end - first), np.zeros((end - first, len(self.languages)))
            for h, ok in grams(body):
                width = len(body) - len(h)  # an n-gram ends in its own text
                at = np.arange(len(h))
                doc = np.repeat(np.arange(end - first), np.diff(offsets))[: len(h)]
                ok = ok & (at + width < offsets[doc + 1])
                h, doc = h[ok], doc[ok]
                n += np.bincount(doc, minlength=end - first)
                for c in range(len(self.languages)):
                    total[:, c] += np.bincount(doc, self.table[h, c], end - first)
            out[first:end] = total / np.maximum(n, 1)[:, None] + self.bias
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index and calibrated probability of the most likely language."""
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(examples: list[tuple[str, np.ndarray, np.ndarray, bool]], t: Training = Training()) -> Model | None:
    """A model from (language, buckets, shares, kept for calibration); None without any."""
    languages = sorted({x[0] for x in examples})
    if not languages:
        return None
    r = np.random.default_rng(t.seed)
    emb = ((r.random((BUCKETS, SIZE)) - 0.5) * 2 / SIZE).astype(np.float32)
    w, bias = np.zeros((SIZE, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    squares = [np.full(x.shape, 1e-8, np.float32) for x in (emb, w, bias)]
    y = np.array([languages.index(x[0]) for x in examples])
    train = np.array([i for i, x in enumerate(examples) if not x[3] and len(x[1])], int)
    for epoch in range(t.epochs):
        rate = t.rate * (1 - epoch / t.epochs)
        order = r.permutation(train)
        for lo in range(0, len(order), t.batch):
            own = order[lo : lo + t.batch]
            at = np.concatenate([examples[i][1] for i in own])
            v = np.concatenate([examples[i][2] for i in own])[:, None]
            begin = np.cumsum([0] + [len(examples[i][1]) for i in own[:-1]])
            h = np.add.reduceat(emb[at] * v, begin)
            g = softmax(h @ w + bias)
            g[np.arange(len(own)), y[own]] -= 1
            g /= len(own)
            back = np.repeat(g @ w.T, np.diff(np.append(begin, len(at))), axis=0) * v
            rows, inverse = np.unique(at, return_inverse=True)
            d_emb = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(d_emb, inverse, back)
            for x, s, d, k in ((emb, squares[0], d_emb, rows), (w, squares[1], h.T @ g, slice(None)), (bias, squares[2], g.sum(axis=0), slice(None))):
                s[k] += d * d
                x[k] -= rate * d / np.sqrt(s[k])
    model = Model(languages, emb @ w, bias)
    held = [i for i, x in enumerate(examples) if x[3]]
    if held:
        z = np.stack([(model.table[examples[i][1]] * examples[i][2][:, None]).sum(axis=0) + bias for i in held])
        right = y[held]
        loss = {k: -np.log(softmax(z / k)[np.arange(len(z)), right] + 1e-12).mean() for k in np.geomspace(0.05, 20, 61)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        score, ok = p.max(axis=1), p.argmax(axis=1) == right
        order = np.argsort(-score, kind="stable")
        precise = np.flatnonzero(np.cumsum(ok[order]) / np.arange(1, len(ok) + 1) >= t.precision)
        model.threshold = float(score[order][precise[-1]]) if len(precise) else 1.0
    return model


def _examples(t: Training):
    """Features of each sampled text and of a short piece from its middle, as short texts look different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, text, held, h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                w = text.split()
                for piece in (text, " ".join(w[len(w) // 2 : len(w) // 2 + 8])):
                    at, v = features(piece)
                    if len(at) > t.terms:
                        most = np.sort(np.argsort(-v, kind="stable")[: t.terms])
                        at, v = at[most], v[most]
                    out.append((lang, at, v, held, h))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.float32())), pa.array([x[3] for x in out], pa.bool_()), pa.array([x[4] for x in out], pa.int64())], names=["lang", "at", "v", "held", "h"])

    return run


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", t: Training = Training()) -> Model | None:
    """A model from the labelled rows of ``df`` whose crc32(id as text) mod 4 is not 2; None without any.

    The sample (``dealt_sample``) is chosen by hashes of id and text; repeated rows take one
    place in it, very long texts are read whole. Only what ``Training`` bounds reaches the
    driver.
    """
    rows = df.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & (F.pmod(crc(F.col(f"`{key}`")), F.lit(4)) != 2))
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), F.shiftrightunsigned(F.xxhash64(F.lit(t.seed), F.col(f"`{key}`"), F.col(f"`{text}`")), 1).alias("h"))
    chosen = checkpointed(dealt_sample(rows, "lang", "h", t.rows, t.labels))
    held = F.pmod(F.xxhash64("h"), F.lit(1000)) < int(1000 * t.calibration)
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = sample.select("lang", "text", held.alias("held"), "h").mapInArrow(_examples(t), "lang string, at array<int>, v array<float>, held boolean, h long").toArrow()
    found = found.sort_by([("h", "ascending"), ("lang", "ascending")]).combine_chunks()
    at, v = (column(found, c) for c in ("at", "v"))
    return fit(list(zip(found["lang"].to_pylist(), at, v, found["held"].to_pylist(), strict=True)), t)


def column(found: pa.Table, name: str) -> list[np.ndarray]:
    """A list column of a table as one numpy array for each row, without copies."""
    rows = found[name].combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    values, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def crc(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                name, score, low = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                best, score = model.predict(texts)
                name = [model.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                score = np.where(letter, score, 0.0)
                low = score < model.threshold
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(name), pa.array(score), pa.array(low)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``df``.

    Only the text is read for a prediction. A null text or one without a letter is
    ``und`` with score 0, as is everything without a model. ``rejected``: the score is
    below the calibrated threshold. Of equally likely languages the first by name is taken.
    Very long texts are read whole; repeated rows agree; other columns are not read, so
    their names cannot clash; an empty table gives no rows.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(df.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
