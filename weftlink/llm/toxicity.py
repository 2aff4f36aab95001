"""Toxicity with classifier chains.

One linear model for each category, in a stated order; each also sees the log odds that
the models before it give. Those are out-of-fold while training, so a later model learns
how far it can trust them. Features are the words of a whole text, present or not; each
model keeps the words that tell its category apart best. The fit uses a bounded sample of
the labelled rows on the driver; prediction reads all texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import tokens
from weftlink.llm.langid import column
from weftlink.llm.text import dealt_sample
from weftlink.session import checkpointed


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit; about ``rows`` labelled rows at most are used.

    They are dealt out to the combinations of labels in equal parts, so rare ones are learned
    from all their rows; of each text the ``distinct`` first words by hash count.
    """

    rows: int = 8000
    distinct: int = 5000
    words: int = 200
    #: Texts that a word must occur in, and standard errors by which its rates must differ.
    least_texts: int = 3
    least_z: float = 3.0
    folds: int = 5
    ridge: float = 1.0
    seed: int = 11


@dataclass
class Link:
    """One model of the chain: sorted word hashes, their weights, weights of earlier log odds, bias."""

    name: str
    words: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float
    threshold: float = 0.5


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def log_odds(self, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Rows: texts; columns: categories. ``h``, ``doc``: word hashes and the text of each."""
        out = np.zeros((n, len(self.links)))
        for j, link in enumerate(self.links):
            z = np.full(n, link.bias)
            if len(link.words) and len(h):
                at = np.minimum(np.searchsorted(link.words, h), len(link.words) - 1)
                hit = np.flatnonzero(link.words[at] == h)
                pair = np.unique(doc[hit] * len(link.words) + at[hit])
                z += np.bincount(pair // len(link.words), link.weights[pair % len(link.words)], n)
            out[:, j] = z + out[:, :j] @ link.chained
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and, last, the bias, which alone is not shrunk; Newton's method with halved steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * pull @ (w * w))

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), g)
        scale = 1.0
        while (new := loss(w - scale * step)) > now and scale > 1e-4:
            scale /= 2
        w = w - scale * step
        if now - new < 1e-6 * (1 + abs(now)):
            break
        now = new
    return w


def telling_words(sets: list[np.ndarray], y: np.ndarray, t: Training) -> np.ndarray:
    """The words whose rates in the two classes differ most, in standard errors."""
    words, inverse = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n = np.bincount(inverse, minlength=len(words)).astype(float)
    n1 = np.bincount(inverse, y[doc], len(words))
    pos, neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    p = np.clip(n / len(y), 1e-9, 1 - 1e-9)
    z = np.abs(n1 / pos - (n - n1) / neg) / np.sqrt(p * (1 - p) * (1 / pos + 1 / neg))
    z[n < t.least_texts] = 0
    best = np.argsort(-z, kind="stable")[: t.words]
    return np.sort(words[best[z[best] >= t.least_z]])


def design(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(words)))
    for i, s in enumerate(sets):
        if len(words) and len(s):
            at = np.minimum(np.searchsorted(words, s), len(words) - 1)
            x[i, at[words[at] == s]] = 1
    return x


def fit(names: list[str], sets: list[np.ndarray], labels: np.ndarray, t: Training = Training()) -> Chain:
    """A chain over ``names``; ``sets``: sorted distinct word hashes of each text, ``labels``: one column for each name.

    A category of one class only gets a constant model. The threshold of each category
    has the best F1 of the out-of-fold predictions.
    """
    fold = np.random.default_rng(t.seed).permutation(len(sets)) % t.folds
    before = np.zeros((len(sets), 0))
    chain = Chain()
    for j, name in enumerate(names):
        y = labels[:, j].astype(float)

        def model(rows: np.ndarray, y=y, before=before) -> tuple[np.ndarray, np.ndarray]:
            own = [sets[i] for i in rows]
            words = telling_words(own, y[rows], t)
            return words, logistic(np.hstack([design(own, words), before[rows]]), y[rows], t.ridge)

        if not len(y) or y.min() == y.max():
            p = (y.sum() + 0.5) / (len(y) + 1)
            chain.links.append(Link(name, np.zeros(0, np.uint64), np.zeros(0), np.zeros(j), float(np.log(p / (1 - p)))))
            before = np.hstack([before, np.full((len(sets), 1), chain.links[-1].bias)])
            continue
        out = np.zeros(len(y))
        for k in range(t.folds):
            rows, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if not len(rest):
                continue
            words, w = model(rows)
            out[rest] = np.hstack([design([sets[i] for i in rest], words), before[rest], np.ones((len(rest), 1))]) @ w
        order = np.argsort(-out, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        cut = int(f1.argmax())
        at = out[order][cut] if cut + 1 == len(y) else (out[order][cut] + out[order][cut + 1]) / 2
        words, w = model(np.arange(len(y)))
        chain.links.append(Link(name, words, w[: len(words)], w[len(words) : -1], float(w[-1]), float(1 / (1 + np.exp(-at)))))
        before = np.hstack([before, out[:, None]])
    return chain


def _word_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, body, offsets in tokens.chunks(texts):
        h, before, _, _ = tokens.hashed_words(body, offsets, tokens.ALNUM)
        for a, b in zip(before[:-1], before[1:], strict=True):
            yield np.unique(h[a:b])


def _examples(t: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s[: t.distinct].view(np.int64) for s in _word_sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), *batch.columns[1:]], names=["words", *batch.schema.names[1:]])

    return run


def train(df: DataFrame, labels: DataFrame, categories: Mapping[str, str], key: str = "doc_id", text: str = "text", t: Training = Training()) -> Chain:
    """A chain from the rows of ``df`` that ``labels`` names; ``categories``: an SQL condition on its columns for each.

    The sample (``dealt_sample``) is chosen by hashes of id and text among all labelled rows;
    repeated rows take one place in it. Ids without a text, texts without a label and null
    conditions are left out; an id with several labels counts with each.
    """
    names = list(categories)
    y = [f"_y{i}" for i in range(len(names))]
    known = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[F.expr(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories.values())]).dropna().distinct()
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where("_text is not null").withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(t.seed), "_key", "_text"), 1))
    marked = checkpointed(rows.select("_key", "h").join(known, "_key").withColumn("label", F.concat_ws(",", *y)))
    chosen = dealt_sample(marked, "label", "h", t.rows, 1 << min(len(names), 10))
    sample = checkpointed(marked.join(F.broadcast(chosen), ["label", "h"]).select("_key", "h", *y).distinct())
    texts = rows.join(F.broadcast(sample), ["_key", "h"]).groupBy("h", *y).agg(F.first("_text").alias("_text"))  # as bounded as the sample
    found = texts.select("_text", F.col("h").alias("id"), *y).mapInArrow(_examples(t), "words array<long>, id long, " + ", ".join(f"{c} int" for c in y)).toArrow()
    found = found.sort_by([("id", "ascending"), *[(c, "ascending") for c in y]])
    return fit(names, [w.view(np.uint64) for w in column(found, "words")], np.stack([found[c].to_numpy() for c in y], axis=1) if found.num_rows else np.zeros((0, len(names))), t)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch in batches:
            p = np.zeros((batch.num_rows, len(chain.links)))
            for first, end, body, offsets in tokens.chunks(batch.column(1)):
                h, before, _, _ = tokens.hashed_words(body, offsets, tokens.ALNUM)
                z = chain.log_odds(h, np.repeat(np.arange(end - first), np.diff(before)), end - first)
                p[first:end] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            arrays, names = [batch.column(0)], ["doc_id"]
            for j, link in enumerate(chain.links):
                arrays += [pa.array(p[:, j]), pa.array(p[:, j] >= link.threshold)]
                names += [f"p_{link.name}", link.name]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def predict(df: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, and p_<category> and <category> (over its threshold) for each, for every row of ``df``.

    Null and empty texts have no words and get what the biases give; very long texts are
    read whole. Repeated rows agree, and a probability equal to its threshold counts as over
    it; other columns are not read, so their names cannot clash; an empty table gives no rows.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}" + "".join(f", p_{x.name} double, {x.name} boolean" for x in chain.links)
    return rows.mapInArrow(_predictor(df.sparkSession.sparkContext.broadcast(chain)), schema)
