"""Document likelihood under a subword lattice.

The pieces of an existing tokenizer vocabulary and its scores give a unigram model
over pieces. All segmentations of a word into pieces count: a forward recursion in log
space sums their probabilities. No piece spans two words, so the probability of a text
is the product over its words, and of the end.

The vocabulary orders its pieces by merge rank, which becomes a Zipf prior. One
expectation step over all training documents (forward and backward through every
distinct word of each run, weighted by its count) turns it into expected piece counts,
which with the prior give the probabilities that score. Byte pieces make every text
possible.

Word counts for the base score cover all training documents. The ``table_size`` most
frequent words are broadcast; tokens outside meet their counts in a shuffle join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import runs, tokens
from weftlink.session import checkpointed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The key of the end token; no word hashes to it but by chance.
END = tokens.mixed(np.array([0x5EED0FE7D], np.uint64))
#: Distinct words scored at once, and kept scores of one task.
WORDS, KEPT, HELD = 1 << 16, 1 << 20, 1 << 20
PIECE_RANGES = 64
#: Expected counts travel as whole numbers of this fraction, so that sums do not depend on their order.
FRACTION = 1 << 16


@dataclass
class Lattice:
    """Pieces as byte strings (a blank begins a word), their log probabilities, and the end's."""

    pieces: list[bytes]
    logp: np.ndarray
    end: float
    prefixes: np.ndarray = field(init=False)
    piece_of: np.ndarray = field(init=False)
    bytes_of: np.ndarray = field(init=False)
    place: tokens.Lookup = field(init=False)

    def __post_init__(self):
        found: dict[int, int] = {}
        self.bytes_of = np.full(256, -1)
        for i, p in enumerate(self.pieces):
            if isinstance(p, int):
                self.bytes_of[p] = i
                continue
            h = np.add.accumulate(tokens._BYTE[np.frombuffer(p, np.uint8)] * tokens.powers(256)[: len(p)])
            for j, x in enumerate(h.tolist()):
                if j == len(p) - 1:
                    found[x] = i
                else:
                    found.setdefault(x, -1)
        self.prefixes = np.array(sorted(found), np.uint64)
        self.piece_of = np.array([found[x] for x in self.prefixes.tolist()], np.int64)
        self.place = tokens.Lookup(self.prefixes)

    @classmethod
    def of_model(cls, path: str = VOCABULARY) -> Lattice:
        """Zipf weights by the rank that the scores give; byte pieces weigh as the last rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, rank = [], []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                if (b := int(model.id_to_piece(i)[3:-1], 16)) != 0x20:
                    pieces.append(b)
                    rank.append(model.get_piece_size())
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = model.id_to_piece(i).replace("▁", " ")
                if " " not in text[1:] and not any(c in text[1:] for c in "\t\n\x0b\x0c\r"):
                    pieces.append(text.encode())
                    rank.append(-model.get_score(i))
        weight = 1 / (10 + np.array(rank))
        return cls(pieces, np.log(weight / weight.sum() * 0.998), float(np.log(0.002)))

    def reweighted(self, expected: np.ndarray, ends: float, prior: float = 1000.0) -> Lattice:
        """Expected counts plus ``prior`` pseudo-counts dealt as the current probabilities."""
        p = expected + prior * np.exp(self.logp)
        e = ends + prior * np.exp(self.end)
        total = p.sum() + e
        return Lattice(self.pieces, np.log(p / total), float(np.log(e / total)))

    def edges(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start node, end node, piece, word) of all pieces in words laid end to end; a word of n bytes has n + 1 nodes."""
        word = np.repeat(np.arange(len(begin)), size)
        limit = np.repeat(begin + size, size)
        at, h = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        one = self.bytes_of[flat]
        keep = one >= 0
        starts, sizes, found = [at[keep]], [np.ones(int(keep.sum()), np.int64)], [one[keep]]
        length = 0
        while len(at):
            inside = at + length < limit[at]
            at, h = at[inside], h[inside]
            h = h + tokens._BYTE[flat[at + length]] * tokens.powers(256)[length]
            length += 1
            where, known = self.place(h)
            at, h, piece = at[known], h[known], self.piece_of[where[known]]
            whole = piece >= 0
            starts.append(at[whole])
            sizes.append(np.full(len(starts[-1]), length))
            found.append(piece[whole])
        start = np.concatenate(starts)
        of = word[start]
        return start + of, start + of + np.concatenate(sizes), np.concatenate(found), of

    def _pass(self, value: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """value[target] = log sum exp(value[source] + weight), step by step."""
        order = np.argsort(step * (len(value) + 1) + target)
        source, target, weight, step = source[order], target[order], weight[order], step[order]
        cuts = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step)).tolist()
        first = np.append(True, target[1:] != target[:-1])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            begin = np.flatnonzero(first[lo:hi] | (np.arange(hi - lo) == 0))
            value[target[lo:hi][begin]] = np.logaddexp.reduceat(value[source[lo:hi]] + weight[lo:hi], begin)

    def scores(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
        """Log probabilities of words under several weights of the pieces; the lattice is laid out once."""
        if not len(begin):
            return [np.zeros(0) for _ in weights]
        s, e, piece, of = self.edges(flat, begin, size)
        node, out = begin + np.arange(len(begin)), []
        for logp in weights:
            alpha = np.full(len(flat) + len(begin), -np.inf)
            alpha[node] = 0
            self._pass(alpha, s, e, logp[piece], e - node[of])
            out.append(alpha[node + size])
        return out

    def forward(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word; with ``count``, also the expected number of each piece."""
        if not len(begin):
            return np.zeros(0), None if count is None else np.zeros(len(self.pieces))
        s, e, piece, of = self.edges(flat, begin, size)
        node = begin + np.arange(len(begin))  # the first node of each word
        w = self.logp[piece]
        alpha = np.full(len(flat) + len(begin), -np.inf)
        alpha[node] = 0
        self._pass(alpha, s, e, w, e - node[of])
        total = alpha[node + size]
        if count is None:
            return total, None
        beta = np.full(len(alpha), -np.inf)
        beta[node + size] = 0
        self._pass(beta, e, s, w, node[of] + size[of] - s)
        share = np.exp(alpha[s] + w + beta[e] - total[of]) * count[of]
        return total, np.bincount(piece, share, len(self.pieces))


def laid_out(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words [start, end) of ``body``, each after a blank, end to end; where each begins; its size."""
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()), 0x20, np.uint8)
    place = np.arange(len(flat)) - np.repeat(begin, size)
    inner = place > 0
    flat[inner] = body[(np.repeat(starts, size) + place - 1)[inner]]
    return flat, begin, size


def blocks_of(starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of words in blocks of similar length, each of bounded size."""
    order = np.argsort(ends - starts, kind="stable")
    filled = np.cumsum((ends - starts)[order] + 1)
    while len(order):
        n = max(1, min(WORDS, int(np.searchsorted(filled, 8 * WORDS, "right"))))
        yield order[:n]
        order, filled = order[n:], filled[n:] - filled[n - 1]


def held_out_ids(ids: pa.Array) -> np.ndarray:
    """Whether crc32 of the id as text leaves remainder 0 by 10; null counts as empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids.to_pylist()], bool)


def _gather(lattice, buckets: int):
    """Runs of word counts of the training documents, and expected piece counts by piece range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Lattice = lattice.value
        counter, expected = runs.Counter(64, buckets), np.zeros(len(model.pieces))
        held: list[tuple[np.ndarray, ...]] = []  # words seen so far, each worth one look whatever its count
        size = 0

        def learn() -> pa.RecordBatch | None:
            nonlocal held, size
            if not held:
                return None
            flat, key, count, n = (np.concatenate([x[i] for x in held]) for i in range(4))
            held, size = [], 0
            begin = np.cumsum(n) - n
            keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(inverse, count).astype(np.int64)
            for block in blocks_of(begin[first], begin[first] + n[first]):
                at = first[block]
                expected[:] += model.forward(*laid_out(flat, begin[at], begin[at] + n[at]), total[block])[1]
            return counter.add(keys, total)

        for batch in batches:
            texts = batch.column(1).filter(pa.array(~held_out_ids(batch.column(0))))
            if not len(texts):
                continue
            out = counter.add(END, np.array([len(texts)]))
            if out is not None:
                yield out
            for _, _, body, offsets in tokens.chunks(texts, 4 * tokens.CHUNK):
                body = tokens.LOWER[body]
                h, _, starts, ends = tokens.hashed_words(body, offsets, tokens.NON_BLANK, lower=False)
                keys, first, count = np.unique(h, return_index=True, return_counts=True)
                n = ends[first] - starts[first]
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                held.append((body[np.repeat(starts[first], n) + place], keys, count, n))
                size += len(keys)
                out = learn() if size >= HELD else None
                if out is not None:
                    yield out
        for out in (learn(), counter.flush()):
            if out is not None:
                yield out
        if expected.any():
            parts = np.array_split(np.rint(expected * FRACTION).astype(np.int64), PIECE_RANGES)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in range(PIECE_RANGES)], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([b""] * PIECE_RANGES, pa.binary())], names=["bucket", "keys", "counts"])

    return run


@dataclass
class WordCounts:
    """The most frequent words: sorted keys and counts; words below ``cut`` are elsewhere unless cut is 1."""

    keys: np.ndarray
    counts: np.ndarray
    cut: int
    total: int
    distinct: int

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, score double, prior_score double, rest array<long>"


def _scorer(shared):
    """Scores of whole texts; ``rest`` has the tokens whose counts are not in the broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, prior, prior_end, words = shared.value
        known_h, known_p = np.zeros(0, np.uint64), np.zeros((0, 2))
        for batch in batches:
            n_tokens, n_known, base, score, first_score, rest = [], [], [], [], [], []
            for _, _, body, offsets in tokens.chunks(batch.column(1)):
                body = tokens.LOWER[body]
                h, before, starts, ends = tokens.hashed_words(body, offsets, tokens.NON_BLANK, lower=False)
                docs = len(before) - 1
                keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                p = np.full((len(keys), 2), np.nan)
                if len(known_h):
                    at = np.minimum(np.searchsorted(known_h, keys), len(known_h) - 1)
                    hit = known_h[at] == keys
                    p[hit] = known_p[at[hit]]
                new = np.flatnonzero(np.isnan(p[:, 0]))
                for block in blocks_of(starts[first[new]], ends[first[new]]):
                    i = new[block]
                    p[i] = np.stack(model.scores(*laid_out(body, starts[first[i]], ends[first[i]]), [model.logp, prior]), axis=1)
                if len(new):
                    if len(known_h) + len(new) > KEPT:
                        known_h, known_p = keys, p
                    else:
                        both = np.concatenate([known_h, keys[new]])
                        order = np.argsort(both)
                        known_h, known_p = both[order], np.concatenate([known_p, p[new]])[order]
                # the end token follows each text
                keys = np.append(keys, END)
                c = np.zeros(len(keys), np.int64)
                if len(words.keys):
                    at = np.minimum(np.searchsorted(words.keys, keys), len(words.keys) - 1)
                    c = np.where(words.keys[at] == keys, words.counts[at], 0)
                later = (c == 0) & (words.cut > 1)
                value = np.where(later, 0, words.log10(c))
                row = np.repeat(np.arange(docs), np.diff(before))
                add = lambda v: np.bincount(row, v[inverse], docs) if len(row) else np.zeros(docs)  # noqa: E731, B023
                n_tokens += (np.diff(before) + 1).tolist()
                n_known += (add((c > 0)[:-1].astype(float)) + (c[-1] > 0)).astype(int).tolist()
                base += (add(value[:-1]) + value[-1]).tolist()
                score += ((add(p[:, 0]) + model.end) / np.log(10)).tolist()
                first_score += ((add(p[:, 1]) + prior_end) / np.log(10)).tolist()
                mask = later[:-1][inverse]
                left, lows = h[mask].view(np.int64), np.append(0, np.cumsum(mask))[before]
                for a, b in zip(lows[:-1].tolist(), lows[1:].tolist(), strict=True):
                    rest.append(left[a:b] if not later[-1] else np.append(left[a:b], END.view(np.int64)))
            arrays = [batch.column(0), pa.array(held_out_ids(batch.column(0))), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(first_score, pa.float64()), pa.array(rest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "prior_score", "rest"])

    return run


def score(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, table_size: int = 3_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, prior_score) for every row of ``df``.

    ``prior_score`` weighs segmentations by the vocabulary's own scores alone, ``score`` by
    what one expectation step over the training documents makes of them.

    Documents whose crc32(id as text) mod 10 is 0 are held out; a null id counts as
    empty text. Null and empty texts are the end token alone. Repeated rows score alike.
    Very long texts are scored whole. Other columns are not read, so their names cannot
    clash. Of an empty table there are no rows; without training
    documents all counts are 0 and the prior scores.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prior = Lattice.of_model(vocabulary)
    found = docs.mapInArrow(_gather(spark.sparkContext.broadcast(prior), 1 << (2 * parts - 1).bit_length()), runs.SCHEMA)
    merged = checkpointed(found.repartition(parts, "bucket").mapInArrow(runs.merger(1), runs.SCHEMA))
    expected = {r["bucket"]: np.frombuffer(r["keys"], np.int64) / FRACTION for r in merged.where("bucket < 0").collect()}
    hist = runs.totals(merged)
    keys, counts, cut = runs.top(merged, hist, table_size, 1)
    total, distinct = sum(s for _, _, s in hist), sum(n for _, n, _ in hist)
    words = WordCounts(keys, counts, cut, total, distinct)
    model = prior
    if expected:
        at = np.searchsorted(keys, END[0])
        ends = float(counts[at]) if at < len(keys) and keys[at] == END[0] else 0.0
        model = prior.reweighted(np.concatenate([expected[-1 - i] for i in range(PIECE_RANGES)]), ends)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(_scorer(spark.sparkContext.broadcast((model, prior.logp, prior.end, words))), SCORED.format(id=kind))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", "prior_score"]
    if cut == 1:
        return scored.select(*columns)
    scored = checkpointed(scored).withColumn("row", F.monotonically_increasing_id())  # of a written table, so it is the same each time
    left = scored.select("row", F.explode("rest").alias("key")).join(runs.exploded(merged, cut), "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_row = left.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("more"), F.sum(F.log10((F.col("c") + 0.1) / (total + 0.1 * (distinct + 1)))).alias("sum"))
    whole = scored.drop("rest").join(of_row, "row", "left")
    return whole.withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "base": F.col("base") + F.coalesce("sum", F.lit(0.0))}).select(*columns)
