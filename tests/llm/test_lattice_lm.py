import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftlink.llm import lattice_lm
from weftlink.llm.lattice_lm import Lattice

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def forward(model, word):
    """Plain recursion over all segmentations."""
    byte = {p: q for p, q in zip(model.pieces, model.logp, strict=True) if isinstance(p, int)}
    whole = {p: q for p, q in zip(model.pieces, model.logp, strict=True) if not isinstance(p, int)}
    s = b" " + word.encode()
    a = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        terms = [a[i] + whole[s[i:j]] for i in range(max(0, j - 50), j) if s[i:j] in whole]
        if s[j - 1] in byte:
            terms.append(a[j - 1] + byte[s[j - 1]])
        a[j] = np.logaddexp.reduce(terms) if terms else -math.inf
    return a[-1]


def score_words(model, words):
    body = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(size)
    return model.forward(*lattice_lm.laid_out(body, ends - size, ends), np.ones(len(words)))


def test_forward_sums_all_segmentations():
    model = Lattice.of_model()
    words = ["the", "hello", "straße", "日本", "a", "zzqx", "▁odd", "réeuxment", "unbelievable"]
    total, expected = score_words(model, words)
    assert np.allclose(total, [forward(model, w) for w in words])
    toy = Lattice([b" a", b" ", b"a", b"ab", b"b", *[b for b in range(256) if b != 32]], np.log(np.full(260, 1 / 261)), math.log(1 / 261))
    total, expected = score_words(toy, ["ab"])
    # " a" or " " + "a" (piece or byte), then "b" (piece or byte); or " " + "ab"
    assert np.isclose(np.exp(total[0]), 2 / 261**2 + 4 / 261**3 + 1 / 261**2)
    assert np.isclose(expected[1], (4 / 261**3 + 1 / 261**2) / np.exp(total[0]))


def test_probabilities_sum_to_one():
    model = Lattice.of_model()
    for m in (model, model.reweighted(np.arange(len(model.pieces), dtype=float), 10)):
        assert np.isclose(np.exp(m.logp).sum() + np.exp(m.end), 1)


@pytest.mark.parametrize("table_size", [3_000_000, 20, 0])
def test_scores_against_plain_counts(spark, table_size):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(80)] + ["Été", "THE", "the"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(40)))) for i in range(80)] + [(500, None), (501, ""), (None, "the w1"), (3, "the odd one"), (502, "x" * 3000)]
    docs += [docs[5], docs[5]]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id long, text string, score double").repartition(3)
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c = Counter(t for d, x in docs if not out(d) for t in tokens_of(x))
    n, v = sum(c.values()), len(c)
    expected = sorted((str(d), out(d), len(t := tokens_of(x)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for d, x in docs)
    got = lattice_lm.score(df, table_size=table_size).collect()
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == expected
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    assert lattice_lm.score(df.limit(0)).count() == 0


def test_scores_against_plain_recursion(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice(["the", "thing", "Été", "on", "zz"]) for _ in range(r.randrange(1, 9)))) for i in range(30)] + [(99, None)]
    got = {x.doc_id: x for x in lattice_lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    prior = Lattice.of_model()
    train = [tokens_of(t)[:-1] for d, t in docs if not got[d].held_out]
    # expected pieces by differences of the plain recursion: the log probability's slope by a piece's log weight
    counts, step = Counter(w for t in train for w in t), 1e-5
    held = {i: p for i, p in enumerate(prior.pieces) if any(p in (b" " + w.encode()) if not isinstance(p, int) else p in b" " + w.encode() for w in counts)}
    expected = np.zeros(len(prior.pieces))
    for i in held:
        for sign in (1, -1):
            moved = prior.logp.copy()
            moved[i] += sign * step
            own = Lattice(prior.pieces[:0], np.zeros(0), 0.0)
            own.pieces, own.logp = prior.pieces, moved
            expected[i] += sign * sum(n * plain_small(own, w, held) for w, n in counts.items()) / (2 * step)
    model = prior.reweighted(expected, len(train))
    for d, t in docs:
        words = tokens_of(t)[:-1]
        for name, m in (("score", model), ("prior_score", prior)):
            want = (sum(plain_small(m, w, held) for w in words) + m.end) / math.log(10)
            assert getattr(got[d], name) == pytest.approx(want, abs=1e-3), (d, name)


def plain_small(model, word, held):
    """The plain recursion with only the pieces that words here contain."""
    byte = {p: model.logp[i] for i, p in held.items() if isinstance(p, int)}
    whole = {p: model.logp[i] for i, p in held.items() if not isinstance(p, int)}
    s = b" " + word.encode()
    a = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        terms = [a[i] + whole[s[i:j]] for i in range(j) if s[i:j] in whole]
        if s[j - 1] in byte:
            terms.append(a[j - 1] + byte[s[j - 1]])
        a[j] = np.logaddexp.reduce(terms) if terms else -math.inf
    return a[-1]


def test_training_helps_held_out_text(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice(["tion", "er", "an", "the", "ou"]) for _ in range(r.randrange(1, 4))) for _ in range(200)]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(60))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in lattice_lm.score(df).collect()}
    prior = Lattice.of_model()
    held = [(d, t) for d, t in docs if got[d].held_out]
    before = sum(sum(score_words(prior, t.split())[0]) + prior.end for _, t in held) / math.log(10)
    assert sum(got[d].score for d, _ in held) > before + 100
