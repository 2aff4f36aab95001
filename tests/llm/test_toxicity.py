import random

import numpy as np
import pytest
from weftlink.llm import tokens, toxicity


def make(r, n):
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(5, 200))]
        toxic, rude = r.random() < 0.15, r.random() < 0.2
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot,", "Scum", "moron"]))
        if rude:
            words.append(r.choice(["damn", "heck"]))
        rows.append((i, " ".join(words), int(toxic), int(rude)))
    return rows


def test_held_out_accuracy_and_chain(spark):
    rows = make(random.Random(2), 1500)
    df = spark.createDataFrame([(a, b, 0.5) for a, b, _, _ in rows], "doc_id long, text string, p_toxic double").repartition(3)
    labels = spark.createDataFrame([(a, c, d) for a, _, c, d in rows if a < 900] + [(9999, 1, 1), (None, 0, 0), (5, None, 1)], "doc_id long, toxic int, rude int")
    chain = toxicity.train(df, labels, {"rude": "rude = 1", "toxic": "toxic = 1", "both": "toxic = 1 and rude = 1"})
    assert [x.name for x in chain.links] == ["rude", "toxic", "both"] and len(chain.links[2].chained) == 2
    assert (chain.links[2].chained > 0).all()
    got = {x.doc_id: x for x in toxicity.predict(df, chain).collect()}
    held = [x for x in rows if x[0] >= 900]
    right = [sum(got[a][name] == bool(v) for a, v in pairs) / len(held) for name, pairs in (("toxic", [(x[0], x[2]) for x in held]), ("rude", [(x[0], x[3]) for x in held]), ("both", [(x[0], x[2] * x[3]) for x in held]))]
    assert min(right) > 0.95


def test_logistic_against_gradient():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3))
    y = (x @ [1, -2, 0.5] + r.normal(size=200) > 0).astype(float)
    w = toxicity.logistic(x, y, 1.0)
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert np.abs(np.append(x.T @ (p - y) + w[:3], (p - y).sum() + 1e-3 * w[3])).max() < 1e-2


def test_prediction_against_a_plain_chain(spark):
    rows = make(random.Random(5), 300)
    df = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(a, c, d) for a, _, c, d in rows], "doc_id long, toxic int, rude int")
    chain = toxicity.train(df, labels, {"rude": "rude = 1", "toxic": "toxic = 1"})
    got = {x.doc_id: x for x in toxicity.predict(df, chain).collect()}
    for a, text, _, _ in rows:
        own, odds = set(tokens.hash_list([w.strip(",").lower() for w in text.split()]).tolist()), []
        for link in chain.links:
            z = link.bias + sum(w for h, w in zip(link.words.tolist(), link.weights, strict=True) if h in own) + sum(x * y for x, y in zip(odds, link.chained, strict=True))
            odds.append(z)
            p = 1 / (1 + np.exp(-z))
            assert got[a][f"p_{link.name}"] == pytest.approx(p) and got[a][link.name] == (got[a][f"p_{link.name}"] >= link.threshold)


def test_repeated_rows_take_one_place(spark):
    rows = make(random.Random(7), 200) + [(3, "one row many times", 0, 0)] * 400
    df = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list({(a, c, d) for a, _, c, d in rows[:200]}), "doc_id long, toxic int, rude int")
    chain = toxicity.train(df, labels, {"toxic": "toxic = 1"}, t=toxicity.Training(rows=150))
    assert len(chain.links[0].words) < 200 and toxicity.predict(df, chain).count() == 600


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(df, labels, {"toxic": "toxic = 1"})
    assert toxicity.predict(df, chain).count() == 4
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.predict(df.limit(0), toxicity.train(df, one, {"toxic": "toxic = 1"})).count() == 0


@pytest.mark.parametrize("n", [1, 5])
def test_present_words_count_once(n):
    h = tokens.hash_list(["scum"])
    chain = toxicity.Chain([toxicity.Link("toxic", h, np.array([2.0]), np.zeros(0), -1.0)])
    assert chain.log_odds(np.repeat(h, n), np.zeros(n, int), 1)[0, 0] == 1.0
