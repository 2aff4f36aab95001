import random
import zlib

import numpy as np
import pyarrow as pa

from weftlink.llm import langid

PARTS = {"en": ["the", "and", "ing", "tion", "with", "er", "ou"], "de": ["der", "und", "ung", "sch", "keit", "ü", "ie"], "fr": ["le", "et", "eau", "tion", "qu", "é", "ou"]}


def corpus(r, n):
    out = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        out.append((i, " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([6, 30, 200]))), lang))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 800)
    df = spark.createDataFrame([(a, b, None if a % 50 == 0 else c) for a, b, c in rows], "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df)
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert all(got[a].held_out == held(a) for a, _, _ in rows)
    test = [x for x in rows if held(x[0])]
    assert sum(got[a].lang_pred == c for a, _, c in test) / len(test) > 0.97
    kept = [x for x in test if not got[x[0]].rejected]
    assert len(kept) > 0.8 * len(test) and sum(got[a].lang_pred == c for a, _, c in kept) / len(kept) > 0.98
    assert all(0 <= x.score <= 1 for x in got.values())


def test_noise_scores_low(spark):
    rows = corpus(random.Random(1), 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    _, p = model.predict(pa.array(["zzxq kkjv wwpx"] + [b for _, b, _ in rows[:50]]))
    assert p[0] < np.median(p[1:])


def test_batches_do_not_matter():
    r = np.random.default_rng(0)
    model = langid.Model(["a", "b"], r.normal(size=(langid.BUCKETS, 2)), np.zeros(2))
    texts = ["abc def", "", "x", "  ", "é", "abc"] * 3
    whole = model.logits(pa.array(texts))
    assert np.allclose(whole, np.concatenate([model.logits(pa.array([t])) for t in texts]))
    for t, z in zip(texts, whole, strict=True):
        at, v = langid.features(t)
        assert np.allclose(z, (model.table[at] * v[:, None]).sum(axis=0), atol=1e-5)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (3, "123 !?", "de"), (None, "the and the", "en"), (7, "der und", None)], "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train(df)).collect()
    assert len(got) == 6 and sum(x.lang_pred == "und" and x.score == 0 for x in got) == 4
    assert {x.lang_pred for x in langid.identify(df, langid.train(df.where("lang is null"))).collect()} == {"und"}
    assert langid.identify(df.limit(0), None).count() == 0


def test_rare_languages_are_learned(spark):
    r = random.Random(2)
    word = lambda lang: "".join(r.choice(PARTS[lang]) for _ in range(3))
    rows = [(i, " ".join(word("en") for _ in range(20)), "en") for i in range(900)] + [(1000 + i, " ".join(word("de") for _ in range(20)), "de") for i in range(24)]
    rows += [(5, "the same row again", "en")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    small = langid.Training(rows=60, epochs=10)
    model = langid.train(df, t=small)
    assert model.languages == ["de", "en"]
    best, _ = model.predict(pa.array([t for _, t, la in rows if la == "de"]))
    assert (best == 0).mean() > 0.9


def test_sample_against_plain_choice(spark):
    from pyspark.sql import functions as F

    from weftlink.llm.text import dealt_sample, shared_out

    assert shared_out({"a": 3, "b": 100, "c": 50}, 43) == {"a": 3, "c": 20, "b": 20}
    df = spark.createDataFrame([(k, i) for k, n in (("a", 500), ("b", 40), ("c", 3)) for i in range(n)] + [("a", 7)] * 200, "label string, i int").withColumn("h", F.shiftrightunsigned(F.xxhash64("label", "i"), 1))
    all_ = {(r.label, r.h) for r in df.collect()}
    got = {(r.label, r.h) for r in dealt_sample(df, "label", "h", 63, 9).collect()}
    least = lambda k, n: {(k, h) for h in sorted(h for x, h in all_ if x == k)[:n]}
    assert got == least("a", 30) | least("b", 30) | least("c", 3)
    assert {k for k, _ in ((r.label, r.h) for r in dealt_sample(df, "label", "h", 63, 2).collect())} == {"a", "b"}


def test_prediction_against_plain_sums(spark):
    rows = corpus(random.Random(3), 150)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    for x in langid.identify(df, model).collect()[:60]:
        at, v = langid.features(dict((a, b) for a, b, _ in rows)[x.doc_id])
        z = (model.table[at].astype(float) * v[:, None]).sum(axis=0) + model.bias
        p = np.exp(z / model.temperature)
        p /= p.sum()
        assert x.lang_pred == model.languages[int(p.argmax())] and abs(x.score - p.max()) < 1e-4 and x.rejected == (x.score < model.threshold)
