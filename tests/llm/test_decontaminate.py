import random
import re

import numpy as np
import pytest

from weftlink.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=13):
    listed = {k: WORD.findall((t or "").translate(LOW)) for k, t in items}
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, names = set(), set()
        for name, x in listed.items():
            n = min(window, len(x))
            for i in range(len(x) - n + 1) if n else []:
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(name))
        out.append((doc_id, len(w), len(hit), ",".join(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 8, 1 << 22])
def test_against_brute_force(spark, monkeypatch, bits):
    for name in ("MIN_FILTER", "MAX_FILTER"):  # the small one lets most windows pass
        monkeypatch.setattr(decontaminate, name, bits)
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["Été", "Straße", "x9"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 13, 14, 30])))) for i in range(8)] + [(77, ""), (78, None), (10, "w1, w2! W3")]
    docs = []
    for d in range(60):
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 20, 90]))]
        if d % 3 == 0:
            words[5:5] = (items[r.randrange(8)][1] or "").split()
        docs.append((d, r.choice([" ", ", ", "\n", "–"]).join(words)))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (None, "w1 w2 w3")]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in docs], "doc_id long, text string, n_words int, _hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(df, bench).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, ",".join(x["items"]), x.contaminated) for x in got), key=str) == brute(docs, items)
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not x[-1] for x in brute(docs, items))


def test_longest_match_and_place(spark):
    words = [f"a{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    df = spark.createDataFrame([(1, "zz yy " + " ".join(words[3:23]) + " qq")], "doc_id long, text string")
    row = decontaminate.scan(df, bench).first()
    assert row.longest == 20 and [(m.item, m.item_at, m["at"], m.length) for m in row.matches] == [("1", 3, 2, 20)]


def test_suffix_array():
    r = random.Random(2)
    for n in (1, 2, 7, 300):
        x = np.array([r.randrange(3) for _ in range(n)])
        assert decontaminate.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_all_longest_runs():
    r = random.Random(8)
    word = lambda k: np.array([r.randrange(4) for _ in range(k)])
    regions, items = [word(r.randrange(1, 40)) for _ in range(12)], [(x, min(3, len(x))) for x in (word(r.choice((1, 2, 3, 9, 25))) for _ in range(9))]
    want = []
    for a, x in enumerate(regions):
        for b, (y, n) in enumerate(items):
            for i in range(len(y) - n + 1):
                for j in range(len(x) - n + 1):
                    if i and j and y[i - 1] == x[j - 1]:
                        continue
                    k = 0
                    while i + k < len(y) and j + k < len(x) and y[i + k] == x[j + k]:
                        k += 1
                    if k >= n:
                        want.append((a, b, i, j, k))
    assert sorted(decontaminate.matches(regions, items)) == want and len(want) > 50


def test_places_in_a_long_text_and_repeated_passages(spark):
    words = [f"a{i}" for i in range(30)]
    text = " ".join(["x"] * 30_000 + words + ["y"] * 5 + words[2:20] + ["z"] * 30_000)
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:]))], "item_id long, text string")
    df = spark.createDataFrame([(i, text) for i in range(3)] + [(9, " ".join(words))], "doc_id long, text string")
    got = {x.doc_id: x for x in decontaminate.scan(df, bench).collect()}
    assert got[0].n_hit == 48 and got[0].n_words == 60_053 and not got[0].contaminated and got[9].contaminated
    assert [(m.item, m.item_at, m["at"], m.length) for m in got[2].matches] == [("1", 0, 30_000, 30), ("1", 2, 30_035, 18), ("2", 0, 30_005, 25), ("2", 0, 30_038, 15)]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.scan(df, bench.limit(0)).first().n_hit == 0
    assert decontaminate.scan(df.limit(0), bench).count() == 0
