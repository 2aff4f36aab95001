import random
import re

import pyarrow as pa
import pytest

from weftlink.llm import ngram_join, runs
from weftlink.llm.components import connected_components
from weftlink.llm.ngram_join import Join, linked_documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, n, percent):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(s), low.get(top(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def corpus(r, groups, edits):
    """Near copies of a few texts with word edits, cut ends, a common passage, and single texts."""
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(30)]
    docs, k = [], 0
    for size in groups:
        base = [word() for _ in range(r.randrange(30, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(edits + 1)):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = [word()]
            if r.random() < 0.15:
                w = w[: int(len(w) * r.uniform(0.6, 1))]
            if r.random() < 0.2:
                w = w + passage
            if r.random() < 0.1:
                w = [x.upper() for x in w]
            docs.append((k, " ".join(w)))
            k += 1
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "join"), [(1, Join(4, 85, hot=6, pivots=4)), (2, Join(4, 85)), (3, Join(3, 60, hot=4, pivots=3, table_size=300)), (4, Join(5, 80, hot=10, pivots=8, table_size=0))])
def test_against_brute_force(spark, seed, join):
    r = random.Random(seed)
    docs = corpus(r, [60, 30, 12, 5, 2, 2, *[1] * 20], 4)
    docs += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One TWO"), (905, "one"), (docs[0][0], docs[0][1]), (docs[0][0], "other words here now"), (None, docs[1][1]), (None, "alone as can be")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, key int, n int").repartition(5)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in linked_documents(df, join).collect()), key=str)
    assert got == brute(docs, join.n, join.percent)


def shared_passages(r, worlds):
    """Pairs of texts made of the same passages in another order, each passage in several other texts of its world."""
    docs = []
    for world in range(worlds):
        stock = [[f"p{world}x{i}x{j}" for j in range(12)] for i in range(36)]
        for _ in range(24):
            base = r.sample(stock, 6)
            for _ in range(2):
                w = [x for p in r.sample(base, 6) for x in [*p, f"s{len(docs)}x{r.random()}"]]
                w[r.randrange(len(w))] = f"e{len(docs)}"
                docs.append((len(docs), " ".join(w)))
    return docs


def test_pivot_without_a_centre_links_to_its_own_group(spark):
    docs = [(d, t) for d, t in shared_passages(random.Random(5), 149) if d // 48 in (60, 148)]  # worlds with such a pivot
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in linked_documents(spark.createDataFrame(docs, "doc_id long, text string"), Join(3, 60, hot=3, pivots=3)).collect()), key=str)
    assert got == brute(docs, 3, 60)


@pytest.mark.parametrize("join", [Join(2, 70, hot=3, pivots=2), Join(3, 80, hot=5, pivots=4, table_size=40)])
def test_short_texts_of_few_words(spark, join):
    """All n-grams are hot, and no set is large enough for a centre."""
    r = random.Random(9)
    docs = list({" ".join(r.choice("abc") for _ in range(r.randrange(3, 13))): None for _ in range(260)})
    docs = list(enumerate(docs))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in linked_documents(spark.createDataFrame(docs, "doc_id long, text string"), join).collect()), key=str)
    assert got == brute(docs, join.n, join.percent)


def test_a_passage_in_every_text_costs_one_entry_a_run():
    texts = [" ".join(f"p{i}" for i in range(40)) + f" own{k} words{k} here{k} too{k}" for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(300), pa.int64())], names=["text", "ref"])
    out = next(ngram_join._dealer(Join(4, 85), 4)(iter([batch])))
    grams = sum(len(runs.unpack(k)) for b, k in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True) if b < 4)
    counted = sum(len(runs.unpack(k)) for b, k in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True) if b >= 4)
    assert counted == 300 and grams <= 40 + 4 * 300
    met = list(ngram_join._met(4)(iter([out])))
    live = sorted(x for b in ngram_join._enough(iter(met)) for x in b.column(0).to_pylist())
    assert live == list(range(300))


def test_a_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(80_000))
    docs = [(1, long), (2, long + " more"), (3, "w1 w2 w3 w4 w5")]
    got = {x.doc_id: x.component_id for x in linked_documents(spark.createDataFrame(docs, "doc_id long, text string"), Join(4, 85)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    assert linked_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_random_graphs(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}
