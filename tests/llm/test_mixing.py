import random

import pytest
from pyspark.sql import functions as F

from weftlink.llm import mixing
from weftlink.llm.mixing import Mixture

LEVELS = {"domain": "domain", "lang": "lang", "source": "source"}


def budgets(supply, mixture, total):
    """Plain filling, one node after another: what the levels of the tables must equal."""
    weight = lambda p: max(0.0, mixture.weights.get(p, mixture.default))
    nodes = {leaf[:d] for leaf in supply for d in range(len(leaf) + 1)}
    below = {n: sorted(c for c in nodes if c[: len(n)] == n and len(c) == len(n) + 1) for n in nodes}

    def room(n):
        if n and weight(n) == 0:
            return 0
        return sum(map(room, below[n])) if below[n] else supply[n] * mixture.max_epochs

    out = {}

    def deal(n, budget):
        if not below[n]:
            out[n] = budget
            return
        open_, left, given = [c for c in below[n] if room(c) > 0], min(budget, room(n)), {c: 0 for c in below[n]}
        while open_:
            mass = sum(map(weight, open_))
            full = [c for c in open_ if left * weight(c) / mass >= room(c)]
            for c in full or open_:
                given[c] = room(c) if full else left * weight(c) / mass
            left -= sum(given[c] for c in full)
            open_ = [c for c in open_ if c not in full] if full else []
        for c, b in given.items():
            deal(c, b)

    deal((), total)
    return out


def by_tables(spark, supply, mixture, total):
    names = [f"l{i}" for i in range(len(next(iter(supply))))]
    df = spark.createDataFrame([(*k, n) for k, n in supply.items()], ", ".join(f"{c} string" for c in names) + ", n long")
    return {tuple(r[c] for c in names): r.budget for r in mixing.leaf_budgets(df, names, mixture, total).collect()}


def test_siblings_before_ancestors(spark):
    supply = {("web", "en", "a"): 10, ("web", "en", "b"): 1000, ("web", "de", "c"): 100, ("books", "en", "d"): 1000}
    got = by_tables(spark, supply, Mixture({("web",): 1, ("books",): 1, ("web", "en"): 3, ("web", "de"): 1}), 800)
    assert got == pytest.approx({("web", "en", "a"): 10, ("web", "en", "b"): 290, ("web", "de", "c"): 100, ("books", "en", "d"): 400})
    # a subtree that lacks tokens passes the rest up
    got = by_tables(spark, supply, Mixture({("books",): 0}), 2000)
    assert sum(v for k, v in got.items() if k[0] == "web") == pytest.approx(1110) and got[("books", "en", "d")] == 0


def test_a_branch_of_weight_zero_is_no_supply(spark):
    supply = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    got = by_tables(spark, supply, Mixture({("a", "y"): 0}), 1000)
    assert got == pytest.approx({("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 990})


@pytest.mark.parametrize("seed", [0, 1])
def test_budgets_of_any_tree(spark, seed):
    r = random.Random(seed)
    supply = {(r.choice("ab"), r.choice("cde"), f"h{r.randrange(40)}"): r.choice((0, 5, 5, r.randrange(1, 3000))) for _ in range(60)}
    weights = {k[:d]: r.choice((0, 0.5, 3)) for k in supply for d in (1, 2, 3) if r.random() < 0.3}
    for share in (0.3, 1.0):
        m = Mixture(weights, max_epochs=1 + seed % 3)
        total = share * sum(supply.values())
        assert by_tables(spark, supply, m, total) == pytest.approx(budgets(supply, m, total), abs=1e-6)


def rows(r, n):
    out = []
    for i in range(n):
        out.append((i, " ".join("w" for _ in range(r.randrange(0, 30))), r.choice(["web", "web", "books"]), r.choice(["en", "de", None]), f"s{r.randrange(3)}"))
    return out


@pytest.mark.parametrize(("share", "epochs", "bits", "keep"), [(0.5, 1, 8, None), (0.3, 1, 1, ["doc_id", "lang"]), (1.4, 3, 8, None)])
def test_against_plain_selection(spark, monkeypatch, share, epochs, bits, keep):
    monkeypatch.setattr(mixing, "RANGE_BITS", bits)
    data = rows(random.Random(3), 300)
    data += [(7, "x y z", "web", "en", "s0")] * 40  # equal rows, which the budget may part
    df = spark.createDataFrame(data, "doc_id long, text string, domain string, lang string, source string").repartition(4)
    m = Mixture({("web",): 3, ("web", "en"): 2}, share=share, max_epochs=epochs)
    size, leaf = (lambda x: len(x[1].split())), (lambda x: (x[2], x[3] or "", x[4]))
    supply = {}
    for x in data:
        supply[leaf(x)] = supply.get(leaf(x), 0) + size(x)
    ids = {tuple(r)[:5]: r.id for r in df.select("*", F.xxhash64(*df.columns).alias("id")).collect()}
    expected = []
    for k, b in budgets(supply, m, share * sum(supply.values())).items():
        own = [x for x in data if leaf(x) == k]
        whole = int(b / supply[k] + 1e-9) if supply[k] else 0
        rest = int(b - whole * supply[k] + 1e-6)
        expected += [(x[0], e) for x in own for e in range(whole)]
        order = {r.id: r.u for r in spark.createDataFrame([(ids[x],) for x in own], "id long").select("id", mixing._order(F.col("id"), m.seed, F.lit(whole)).alias("u")).collect()}
        used = 0
        for x in sorted(own, key=lambda x: order[ids[x]]):
            used += size(x)
            if used > rest:
                break
            if rest:
                expected.append((x[0], whole))
    got = mixing.mix(df, LEVELS, m, keep=keep)
    assert got.columns == [*(keep or df.columns), "epoch", "n_tokens"]
    assert sorted((x.doc_id, x.epoch) for x in got.collect()) == sorted(expected)


def test_shares_are_met(spark):
    df = spark.createDataFrame([(i, "w " * 10, "web", la, "s") for i, la in enumerate(["en"] * 600 + ["de"] * 300)], "doc_id long, text string, domain string, lang string, source string")
    got = mixing.mix(df, LEVELS, Mixture({("web", "en"): 1, ("web", "de"): 1}, share=0.5)).groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()
    assert {x.lang: x.n for x in got} == {"en": 2250, "de": 2250}


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "a", None, None, 9), (1, None, "a", None, None, 9), (None, "", "a", "x", "y", 1), (2, "b c", "a", "x", "y", 1)], "doc_id long, text string, domain string, lang string, source string, epoch int")
    assert mixing.mix(df, LEVELS, Mixture(share=1.0)).columns == ["doc_id", "text", "domain", "lang", "source", "epoch", "n_tokens"]
    assert mixing.mix(df, LEVELS, Mixture(share=1.0)).where("doc_id = 2").count() == 1
    assert mixing.mix(df.limit(0), LEVELS).count() == 0
