import random

import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_mixing, test_native, test_ngram_join
from weftlink.llm import mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, epoch string, n int"


def documents(r):
    word = lambda: f"{r.choice('abcdefgh')}word{r.randrange(3000)}"
    rows, k = [], 0
    for g in range(60):
        base = [word() for _ in range(r.randrange(20, 140))]
        for _ in range(r.choice([1, 1, 1, 2, 5])):
            w = list(base)
            if r.random() < 0.5:
                w[r.randrange(len(w))] = word()
            if g % 10 == 0:
                w[3:3] = ITEMS[g % len(ITEMS)][1].split()
            rows.append((k, " ".join(w), r.choice(["en", "de", None]), r.choice(["src0", "src1", None]), len(w), "kept", 1))
            k += 1
    return rows + [(900, None, "en", "src0", 0, None, None), (901, "", "en", None, 0, "x", 2), rows[3], rows[3], (None, next(x[1] for x in rows if x[4] >= 90), "en", "src0", 5, "y", 3), (None, " ".join(f"alone{i}" for i in range(80)), "en", "src0", 5, "y", 3), (None, "w " * 60, "en", "src1", 1, "z", 4)]


ITEMS = [(i, " ".join(f"item{i}x{j}" for j in range(20))) for i in range(3)]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame(documents(random.Random(8)), SCHEMA).repartition(4).write.parquet(f"{place}/documents.parquet")
    return place


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_one_by_one(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    r = quality_rules.Rules()

    kept = stages["quality_rules"](spark, docs, place)
    good = [x for x in rows(docs) if (m := test_native.measures(x[1]))[0] >= r.min_words and 100 * m[4] <= r.max_repeat_percent * m[0]]
    assert kept.columns == docs.columns and rows(kept) == good

    kept.write.mode("overwrite").parquet(f"{place}/kept")
    kept = spark.read.parquet(f"{place}/kept")
    single = stages["ngram_jaccard_join"](spark, kept, place)
    groups = {}
    for i, _, c in test_ngram_join.brute([(i, x[1]) for i, x in enumerate(good)], 5, 80):
        groups.setdefault(c, []).append(good[i])
    want = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    assert any(x[0] is None for x in good) and len(want) < len(good)
    assert single.columns == docs.columns and rows(single) == sorted(want, key=str)

    clean = stages["benchmark_decontamination"](spark, single, place)
    dirty = {(d, n) for d, n, _, _, bad in test_decontaminate.brute([(x[0], x[1]) for x in want], ITEMS) if bad}
    assert dirty and rows(clean) == sorted((x for x in want if (x[0], test_native.measures(x[1])[0]) not in dirty), key=str)

    mixed = stages["target_mixture"](spark, clean, place)
    left = rows(clean)
    assert mixed.columns == docs.columns and not set(rows(mixed)) - set(left)
    size = lambda x: len((x[1] or "").split())
    supply = {}
    for x in left:
        k = ("src" if x[3] else "", x[2] or "", x[3] or "")
        supply[k] = supply.get(k, 0) + size(x)
    given = test_mixing.budgets(supply, mixing.HALF, 0.5 * sum(supply.values()))
    for k, b in given.items():
        used = sum(size(x) for x in rows(mixed) if ("src" if x[3] else "", x[2] or "", x[3] or "") == k)
        assert used <= b and b - used < max(map(size, left)) + 1

    out = stages["sharding"](spark, mixed, place)
    assert sorted(str(x.doc_id) for x in out.collect()) == sorted(str(x[0]) for x in rows(mixed))


def test_run_is_the_stages_in_a_row_and_repeats(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, place).write.mode("overwrite").parquet(f"{place}/stage{i}")
        docs = spark.read.parquet(f"{place}/stage{i}")
    assert rows(corpus_pipeline.run(spark, place)) == rows(docs)


def test_empty_documents(spark, place, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{place}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
