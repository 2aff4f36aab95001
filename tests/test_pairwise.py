"""Measures of pairs in cells: the same as text by text."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

from weftlink.functions import fuzzy
from weftlink.operators import cells, pairwise


def _texts(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé\U0001d11e ") for _ in range(rng.choice((0, 1, 5, 30, 63, 64, 65, 66, 90, 130)))) for _ in range(n)]


def _pairs(a, t):
    x, y = np.divmod(np.arange(len(a) * len(t)), len(t))
    return x, y


def test_distances_of_rows_are_those_of_texts(monkeypatch):
    a, t = _texts(1), _texts(2)
    x, y = _pairs(a, t)
    left, right = [a[i] for i in x], [t[i] for i in y]
    distance, common = fuzzy.levenshtein(left, right).tolist(), fuzzy.lcs(left, right).tolist()
    for size in (1 << 14, 37):
        monkeypatch.setattr(pairwise, "PAIRS", size)
        of = pairwise.Texts(pa.chunked_array([a]), pa.chunked_array([t]))
        assert of.levenshtein(x, y).tolist() == distance and of.lcs(x, y).tolist() == common


def test_rounding_is_that_of_decimal_text():
    v = [0.0, 1.0, 0.0078125, -0.0078125, 0.0000005, 1 / 3, 2 / 3, 1e-9, 123456.7890125, *(i / j for i in range(1, 40) for j in (64, 96, 128, 640, 7))]
    assert pairwise.rounded(np.array(v)).tolist() == [float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in v]


def test_cells_have_tasks_of_their_own(spark):
    numbers = cells.numbers(32)
    df = spark.createDataFrame([(n,) for n in numbers], "cell int").repartition(32, "cell")
    assert df.rdd.glom().map(len).collect() == [1] * 32
    assert cells.blocks(40_000, 80_000, 8) == (4, 8)


def test_features_of_cells_are_those_of_columns(spark):
    """Words, repeated and blank, in texts that may be empty, against the column expressions."""
    from pyspark.sql import functions as F

    from weftlink.operators import features as feat

    rng = random.Random(4)
    text = lambda: rng.choice(["", " ".join(rng.choice(["ab", "b", "é", "", "cab"]) for _ in range(rng.choice((1, 3, 9)))), " ".join(str(rng.randrange(99)) for _ in range(80))])
    fields = ("business_name", "business_address", "name_norm", "address_norm", "country_norm", "postal_code", "city", "state", "street_number")
    rows = [[text() for _ in fields] for _ in range(24)]
    left, right = ([(f"{s}{i}", *r) for i, r in enumerate(part)] for s, part in (("a", rows[:12]), ("t", rows[8:])))
    a, t = (spark.createDataFrame(r, ["entity_id", *fields]) for r in (left, right))
    pairs = a.select(F.col("entity_id").alias("anchor_id")).crossJoin(t.select(F.col("entity_id").alias("target_id")))
    wanted = feat.text_features() | feat.component_features()
    expected = {(r[0], r[1]): r[2:] for r in feat.gathered(pairs, a, t).select("anchor_id", "target_id", *[F.round(c, 6).alias(k) for k, c in wanted.items()]).collect()}
    tables = [pa.table({f: [r[1 + i] for r in rows] for i, f in enumerate(fields)}).append_column("name", pa.array([r[3] for r in rows])) for rows in (left, right)]
    x, y = _pairs(left, right)
    got = pairwise.text_features(*tables)(x, y) | pairwise.component_features(*tables)(x, y)
    assert list(got) == list(wanted)
    for k, (i, j) in enumerate(zip(x, y, strict=True)):
        assert tuple(v[k] for v in got.values()) == tuple(expected[f"a{i}", f"t{j}"])


def test_best_window_is_that_of_all_windows():
    """Texts beyond a machine word too, against every window."""
    a, b = _texts(5, 40), _texts(6, 40)
    b[:10] = [x[3:] + "xy" + x[:7] for x in a[:10]]
    for x, y, got in zip(a, b, fuzzy.partial(a, b).tolist(), strict=True):
        s, t = (x, y) if len(x) <= len(y) else (y, x)
        windows = [t[max(0, k) : k + len(s)] for k in range(1 - len(s), len(t))] if s else []
        assert got == max((2.0 * fuzzy._by_integer(s, w) / (len(s) + len(w)) for w in windows if w), default=0.0)
    x, y = np.array([[1, 2, 3]]), np.array([[9, 1, 2, 7, 3]])
    assert fuzzy._first_starts(x, y).tolist() == [[1, 0, 0, 4, 0]]  # by one pass, not window by window


def test_similarities_of_cells_are_those_of_texts():
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["ab", "b", "é", "cab", "12", "street"]) + str(rng.randrange(3)) * rng.randrange(2) for _ in range(rng.choice((0, 1, 2, 5, 9, 60))))
    a, t = [text() for _ in range(30)], [text() for _ in range(30)]
    x, y = _pairs(a, t)
    left, right = [a[i] for i in x], [t[i] for i in y]
    s = pairwise.Similar(pa.chunked_array([a]), pa.chunked_array([t]))
    ratio, ordered, sets = s.indel(x, y), s.token_sort(x, y), s.token_set(x, y)
    assert ratio.tolist() == fuzzy.indel(left, right).tolist() and ordered.tolist() == fuzzy.token_sort(left, right).tolist()
    assert sets.tolist() == fuzzy.token_set(left, right).tolist()
    assert s.weighted(x, y, ratio, ordered, sets).tolist() == fuzzy.weighted(left, right).tolist()


def _records(spark, seed, prefix):
    rng = random.Random(seed)
    words = lambda *w: " ".join(rng.choice(w) for _ in range(rng.choice((0, 1, 3, 8))))
    rows = [(f"{prefix}-{i}", words("foo", "bar", "services", "abcdef", "ltd", "kphnn", "food"), words("007", "12", "street", "0", "12a", "way", "99 b1"), rng.choice(["", "x", "y"])) for i in range(12)]
    return spark.createDataFrame(rows, "entity_id string, name_norm string, address_norm string, country_norm string")


def _compared(spark, made, groups, measure, prepared=lambda g: g):
    """Measures of a cell and column expressions over the same pairs."""
    from pyspark.sql import functions as F

    from weftlink.operators import features as feat

    a, t = _records(spark, 8, "S1"), _records(spark, 9, "S3")
    pairs = a.select(F.col("entity_id").alias("anchor_id")).crossJoin(t.select(F.col("entity_id").alias("target_id"))).withColumn("mask", F.lit(3))
    wanted = groups()
    g = prepared(feat.gathered(pairs, a, t))
    expected = {(r[0], r[1]): r[2:] for r in g.select("anchor_id", "target_id", *[F.round(c.cast("double"), 6).alias(k) for k, c in wanted.items()]).collect()}
    tables = [made(x).withColumn("name", F.col("name_norm")).toArrow() for x in (a, t)]
    x, y = _pairs(*(v["entity_id"].to_pylist() for v in tables))
    got = measure(*tables)(x, y)
    assert list(got) == list(wanted)
    for k, (i, j) in enumerate(zip(x, y, strict=True)):
        assert tuple(v[k] for v in got.values()) == tuple(expected[tables[0]["entity_id"][i].as_py(), tables[1]["entity_id"][j].as_py()])


def test_details_of_cells_are_those_of_columns(spark):
    from pyspark.sql import functions as F

    from weftlink.operators import features as feat

    counts = feat.corpus_stats(_records(spark, 8, "S1").unionByName(_records(spark, 8, "S2")))[0]
    more = {f"detail_{s}_name_frequency": F.col(f"detail_{s}_name_frequency") for s in ("left", "right")}
    _compared(spark, lambda x: feat.with_own_frequency(feat.with_details(x), counts), lambda: feat.detail_features() | more, pairwise.detail_features, lambda g: feat.detail_frequencies(g, counts))


def test_coarse_features_of_cells_are_those_of_columns(spark):
    from weftlink.functions import constants as C
    from weftlink.operators import features as feat

    _compared(spark, feat.with_runs, lambda: {k: v for k, v in feat.coarse_features().items() if k not in C.RULES}, pairwise.coarse_features)


def test_enhanced_features_of_cells_are_those_of_columns(spark):
    from weftlink.operators import features as feat

    _compared(spark, feat.with_conflicts, feat.enhanced_features, pairwise.enhanced_features)
