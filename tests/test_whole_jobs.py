"""Jobs over all pairs that send few rows out of their cells: the results are those of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from weftlink.operators import cells, decide, pairwise
from weftlink.operators import features as feat
from weftlink.plans import binding as B
from weftlink.plans import queries

SF = "/root/testdata/sf0.001"


def _side(rng, prefix, n):
    word = lambda: "".join(rng.choice("abé") + rng.choice("ou") for _ in range(rng.randint(1, 9)))
    text = lambda top: pa.array([" ".join(word() for _ in range(rng.randint(0, top))) for _ in range(n)], pa.string())
    return pa.table({"entity_id": pa.array([f"{prefix}{i}" for i in range(n)]), "name": text(3), "address_norm": text(7), "country_norm": pa.array([rng.choice(["x", "y", ""]) for _ in range(n)])})


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_sure_pairs_are_those_of_all_scores(least):
    rng = random.Random(7)
    a, t = _side(rng, "S1-", 60), _side(rng, "S2-", 80)
    x, y = (v.ravel() for v in np.divmod(np.arange(60 * 80), 80))
    p, sure = pairwise.mean_similarity(a, t)(x, y)["p"], pairwise.sure_similarity(least)(a, t)(x, y)
    assert (sure[pairwise.KEPT] == (p >= least)).all() and (sure["p"][p >= least] == p[p >= least]).all()
    ids = [a["entity_id"].combine_chunks(), t["entity_id"].combine_chunks()]
    sent = [r for b in cells._batches(ids, [x], [y], [x], pairwise.sure_similarity(least)(a, t)) for r in b.to_pylist()]
    assert {(r["anchor_id"], r["target_id"]): r["p"] for r in sent} == {(f"S1-{i}", f"S2-{j}"): v for i, j, v in zip(x, y, p, strict=True) if v >= least} and 0 < len(sent) < len(x)


def test_comparison_of_arbitrations_stores_no_scores(spark, monkeypatch):
    monkeypatch.setattr(B, "_stored", {})
    got = sorted(map(tuple, queries.arbitration_comparison(spark, SF).collect()))
    assert not [k for k in B._stored if k[2] in ("scored", "pairs")]
    assert got == sorted(map(tuple, decide.arbitration_comparison(B.scored(spark, SF), 0.6).collect()))


@pytest.mark.parametrize("few, dense", [(64, 1 << 24), (2, 0)])
def test_evidence_of_cells_is_that_of_joins(few, dense, spark, monkeypatch):
    monkeypatch.setattr(pairwise, "FEW", few)
    monkeypatch.setattr(pairwise, "DENSE", dense)
    rng = random.Random(11)
    words = ["kilo", "mira", "clinic", "the", "12", "012", "98765", "0"]
    rows = lambda prefix, n: spark.createDataFrame([(f"{prefix}{i}", *(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in "na"), rng.choice(["x", "y", ""])) for i in range(n)], "entity_id string, name_norm string, address_norm string, country_norm string")
    a, t = rows("S1-", 15).localCheckpoint(), rows("S2-", 25).where("country_norm <> 'z'").localCheckpoint()
    t = t.unionByName(spark.createDataFrame([("S2-z", "kilo far", "12 mira", "z")], t.schema))
    stats = feat.corpus_stats(a)
    names = [*feat.IDF, *feat.evidence_set_features()]
    sides = [feat.with_evidence(x, stats, own).withColumn("name", F.col("name_norm")).toArrow() for x, own in ((a, True), (t, False))]
    n, m = (s.num_rows for s in sides)
    x, y = np.divmod(np.arange(n * m), m)
    found = pairwise.evidence_features(*sides)(x, y)
    assert list(found) == names
    ids = [s["entity_id"].to_pylist() for s in sides]
    got = {(ids[0][i], ids[1][j]): values for i, j, *values in zip(x, y, *found.values(), strict=True)}
    pairs = a.select(F.col("entity_id").alias("anchor_id")).crossJoin(t.select(F.col("entity_id").alias("target_id")))
    g = feat.idf_features(feat.gathered(pairs, a, t, ["name_norm", "address_norm", "country_norm"]), stats)
    rows = g.select("anchor_id", "target_id", *[F.round(c, 6) for c in feat.IDF], *[F.round(c, 6) for c in feat.evidence_set_features().values()]).collect()
    assert len(rows) == len(got) == n * m
    for r in rows:
        assert got[r[0], r[1]] == pytest.approx(list(r[2:]), abs=1.01e-6)


def test_evidence_moves_no_pair(spark, monkeypatch):
    monkeypatch.setattr(B, "_stored", {})
    plan = queries.evidence_features(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0] and not [k for k in B._stored if k[2] == "pairs"]


def test_context_of_packed_lists_is_that_of_windows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"S1-{i}", f"S2-é{j}" * rng.randint(0, 3), round(rng.choice([0.0, 1.0, 0.5, 0.675, rng.random()]), 6)) for i in range(9) for j in range(rng.randint(1, 12))]
    ids = [pa.array([f"S1-{i}" for i in range(9)]), pa.array([t for _, t, _ in rows])]
    x, y = np.array([int(a[3:]) for a, _, _ in rows]), np.arange(len(rows))
    measure = lambda _, c: {"p": np.array([rows[k][2] for k in c])}
    half = len(rows) // 2 + 1
    batches = [b for k in (slice(half, None), slice(0, half)) for b in cells._packed(ids, [x[k]], [y[k]], [x[k]], measure)]
    monkeypatch.setattr(cells, "ROWS", 10)
    sent = [r for b in cells.unpacked(iter(batches), pairwise.context) for r in zip(*b.to_pydict().values(), strict=True)]
    df = feat.context_features(spark.createDataFrame(rows, "anchor_id string, target_id string, p double"))
    expected = sorted(map(tuple, df.select("anchor_id", "target_id", *[F.round(c, 6) for c in pairwise.CONTEXT]).collect()))
    assert len(sent) == len(expected) == len(rows) and not list(cells.unpacked(iter([]), pairwise.context))
    for got, e in zip(sorted(sent), expected, strict=True):
        assert got[:2] == e[:2] and got[2:] == pytest.approx(e[2:], abs=1.01e-6)


def test_context_stores_no_scores_and_ranks_no_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "_stored", {})
    df = queries.context_features(spark, SF)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString() and not [k for k in B._stored if k[2] == "scored"]
    B.scored(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, queries.context_features(spark, SF).collect()))
