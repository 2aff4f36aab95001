import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.plain import fuzzy as plain
from weftlink.operators import blocking, decide, features, keys, metrics, quality, splits
from weftlink.operators.records import RECORD, preprocess


def records(spark, rows):
    return preprocess(spark.createDataFrame(rows, RECORD))


@pytest.fixture(scope="module")
def small(spark):
    a = records(spark, [("S1-a", "Alpha Beta Ltd", "12 Oak Road, Town, State 12345", "X"), ("S1-b", "", "", "X")])
    t = records(spark, [("S2-a", "Alpha Beta Limited", "12 Oak Rd, Town, State 12345", "X"), ("S3-a", "Gamma Alpha", "9 Elm Lane, Other 99999", "X"), ("S3-z", "Zed", "1 Far Away", "Y")])
    return a, t


def test_keys_and_union(small):
    a, t = small
    f = keys.memory_families()
    got = {(r.anchor_id, r.target_id): r.blocking_rules for r in blocking.with_rules(blocking.candidates(keys.key_table(a, f), keys.key_table(t, f))).collect()}
    assert got[("S1-a", "S2-a")] == "country_name|city_name|postal|name_ngram|address|strong_name"
    assert set(got) == {("S1-a", "S2-a"), ("S1-a", "S3-a")}  # an anchor without name and address finds nothing


def test_wide_families(small):
    a, t = small
    for f in (keys.disk_families(), keys.supplement_families()):
        ids = {r.target_id for r in blocking.candidates(keys.key_table(a, f), keys.key_table(t, f)).collect()}
        assert "S2-a" in ids and "S3-z" not in ids
    k = [r.key for r in keys.key_table(a, keys.supplement_families()).collect()]
    assert "NP|x|alpha|beta" in k and "AN|x|12|oak" in k
    none = keys.key_table(a.withColumn("country_norm", F.lit("")), keys.supplement_families())
    assert none.count() == 0


def test_minhash_bands_meet_for_near_names(spark):
    df = spark.createDataFrame([("international business machines",), ("international business machine",), ("wholly other words",), ("",)], "v string")
    b = [set(r[0]) for r in df.select(keys.minhash_bands(F.col("v"), "n")).collect()]
    assert len(b[0]) == 8 and b[0] & b[1] and not b[0] & b[2] and not b[3]


def test_limits_are_strict_and_on_targets_only(spark):
    t = spark.createDataFrame([(f"t{i}", "A|k", 1) for i in range(3)] + [(f"t{i}", "B|k", 1) for i in range(4)] + [(f"t{i}", "N|k", 1) for i in range(6)], "entity_id string, key string, bit int")
    a = spark.createDataFrame([(f"a{i}", "A|k", 1) for i in range(50)], "entity_id string, key string, bit int")
    kept = blocking.limited(t, 3, {"N": 6})
    assert {r.key for r in kept.collect()} == {"A|k", "N|k"}
    assert blocking.candidates(a, kept).count() == 150
    assert {(r.key, r.n) for r in blocking.frequent_keys(t, 3).collect()} == {("B|k", 4), ("N|k", 6)}
    assert blocking.generic_limit(1000, 240, 20, 0.01) == 20 and blocking.generic_limit(10**6, 240, 20, 0.01) == 240


def pairs(spark, rows):
    return spark.createDataFrame(rows, "anchor_id string, target_id string, p double").withColumn("source", F.substring("target_id", 1, 2))


def greedy(rows, cap):
    taken, used, out = set(), {}, []
    for a, t, p in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if t in taken or cap and used.get((a, t[:2]), 0) >= cap:
            continue
        taken.add(t)
        used[(a, t[:2])] = used.get((a, t[:2]), 0) + 1
        out.append((a, t))
    return sorted(out)


@pytest.mark.parametrize(("seed", "cap"), [(1, 1), (2, 2), (3, 1)])
def test_capped_arbitration_is_greedy(spark, seed, cap):
    r = random.Random(seed)
    rows = list({(f"a{r.randrange(8)}", f"S{r.choice('23')}-{r.randrange(12)}"): r.randrange(6) / 5 for _ in range(70)}.items())
    rows = [(a, t, p) for (a, t), p in rows]
    got = sorted((x.anchor_id, x.target_id) for x in decide.arbitrated_capped(pairs(spark, rows), cap).collect())
    assert got == greedy(rows, cap)
    assert sorted((x.anchor_id, x.target_id) for x in decide.arbitrated(pairs(spark, rows)).collect()) == greedy(rows, 0)


@pytest.mark.parametrize(("settled", "cap"), [(0, 1), (0, 3), (25, 1), (25, 2)])
def test_capped_arbitration_in_rounds_and_in_order(spark, monkeypatch, settled, cap):
    """Both ways, and one after the other, with many ties."""
    monkeypatch.setattr(decide, "SETTLED", settled)
    r = random.Random(settled + cap)
    rows = [(a, t, r.randrange(4) / 3) for a, t in {(f"a{r.randrange(9)}", f"S{r.choice('23')}-{r.randrange(14)}") for _ in range(90)}]
    got = sorted((x.anchor_id, x.target_id) for x in decide.arbitrated_capped(pairs(spark, rows), cap).collect())
    assert got == greedy(rows, cap)


def test_capped_arbitration_of_a_chain_takes_no_round_for_each_link(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(decide, "checkpointed", lambda df: stored.append(df) or df.localCheckpoint())
    rows = [(f"a{(i + 1) // 2:02}", f"S2-{i // 2:02}", 1 - i / 100) for i in range(24)]
    got = sorted((x.anchor_id, x.target_id) for x in decide.arbitrated_capped(pairs(spark, rows), 1).collect())
    assert got == greedy(rows, 1) and len(stored) <= 4


def test_arbitration_comparison_ranks_no_pairs_below_the_threshold(spark, monkeypatch):
    seen, capped = [], decide.arbitrated_capped
    monkeypatch.setattr(decide, "arbitrated_capped", lambda x, cap: seen.append(x.agg({"p": "min"}).first()[0]) or capped(x, cap))
    r = random.Random(6)
    rows = [(a, t, r.randrange(10) / 10) for a, t in {(f"a{r.randrange(7)}", f"S{r.choice('23')}-{r.randrange(9)}") for _ in range(60)}]
    got = {x.policy: (x.n_pairs, x.n_targets) for x in decide.arbitration_comparison(pairs(spark, rows), 0.6).collect()}
    prob = {x[:2]: x[2] for x in rows}
    high = lambda x: [y for y in x if prob[y[:2]] >= 0.6]
    for name, kept in (("none", rows), ("target", greedy(rows, 0)), ("capped", greedy(rows, 1))):
        assert got[name] == (len(high(kept)), len({y[1] for y in high(kept)}))
    assert seen and min(seen) >= 0.6


def test_ties_and_margins(spark):
    x = pairs(spark, [("a", "S2-1", 0.9), ("b", "S2-1", 0.9), ("a", "S2-2", 0.8), ("a", "S2-3", 0.5), ("b", "S2-3", 0.4)])
    assert sorted((r.anchor_id, r.target_id) for r in decide.unique_owner(x).collect()) == [("a", "S2-2"), ("a", "S2-3")]
    assert sorted((r.anchor_id, r.target_id) for r in decide.arbitrated(x).collect()) == [("a", "S2-1"), ("a", "S2-2"), ("a", "S2-3")]
    gated = {(r.anchor_id, r.target_id): r.p for r in decide.margin_gate(x, 0.2).collect()}
    assert gated[("a", "S2-3")] == 0 and gated[("a", "S2-2")] == 0.8 and gated[("b", "S2-3")] == 0
    s = {r.target_id: (r.best, r.second, r.ties) for r in decide.owner_stats(x).collect()}
    assert s == {"S2-1": (0.9, 0.0, 2), "S2-2": (0.8, 0.0, 1), "S2-3": (0.5, 0.4, 1)}


def test_expected_f(spark):
    r = random.Random(4)
    rows = [(f"a{i}", f"S2-{i}-{j}", round(r.random() ** 2, 3)) for i in range(20) for j in range(r.randrange(1, 7))]
    want = []
    for a in {x[0] for x in rows}:
        own = sorted([x for x in rows if x[0] == a], key=lambda x: (-x[2], x[1]))
        total, none = sum(x[2] for x in own), 1.0
        for x in own:
            none *= 1 - x[2]
        best, at, s = none, 0, 0.0
        for k, x in enumerate(own, 1):
            s += x[2]
            if (v := 1.25 * s / (0.25 * total + k)) > best + 1e-12:
                best, at = v, k
        want += [(x[0], x[1]) for x in own[:at]]
    assert sorted((x.anchor_id, x.target_id) for x in decide.expected_f_cutoff(pairs(spark, rows)).collect()) == sorted(want)


def test_metrics_golden(spark):
    a = spark.createDataFrame([("a",), ("b",), ("c",)], "anchor_id string")
    truth = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("c", "t3")], "anchor_id string, target_id string")
    pred = spark.createDataFrame([("a", "t1")], "anchor_id string, target_id string")
    row = metrics.entity_report(pred, truth, a, 4).first()
    f = 1.25 * 1 * 0.5 / (0.25 + 0.5)
    assert row.f05 == round((f + 1) / 3, 6) and (row.tp, row.fp, row.fn) == (1, 0, 2) and row.singleton_accuracy == 1
    worse = metrics.entity_report(pred.union(spark.createDataFrame([("b", "t4")], "a string, b string")), truth, a, 4).first()
    assert worse.false_positive_rate == round(1 / 9, 6) and worse.singleton_accuracy == 0


def test_sweep_equals_single_reports(spark):
    r = random.Random(9)
    rows = [(f"a{r.randrange(15)}", f"t{r.randrange(40)}", r.randrange(11) / 10) for _ in range(120)]
    rows = list({(a, t): (a, t, p) for a, t, p in rows}.values())
    x = spark.createDataFrame(rows, "anchor_id string, target_id string, p double")
    truth = spark.createDataFrame([(f"a{i % 15}", f"t{i}") for i in range(0, 40, 2)], "anchor_id string, target_id string")
    a = spark.createDataFrame([(f"a{i}",) for i in range(18)], "anchor_id string")
    grid = metrics.memory_grid()
    assert grid[-1] > 1
    for s in metrics.threshold_sweep(x, truth, a, grid).collect()[::5]:
        one = metrics.entity_report(decide.thresholded(x, s.threshold), truth, a, 40).first()
        assert (s.precision, s.recall, s.f05) == (one.precision, one.recall, one.f05)


def test_thresholds_keep_their_exact_double(spark):
    x = spark.createDataFrame([(0.55,), (0.5500000000000002,)], "p double")
    assert decide.thresholded(x, 0.5500000000000002).count() == 1


def test_probability_report(spark):
    r = random.Random(2)
    rows = [(r.randrange(8) / 7, int(r.random() < 0.4)) for _ in range(150)]
    pos = [p for p, y in rows if y]
    neg = [p for p, y in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        above = [y for p, y in rows if p >= t]
        ap += sum(y for p, y in rows if p == t) / len(pos) * sum(above) / len(above)
    got = metrics.probability_report(spark.createDataFrame(rows, "p double, label int")).first()
    assert got.roc_auc == round(auc, 6) and got.average_precision == round(ap, 6)
    assert got.brier == round(sum((p - y) ** 2 for p, y in rows) / len(rows), 6)


def test_bootstrap(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, r.gauss(0.1, 1)) for i in range(400)], "i int, d double")
    m, lo, hi = metrics.bootstrap_interval(df, "d", rounds=300)
    assert lo < m < hi and 0.12 < hi - lo < 0.28
    assert metrics.bootstrap_interval(df.repartition(7), "d", rounds=300)[1:] == pytest.approx((lo, hi))


def test_features_are_never_null_and_missing_is_no_match(spark):
    a = records(spark, [("S1-a", "Alpha Clinic Company", "12 Oak Road 4444", "X"), ("S1-e", None, None, None)])
    t = records(spark, [("S2-a", "Alpha School Trust", "99 Oak Road 4444", "X"), ("S2-e", "", "", "")])
    p = spark.createDataFrame([(x, y, 3) for x in ("S1-a", "S1-e") for y in ("S2-a", "S2-e")], "anchor_id string, target_id string, mask int")
    g = features.gathered(p, a, t)
    groups = [features.base_features(), features.coarse_features(), features.veto_features(), features.enhanced_features(), features.evidence_set_features(), features.evidence_text_features(), features.detail_features()]
    for group in groups:
        for row in features.assembled(g, [group]).collect():
            assert all(v is not None and v == v for v in row)
    row = {(r.anchor_id, r.target_id): r for r in features.assembled(g, [features.base_features(), features.veto_features()]).collect()}
    assert row[("S1-e", "S2-e")].name_normalized_exact == 0 and row[("S1-e", "S2-e")].address_numeric_jaccard == 1
    x = row[("S1-a", "S2-a")]
    assert x.legal_type_conflict == 1 and x.category_conflict == 1 and x.address_number_conflict == 0 and x.primary_num_diff == 87
    assert len(features.base_features()) == 56 and len(features.coarse_features()) == 27 and len(features.veto_features()) == 14 and len(features.enhanced_features()) == 9 and len(features.detail_features()) == 42


def test_context_and_peers(spark):
    x = spark.createDataFrame([("a", "S2-1", 0.9), ("a", "S3-2", 0.9), ("a", "S2-3", 0.1), ("b", "S2-9", 0.4)], "anchor_id string, target_id string, p double")
    c = {r.target_id: r for r in features.context_features(x).collect()}
    assert c["S3-2"].probability_rank == 1 and c["S2-3"].probability_rank == 3 and c["S2-3"].others_above_0_5 == 2 and round(c["S2-1"].group_sum_others, 9) == 1.0
    t = records(spark, [(i, "Alpha Beta", "12 Oak Road", "X") for i in ("S2-1", "S3-2", "S2-3", "S2-9")])
    p = {r.target_id: r for r in features.peer_features(x, t).collect()}
    assert p["S2-1"].peer_other_source_joint == 0.9 and p["S2-1"].peer_same_source_joint == 0 and p["S2-9"].peer_max_probability == 0


def test_splits(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    s = splits.split(df, "k", {"fit": 0.6, "calibration": 0.2, "validation": 0.2}, 3)
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(n.values()) == 3000 and abs(n["fit"] - 1800) < 100 and abs(n["validation"] - 600) < 80
    assert sorted(splits.sample(df, "k", 10, 3).collect()) == sorted(splits.sample(df.repartition(5), "k", 10, 3).collect())
    assert splits.unused(df, splits.sample(df, "k", 10, 3), "k").count() == 2990


def test_quality(spark):
    df = spark.createDataFrame([("S1-1", "Alpha Ltd.", "1 Road", "X"), ("S1-2", "南国", None, ""), ("S1-2", "", "", "X"), ("S1-3", "Alpha Ltd.", "1 Road", "X")], RECORD)
    r = quality.profile(df).first()
    assert (r.n_rows, r.n_ids, r.n_repeated_ids, r.missing_business_name, r.missing_business_address, r.non_ascii_names, r.without_identifiers) == (4, 3, 1, 1, 2, 1, 1)
    assert tuple(quality.repeated_records(df).first()) == (1, 2)


def test_fallback_rank_and_indic_names(spark):
    a = records(spark, [("S1-a", "kamala", "", "X"), ("S1-b", "Beta Alpha", "9 Oak Road", "X")])
    t = records(spark, [("S2-a", "कमल", "9 Oak Road", "X"), ("S2-b", "Alpha Beta", "Oak Road 9", "X")])
    p = spark.createDataFrame([("S1-a", "S2-a", 1), ("S1-b", "S2-b", 1), ("S1-a", "S2-b", 1)], "anchor_id string, target_id string, mask int")
    g = features.gathered(p, a, t)
    got = {(r.anchor_id, r.target_id): r for r in g.select("anchor_id", "target_id", features.fallback_rank().alias("rank"), *[c.alias(k) for k, c in features.veto_features().items()]).collect()}
    x = got[("S1-a", "S2-a")]
    assert x.is_indic_target == 1 and x.indic_trans_ratio == 1 and x.phonetic_soundex_match == 1 and x.rank == 0
    name = plain.indel("beta alpha", "alpha beta")
    assert got[("S1-b", "S2-b")].rank == pytest.approx(1 + 0.35 * name)  # the address by its words, the name as it stands
    assert got[("S1-a", "S2-b")].rank == pytest.approx(plain.indel("kamala", "alpha beta"))


def test_guards(spark):
    x = spark.createDataFrame([("a", 0.5), ("b", None), ("c", float("nan")), ("d", 1.5), ("e", -0.1)], "target_id string, p double")
    assert {(r.fault, r.n) for r in decide.probability_faults(x).collect()} == {("null", 1), ("nan", 1), ("range", 2)}
    assert decide.thresholded(x.where("target_id = 'a'"), 0.5).count() == 1
    for bad in "bcde":
        with pytest.raises(Exception, match="no probability"):
            decide.thresholded(x.where(F.col("target_id") == bad), 0.2).collect()


@pytest.mark.parametrize("n", [12, 700])
def test_exact_splits(spark, n):
    df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("flag")).repartition(5)
    order = sorted((hashlib.md5(f"k{i}|9".encode()).hexdigest(), f"k{i}") for i in range(n))
    got = {r.k: r.place for r in splits.placed(df, "k", 9).collect()}
    assert got == {k: i for i, (_, k) in enumerate(order)}
    parts = [(r.split, r.flag) for r in splits.stratified(df, "k", F.col("flag"), 9).collect()]
    for flag, size in ((1, (n + 3) // 4), (0, n - (n + 3) // 4)):
        held = -(-size // 5)
        assert parts.count(("validation", flag)) == held and parts.count(("calibration", flag)) == -(-(size - held) // 4)
    dealt = splits.dealt(df, "k", {"a": 5, "b": 3}, 9)
    assert {r.k for r in dealt.where("split = 'b'").collect()} == {k for _, k in order[5:8]}
    assert splits.holdout(df, dealt, "k", 4, 1).join(dealt, "k").count() == 0


def test_too_few_to_split(spark):
    df = spark.range(9).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("f"))
    with pytest.raises(ValueError, match="ten"):
        splits.stratified(df, "k", F.col("f"), 1)
    one = spark.range(20).select(F.col("id").cast("string").alias("k"), (F.col("id") == 3).cast("int").alias("f"))
    assert splits.stratified(one, "k", F.col("f"), 1).where("split = 'validation'").count() == 4  # one flagged key: not stratified


def test_retrieval_of_all_rules(spark):
    a = records(spark, [("S1-a", "Alpha Beta Ltd", "12 Oak Road, Town, State 12345", "X"), ("S1-c", "Gammadelta", "", "")])
    t = records(spark, [("S2-a", "Alpha Beta Limited", "12 Oak Rd, Town, State 12345", "X"), ("S2-b", "Omega", "Oak Road", "X"), ("S2-c", "Gamadelta", "", "Y"), ("S3-z", "Zed", "1 Far Away", "Y")])
    got = {(r.anchor_id, r.target_id): r.blocking_rules for r in blocking.with_rules(blocking.memory_candidates(a, t, 4)).collect()}
    assert got[("S1-a", "S2-a")] == "country_name|city_name|postal|name_ngram|address|strong_name"
    assert ("S1-a", "S2-b") not in got  # one shared address word is not enough
    assert got[("S1-c", "S2-c")] == "name_ngram|strong_name" and len(got) == 2
