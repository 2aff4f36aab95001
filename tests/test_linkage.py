from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftlink.operators import blocking, features, metrics, models, splits
from weftlink.operators.records import preprocess
from weftlink.plans import linkage, queries, rerank
from weftlink.sources import demo as clinics
from weftlink.sources import tables
from weftlink.streaming import scoring


@pytest.fixture(scope="module")
def demo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("demo"))
    clinics.make_demo(root, 90)
    return root


def test_sources(spark, demo):
    a, t = tables.load_sources(spark, demo, "train")
    assert a.count() == 90 and a.columns == ["entity_id", "business_name", "business_address", "country"]
    truth = tables.load_truth(spark, f"{demo}/train/train_ground_truth.tsv", a, t)
    assert 60 < truth.count() < 140 and truth.groupBy("target_id").count().where("count > 1").isEmpty()
    with pytest.raises(FileNotFoundError):
        tables.load_sources(spark, demo, "absent")
    with pytest.raises(ValueError, match="wrong prefix"):
        tables.read_source(spark, f"{demo}/train/train_source2.tsv", 1)
    with pytest.raises(ValueError, match="unknown anchors"):
        tables.load_truth(spark, f"{demo}/train/train_ground_truth.tsv", a.limit(5), t)


def test_literal_na_and_empty_files(spark, tmp_path):
    f = tmp_path / "x.tsv"
    f.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tNA\t\t007\n')
    row = tables.read_source(spark, str(f), 2).first()
    assert tuple(row) == ("S2-1", "NA", "", "007")
    f.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n")
    assert tables.read_source(spark, str(f), 2).count() == 0


def test_id_lists(spark):
    df = spark.createDataFrame([('["S2-a", "S2-b"]',), ("S2-a, S3-b",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(tables.parsed_ids(F.col("c"))).collect()] == [["S2-a", "S2-b"], ["S2-a", "S3-b"], [], []]


def test_end_to_end(spark, demo, tmp_path):
    a, t = (preprocess(x).cache() for x in tables.load_sources(spark, demo, "train"))
    truth = tables.load_truth(spark, f"{demo}/train/train_ground_truth.tsv", a, t)
    anchors = a.select(F.col("entity_id").alias("anchor_id"))
    s = linkage.Settings(limit=50, k=8, trees=4, depth=3, rank_trees=3, kinds=("logistic", "boosting"))
    pairs = linkage.retrieve(a, t, s)
    assert truth.join(pairs, ["anchor_id", "target_id"], "left_anti").count() <= 4
    chosen = linkage.select_model(spark, a, t, truth, s)
    assert len(chosen.rows) == 4 and 0 <= chosen.threshold <= 1.01 and len(chosen.features) == 81
    assert chosen.recall[-1][2] >= chosen.recall[0][2] > 0.5
    chosen.save(spark, str(tmp_path / "chosen"))
    chosen = linkage.Chosen.load(spark, str(tmp_path / "chosen"))
    assert chosen.kind == "logistic" or chosen.importances()[0][1] > 0
    matches, scored = linkage.link(a, t, chosen, s)
    assert metrics.entity_report(matches, truth, anchors, t.count()).first().f05 > 0.7
    m, c = tables.match_lists(matches, anchors), tables.match_lists(scored, anchors, "candidate_entity_ids", by=None)
    assert tables.submission_faults(m, c, anchors, t).isEmpty()
    path = str(tmp_path / "m.tsv")
    for _ in range(2):  # the second run replaces the first
        tables.write_lists(m, path, tables.in_order(spark, f"{demo}/train/train_source1.tsv"))
    lines = open(path).read().splitlines()
    source = [x.split("\t")[0] for x in open(f"{demo}/train/train_source1.tsv").read().splitlines()[1:]]
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == source
    assert dict(x.split("\t") for x in lines[1:]) == dict(map(tuple, m.collect()))


def test_rerank(spark, demo):
    a, t = (preprocess(x).cache() for x in tables.load_sources(spark, demo, "train"))
    truth = tables.load_truth(spark, f"{demo}/train/train_ground_truth.tsv", a, t)
    s = linkage.Settings(limit=50, k=8)
    pairs = linkage.cut(linkage.retrieve(a, t, s), a, t, None, s)
    names = list(features.text_features())
    x = blocking.labelled(features.assembled(features.gathered(pairs, a, t), [features.text_features()], names), truth)
    ids = a.select(F.col("entity_id").alias("anchor_id")).join(truth.select("anchor_id").distinct().withColumn("_t", F.lit(1)), "anchor_id", "left")
    x = x.join(splits.stratified(ids, "anchor_id", F.col("_t"), 3).drop("_t"), "anchor_id")
    meta = rerank.meta_features(x.withColumn("p", F.col("name_jaccard_similarity").cast("double")), a, t)
    assert len(meta.columns) == 2 + 13 + 22 + 44 and meta.count() == pairs.count()
    rows = rerank.stacked(x, names, a, t, truth, depths=(3,), trees=2, base_depth=3)[1]
    assert [r[1] for r in rows] == [0.25, 0.5, 0.75, 1.0] and all(0 <= r[4] <= 1 for r in rows)


def test_settings():
    s = linkage.Settings.load('{"limit": 9, "kinds": ["forest"]}')
    assert s.limit == 9 and linkage.Settings.load(s.dump()).k == s.k
    with pytest.raises(ValueError, match="unknown"):
        linkage.Settings.load('{"limits": 9}')
    with pytest.raises(ValueError, match="range"):
        linkage.Settings(k=0)


def test_faults_are_found(spark):
    a = spark.createDataFrame([("S1-1",), ("S1-2",)], "anchor_id string")
    t = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    m = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S3-1"), ("S1-9", "S2-1, S3-1")], "source1_entity_id string, matched_entity_ids string")
    c = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-7")], "source1_entity_id string, candidate_entity_ids string")
    found = {r.fault for r in tables.submission_faults(m, c, a, t).collect()}
    assert found == {"matches: anchors without a row", "matches: rows of unknown anchors", "matches: anchors with several rows", "matches: cells not in canonical form", "matches: repeated ids", "candidates: unknown ids", "matches that are no candidates"}


def test_candidate_order(spark, tmp_path):
    f = tmp_path / "c.tsv"
    f.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-9,S2-1\nS1-2\t\n")
    assert sorted(map(tuple, tables.read_candidates(spark, str(f)).collect())) == [("S1-1", "S2-1", 1), ("S1-1", "S3-9", 0)]


def test_calibration_and_stacking(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 10 < 8, F.col("id") % 2).otherwise(1 - F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3).alias("fold"))
    oof = models.out_of_fold("logistic", df, ["x"])
    assert oof.count() == 400
    slope, offset = models.calibration(oof)
    p = models.calibrated(oof, slope, offset)
    assert abs(p.agg(F.avg("p")).first()[0] - 0.5) < 0.05
    assert models.calibration(oof.where("label = 1")) == (1.0, 0.0)
    assert models.promoted((0.1, 0.01, 0.2)) and not models.promoted((0.1, -0.01, 0.2))
    assert spark.range(1).select(models.blend([F.lit(0.2), F.lit(0.8)], [1, 3])).first()[0] == pytest.approx(0.65)


def test_scoring_resumes(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "out")
    score = lambda b: b.withColumn("p", F.col("id") / 10)
    seen = []
    for n, total in ((100, 100), (50, 150), (0, 150)):
        if n:
            spark.range(len(seen), len(seen) + n).write.mode("append").parquet(source)
            seen += range(n)
        scoring.score_incrementally(spark, source, place, score, {"v": 1})
        assert scoring.scores(spark, place).count() == total
    with pytest.raises(ValueError, match="other settings"):
        scoring.score_incrementally(spark, source, place, score, {"v": 2})


@pytest.mark.parametrize("name", ["coarse_features", "fuzzy_pairs", "enhanced_features", "evidence_text_features", "detail_features", "full_base_features", "veto_features_full", "evidence_features", "peer_features"])
def test_features_of_all_candidates(spark, name):
    sf = "/root/testdata/sf0.001"
    pair = lambda x: sorted(tuple(r) for r in x.select("anchor_id", "target_id").collect())
    want = pair(queries.QUERIES["blocking_union_mask"](spark, sf))
    assert max(Counter(a for a, _ in want).values()) > 8
    assert pair(queries.QUERIES[name](spark, sf)) == want


def test_disk_candidates_of_keys_below_the_limit(spark):
    """A name of 300 targets: more than 240, less than 5 x 240; and a word of as many."""
    a = preprocess(spark.createDataFrame([("S1-1", "blue steel", "", "X")], "entity_id string, business_name string, business_address string, country string"))
    t = preprocess(spark.createDataFrame([(f"S2-{i}", "blue steel", "", "X") for i in range(300)], "entity_id string, business_name string, business_address string, country string"))
    found = linkage.retrieve(a, t, linkage.Settings())
    assert found.count() == 300 and {r.mask for r in found.collect()} == {32}


def test_terms_come_from_all_targets(spark, monkeypatch):
    monkeypatch.setattr(splits, "sample", lambda df, *_: df.limit(1))
    side = lambda rows: spark.createDataFrame([(i, n, n) for i, n in rows], "entity_id string, name_norm string, address_norm string")
    idf = linkage.fit_terms(side([("S1-1", "ab")]), side([("S2-1", "cd"), ("S2-2", "ef"), ("S3-1", "gh")]), linkage.Settings())
    assert {r.term for r in idf["name"].collect()} == {r.term for r in idf["address"].collect()} == {"ab", "cd", "ef", "gh"}


def test_ranker_sees_half_of_the_anchors_and_is_measured_on_the_rest(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "fit", lambda kind, train, *_, **__: seen.append(train.select("anchor_id").distinct().count()))
    monkeypatch.setattr(models, "predict", lambda _, df: df.withColumn("p", F.lit(1.0)))
    pairs = spark.range(6000).select(F.concat(F.lit("S1-"), "id").alias("anchor_id"), F.concat(F.lit("S2-"), "id").alias("target_id"))
    _, recall = linkage.fit_ranker(pairs, pairs, pairs.select("anchor_id"), linkage.Settings())
    assert seen == [3000] and {found for _, found, _ in recall} == {3000}


def test_ranker_features_are_worked_out_once_in_cells(spark, monkeypatch):
    a, t = queries.B.sides(spark, "/root/testdata/sf0.001")
    pairs = linkage.retrieve(a, t, linkage.Settings()).cache()
    key = ("anchor_id", "target_id")
    want = features.assembled(features.gathered(pairs, a, t), [features.coarse_features()], keep=("mask",))
    rows = lambda df: {tuple(r[k] for k in key): r for r in df.collect()}
    got, expected = rows(linkage.coarse(pairs, a, t)), rows(want)
    assert got.keys() == expected.keys() and len(got) > 100 and linkage.coarse(pairs, a, t).columns == want.columns
    assert all(list(map(float, got[k][2:])) == pytest.approx(list(map(float, expected[k][2:])), abs=1e-6) for k in got)
    calls, coarse = [], linkage.coarse
    monkeypatch.setattr(linkage, "coarse", lambda *x: calls.append(1) or coarse(*x))
    monkeypatch.setattr(linkage, "fit_ranker", lambda *_: (True, []))
    monkeypatch.setattr(linkage, "fit_terms", lambda *_: {})
    monkeypatch.setattr(models, "predict", lambda _, df: df.withColumn("p", F.lit(1.0)))
    monkeypatch.setattr(linkage, "rich", lambda *_: 1 // 0)  # the selection ends here
    with pytest.raises(ZeroDivisionError):
        linkage.select_model(spark, a, t, queries.B.truth(spark, "/root/testdata/sf0.001"))
    assert calls == [1]


def test_rich_features_are_worked_out_in_cells(spark):
    a, t = queries.B.sides(spark, "/root/testdata/sf0.001")
    pairs = linkage.retrieve(a, t, linkage.Settings()).cache()
    groups = linkage.rich_groups()
    names = [n for g in groups for n in g if not n.endswith("tfidf_cosine")]
    got = linkage.rich(pairs, a, t, {}, linkage.Settings(features=names))
    want = features.assembled(features.gathered(pairs, a, t), groups, names)
    rows = lambda df: {tuple(r[:2]): list(map(float, r[2:])) for r in df.collect()}
    x, y = rows(got), rows(want)
    assert got.columns == want.columns and x.keys() == y.keys() and len(x) > 100
    assert [(k, n, p, q) for k in x for n, p, q in zip(names, x[k], y[k], strict=True) if abs(p - q) > 1e-6 * max(1, abs(q))] == []
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()


def test_class_weights_need_no_scores(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    x = blocking.labelled(queries.B.scored(spark, sf), queries.B.truth(spark, sf))
    want = models.weighted(x).groupBy("label", F.round("weight", 6)).count().collect()
    monkeypatch.setattr(queries.B, "scored", lambda *_: 1 // 0)
    assert sorted(map(tuple, queries.class_weights(spark, sf).collect())) == sorted(map(tuple, want)) and len(want) == 2
