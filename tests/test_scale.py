"""Plans and partial results that large tables of pairs rest on."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftlink.operators import blocking, cells
from weftlink.operators.keys import BIT
from weftlink.plans import binding as B
from weftlink.plans import queries


def test_true_ones_among_pairs(spark):
    pairs = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2)], "anchor_id string, target_id string, mask int")
    truth = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "anchor_id string, target_id string")
    assert [tuple(r) for r in blocking.among(pairs, truth).collect()] == [("a", "x")]
    assert [tuple(r) for r in blocking.missed_pairs(pairs, truth).collect()] == [("b", "y")]
    report = {r.rule: (r.n_pairs, r.n_true) for r in blocking.rule_report(pairs, truth).collect()}
    assert report.pop("combined") == (3, 1) and sorted(report.values()) == [(2, 1), (2, 1)]


def test_pairs_that_are_read_once_are_not_stored(spark):
    sf = "/root/testdata/sf0.001"
    B._stored.pop((spark.sparkContext.applicationId, sf, "pairs"), None)
    rows = B.found(spark, sf).agg(F.count("*")).first()[0]
    assert (spark.sparkContext.applicationId, sf, "pairs") not in B._stored
    assert rows == B.pairs(spark, sf).count() == B.found(spark, sf).count()


def test_pairs_that_share_nothing_take_no_room():
    """Records with a key of their own, and two that share one: no table of all anchors and targets is laid out."""
    n = 3000
    row = lambda side, i: {"anchor": side, "entity_id": f"{side:d}{i}", "name": "", "grams": 0, "keys": [f"T|{side if i else 2:d}{i}"], "bits": [BIT["country_name"]], "hot": []}
    schema = pa.schema([("anchor", pa.bool_()), ("entity_id", pa.string()), ("name", pa.string()), ("grams", pa.int32()), ("keys", pa.list_(pa.string())), ("bits", pa.list_(pa.int32())), ("hot", pa.list_(pa.string()))])
    table = pa.Table.from_pylist([row(side, i) for side in (True, False) for i in range(n)], schema)
    tracemalloc.start()
    rows = [tuple(x.values()) for b in cells._cell(2, 3, 0.12, 0.88)(iter(table.to_batches())) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [("10", "00", BIT["country_name"])] and peak < n * n


def test_records_of_many_cells_are_copied_a_few_times():
    a, t = cells.blocks(400_000, 800_000, 8)
    assert t * 400_000 + a * 800_000 < 10_000_000


def test_aliases_are_found_without_scores_of_all_pairs(spark):
    """Pairs that a rule of names finds lead to no new ones, so they need no score."""
    sf = "/root/testdata/sf0.01"
    stored = {name: B._stored.pop((spark.sparkContext.applicationId, sf, name), None) for name in ("scored", "scored_by_place")}
    rows = sorted(tuple(r) for r in queries.QUERIES["alias_expansion"](spark, sf).collect())
    assert (spark.sparkContext.applicationId, sf, "scored") not in B._stored
    part = B.scored_by_place(spark, sf).select("anchor_id", "target_id", "mask", "p").collect()
    whole = B.scored(spark, sf)
    B._stored |= {(spark.sparkContext.applicationId, sf, k): v for k, v in stored.items() if v}
    assert rows == sorted(tuple(r) for r in blocking.alias_pairs(whole, B.sides(spark, sf)[1], threshold=0.6).collect()) and rows
    assert sorted(part) == sorted(B.scored_by_place(spark, sf).select("anchor_id", "target_id", "mask", "p").collect())


def test_candidates_come_as_lists(spark, monkeypatch):
    """Lists hold the pairs that are found, however many a batch has, and no row is shuffled for each pair."""
    sf = "/root/testdata/sf0.001"
    lists = B.found_lists(spark, sf)
    rows = [(r.anchor_id, t) for r in lists.collect() for t in r.targets]
    assert sorted(rows) == sorted(tuple(r) for r in B.retrieved(spark, sf).select("anchor_id", "target_id").collect())
    assert lists.count() < len(rows) / 2
    ids, r, c = [pa.array(["a", "b"]), pa.array(["x", "y", "z"])], np.array([0, 0, 1, 1, 1]), np.array([0, 2, 0, 1, 2])
    monkeypatch.setattr(cells, "ROWS", 3)
    got = [tuple(x.values()) for b in cells._lists_of(ids, [r], [c], [], None) for x in b.to_pylist()]
    assert got == [("a", ["x", "z"]), ("b", ["x"]), ("b", ["y", "z"])]
