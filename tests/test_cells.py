"""Pairs counted block against block: the same as pair by pair, whatever the blocks."""

import random

import pyarrow as pa
import pytest

from weftlink.functions import fuzzy
from weftlink.operators import blocking, cells
from weftlink.operators import keys as K
from weftlink.operators.keys import BIT
from weftlink.plans import binding as B

SF = "/root/testdata/sf0.001"


def _rows(spark, seed, prefix, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") + rng.choice("ou") for _ in range(rng.randint(1, 3)))
    rows = [(f"{prefix}{i}", " ".join(word() for _ in range(rng.randint(0, 3))), " ".join(word() for _ in range(rng.randint(0, 4))), rng.choice(["x", "y", ""]), rng.choice(["c", ""]), rng.choice(["1234", ""])) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, name_norm string, address_norm string, country_norm string, city string, postal_code string")


def _by_pair(a, t, r, n_targets):
    """The rules, one pair at a time."""
    families = K.memory_families()
    keyed = lambda x: {e.entity_id: ({k.key: k.bit for k in e.k}, e.name_norm) for e in x.select("entity_id", "name_norm", K.key_lists(families).alias("k")).collect()}
    left, right = keyed(a), keyed(t)
    count = {}
    for k, _ in right.values():
        for key in k:
            count[key] = count.get(key, 0) + 1
    word = blocking.generic_limit(n_targets, r.max_posting, r.floor, r.max_share)
    out = {}
    for i, (ka, na) in left.items():
        for j, (kt, nt) in right.items():
            shared = [(k, b) for k, b in kt.items() if k in ka and count[k] <= (r.max_posting if k[0] in "PNC" else word)]
            mask = 0
            for _, b in shared:
                mask |= b if b not in (BIT["address"], BIT["name_ngram"]) else 0
            if sum(b == BIT["address"] for _, b in shared) >= r.address_overlap:
                mask |= BIT["address"]
            if sum(b == BIT["name_ngram"] for _, b in shared) >= r.gram_overlap:
                ga, gt = ({k for k, b in x.items() if b == BIT["name_ngram"]} for x in (ka, kt))
                if len(ga & gt) / len(ga | gt) >= r.gram_jaccard:
                    mask |= BIT["name_ngram"]
                if fuzzy.indel([na], [nt])[0] >= r.strong_ratio:
                    mask |= BIT["strong_name"]
            if mask:
                out[i, j] = mask
    return out


@pytest.mark.parametrize("size", [7, 40_000])
def test_pairs_of_cells_are_those_of_the_rules(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "ANCHORS", size)
    monkeypatch.setattr(cells, "TARGETS", size)
    a, t = _rows(spark, 1, "S1-", 40), _rows(spark, 2, "S2-", 60)
    r = blocking.Retrieval(max_posting=12, floor=10)
    got = blocking.memory_candidates(a, t, 60, r).collect()
    expected = _by_pair(a, t, r, 60)
    assert {(x.anchor_id, x.target_id): x.mask for x in got} == expected and len(got) == len(expected)
    assert any(m & BIT["strong_name"] for m in expected.values())


def test_a_cell_is_counted_in_pieces(monkeypatch):
    """A few anchors and a few postings at a time give what one table gives."""
    rng = random.Random(3)
    keys = [f"G|{i}" for i in range(9)] + [f"A|{i}" for i in range(5)] + ["T|1"]
    bit = {"G": BIT["name_ngram"], "A": BIT["address"], "T": BIT["country_name"]}
    rows = []
    for i in range(50):
        k = sorted(rng.sample(keys, rng.randint(0, 8)))
        rows.append({"anchor": i % 2 == 0, "entity_id": f"e{i}", "name": rng.choice(["abc", "abd", "xyz", ""]), "grams": 9, "keys": k, "bits": [bit[x[0]] for x in k], "hot": ["G|h"] * (i % 3 == 0)})
    schema = pa.schema([("anchor", pa.bool_()), ("entity_id", pa.string()), ("name", pa.string()), ("grams", pa.int32()), ("keys", pa.list_(pa.string())), ("bits", pa.list_(pa.int32())), ("hot", pa.list_(pa.string()))])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=7)
    run = lambda: sorted(tuple(x.values()) for b in cells._cell(2, 3, 0.12, 0.88)(iter(batches)) for x in b.to_pylist())
    whole = run()
    for name, value in (("PLACES", 30), ("POSTINGS", 5), ("ROWS", 4)):
        monkeypatch.setattr(cells, name, value)
    assert run() == whole and len(whole) > 50


def test_shared_keys_do_not_become_rows(spark):
    plan = B.retrieved(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "anchor_id" not in plan.split("FlatMapGroupsInArrow")[1].split("\n", 1)[1]


def test_a_small_file_is_no_single_task(spark):
    assert B.raw_records(spark, SF).rdd.getNumPartitions() > 1


def test_bit_parallel_levenshtein():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    a, b = ([("".join(rng.choice("abcé\U0001d11e ") for _ in range(rng.randint(0, top)))) for top in (4, 30, 63, 64, 90) for _ in range(40)] for _ in "ab")
    rng.shuffle(b)
    assert fuzzy.levenshtein(a, b).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


def test_small_sides_are_broadcast_and_large_ones_are_not(spark, monkeypatch):
    from weftlink.operators import features

    pairs = spark.createDataFrame([("S1-0", "S2-1", 1)], "anchor_id string, target_id string, mask int")
    a, t = _rows(spark, 1, "S1-", 3), _rows(spark, 2, "S2-", 3)
    plan = lambda: features.gathered(pairs, a, t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan().count("strategy=broadcast") == 2
    monkeypatch.setattr(features, "BROADCAST_BYTES", 10)
    assert "strategy=broadcast" not in plan()


def test_pairs_are_dealt_out_evenly(spark):
    sizes = [n for n in B.pairs(spark, SF).rdd.glom().map(len).collect() if n]
    assert len(sizes) > 1 and max(sizes) < sum(sizes) / 2
