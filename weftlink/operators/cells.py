"""Pairs that share keys, counted block against block.

Anchors and targets are dealt into blocks of bounded size, and each pair of blocks is one
cell. Within a cell the postings of the targets' keys are integer arrays, and what pairs
share is counted by sorting the places that a few anchors at a time reach, so shared keys
never become rows and pairs that share nothing cost nothing: only what the cells send out
is shuffled or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import fuzzy
from weftlink.operators.keys import BIT
from weftlink.operators.pairwise import KEPT, Measure, letter_counts

#: Records of a block at most, by the mean.
ANCHORS, TARGETS = 50_000, 100_000
#: Cells whose numbers are chosen so that each has a task of its own.
CHOSEN = 4096
#: Places of a few anchors, whose numbers have 32 bits, and postings that are laid out at once.
PLACES, POSTINGS = (1 << 31) - 1, 1 << 21
#: Rows of a batch that a cell sends out.
ROWS = 1 << 16
SCHEMA = "anchor_id string, target_id string, mask int"
LISTS = "anchor_id string, targets array<string>"
#: The ids of an anchor's targets end to end, and their lengths and millionths of p as 32-bit numbers.
PACKED = "anchor_id string, ids binary, sizes binary, p binary"


def blocks(n_anchors: int, n_targets: int, parallelism: int) -> tuple[int, int]:
    """The numbers of blocks of both sides: bounded blocks, cells enough to keep all cores busy, and few copies of records."""
    a, t = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_targets // TARGETS))
    while a * t < 4 * parallelism:
        if n_anchors / a <= 250 and n_targets / t <= 500:
            break
        if n_anchors / a >= n_targets / t:
            a *= 2
        else:
            t *= 2
    return a, t


def _scrambled(v: int) -> int:
    """Spark's hash of an int."""
    turned = lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    k = turned(v * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (turned(42 ^ k, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def numbers(n: int) -> list[int]:
    """``n`` numbers that Spark deals to ``n`` partitions, one to each."""
    taken: dict[int, int] = {}
    v = 0
    while len(taken) < n:
        taken.setdefault(_scrambled(v) % n, v)
        v += 1
    return [taken[i] for i in range(n)]


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """The rows that the entries of a list column belong to, and the entries."""
    c = pa.concat_arrays(table[column].chunks) if table.num_rows else pa.array([], table.schema.field(column).type)
    return np.repeat(np.arange(len(c)), pc.list_value_length(c).to_numpy(zero_copy_only=False)), c.flatten()


def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _bit_sets(rows: np.ndarray, codes: np.ndarray, n: int, size: int) -> np.ndarray:
    """One row of 64-bit words for each of ``n`` sets of codes below ``size``."""
    out = np.zeros((n, -(-size // 64)), np.uint64)
    given = codes >= 0
    np.bitwise_or.at(out, (rows[given], codes[given] >> 6), np.uint64(1) << (codes[given] & 63).astype(np.uint64))
    return out


class _Names:
    """Distinct names of one side, with what bounds their similarity."""

    def __init__(self, names: pa.ChunkedArray) -> None:
        coded = pc.dictionary_encode(names.combine_chunks() if names.num_chunks != 1 else names.chunk(0))
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = coded.dictionary.to_pylist()
        self.size = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.letters = letter_counts(self.text)


def _alike(a: _Names, t: _Names, rows: np.ndarray, columns: np.ndarray, least: float) -> np.ndarray:
    """Whether names reach an indel similarity; the sizes and the letters of both rule most pairs out."""
    out = np.zeros(len(rows), bool)
    x, y = a.code[rows], t.code[columns]
    both = a.size[x] + t.size[y]
    open_ = np.flatnonzero(2.0 * np.minimum(a.size[x], t.size[y]) / both >= least)
    for at in range(0, len(open_), ROWS):
        i = open_[at : at + ROWS]
        common = np.minimum(a.letters[x[i]], t.letters[y[i]]).sum(axis=1)
        i = i[2.0 * common / both[i] >= least]
        pairs, place = np.unique(x[i] * len(t.text) + y[i], return_inverse=True)
        if len(pairs):
            p, q = np.divmod(pairs, len(t.text))
            out[i] = (fuzzy.indel([a.text[k] for k in p], [t.text[k] for k in q]) >= least)[place]
    return out


def _steps(owner: np.ndarray, reach: np.ndarray, n_anchors: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """The first and the number of a few anchors, and where their keys lie, so that postings and places are bounded."""
    done = np.concatenate([[0], np.cumsum(np.bincount(owner, reach, n_anchors))]).astype(np.int64)
    keys = np.searchsorted(owner, np.arange(n_anchors + 1))
    first = 0
    while first < n_anchors:
        last = int(np.searchsorted(done, done[first] + POSTINGS, side="right")) - 1
        last = min(n_anchors, max(first + 1, min(last, first + PLACES // n)))
        if keys[last] > keys[first]:
            yield first, last - first, int(keys[first]), int(keys[last])
        first = last


def _counted(posting: np.ndarray, start: np.ndarray, reach: np.ndarray, own: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that keys reach, in order, and how many keys reach each."""
    done = np.cumsum(reach)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(done, np.arange(POSTINGS, int(done[-1]), POSTINGS)), [len(reach)]]))
    table = np.zeros(places, np.int64) if len(cuts) > 2 else None  # an anchor with more postings than are laid out at once
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        m = reach[i:j]
        end = np.cumsum(m)
        at = np.repeat(start[i:j] - (end - m), m) + np.arange(int(end[-1]))
        place = posting[at]
        place += np.repeat(own[i:j], m)
        if table is not None:
            table += np.bincount(place, minlength=places)
    if table is not None:
        hit = np.flatnonzero(table)
        return hit.astype(np.int32), table[hit]
    place.sort()
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[head], np.diff(np.append(head, len(place)))


def _marked(place: np.ndarray, kind: int) -> np.ndarray:
    return place.astype(np.int64) << 32 | int(kind)


def _cell(address_overlap: int, gram_overlap: int, gram_jaccard: float, strong_ratio: float, measures: Callable[[pa.Table, pa.Table], Measure] | None = None, without: int = 0, sent: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        own = pc.is_valid(table["entity_id"])
        anchors, targets = table.filter(table["anchor"]), table.filter(pc.and_(own, pc.invert(table["anchor"])))
        too_frequent = _lists(table.filter(pc.invert(own)), "hot")[1]
        n = targets.num_rows
        if not anchors.num_rows or not n:
            return
        owner, keys = _lists(targets, "keys")
        coded = pc.dictionary_encode(keys)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bit = np.zeros(len(coded.dictionary), np.int32)
        bit[code] = _lists(targets, "bits")[1].to_numpy(zero_copy_only=False)
        h_owner, hot = _lists(targets, "hot")
        if len(too_frequent):
            left = pc.is_in(coded.dictionary, value_set=too_frequent).to_numpy(zero_copy_only=False)[code]
            gram = left & (bit[code] == BIT["name_ngram"])
            h_owner, hot = np.concatenate([h_owner, owner[gram]]), pa.concat_arrays([hot, keys.filter(pa.array(gram))])
            owner, code = owner[~left], code[~left]
        posting = owner[np.argsort(code, kind="stable")].astype(np.int32)
        start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(bit)))]).astype(np.int64)
        a_owner, a_keys = _lists(anchors, "keys")
        frequent = pc.unique(hot)
        t_hot = _bit_sets(h_owner, _codes(hot, frequent), n, len(frequent))
        a_hot = _bit_sets(a_owner, _codes(a_keys, frequent), anchors.num_rows, len(frequent))
        a_code = _codes(a_keys, coded.dictionary)
        a_owner, a_code = a_owner[a_code >= 0], a_code[a_code >= 0]
        reach = start[a_code + 1] - start[a_code]
        a_owner, a_code, reach = a_owner[reach > 0], a_code[reach > 0], reach[reach > 0]
        sizes = [x["grams"].to_numpy() for x in (anchors, targets)]
        names = [_Names(x["name"]) for x in (anchors, targets)]
        ids = [x["entity_id"].combine_chunks() for x in (anchors, targets)]
        measure = measures(anchors, targets) if measures else None
        send = sent or _batches
        least = {BIT["name_ngram"]: gram_overlap, BIT["address"]: address_overlap}
        rows, columns, masks, waiting = [], [], [], 0
        for first, count, lo, hi in _steps(a_owner, reach, anchors.num_rows, n):
            c, r, own = a_code[lo:hi], reach[lo:hi], (a_owner[lo:hi] - first).astype(np.int32) * np.int32(n)
            found = []  # places with the rules that find them
            kinds = bit[c]
            for kind in np.unique(kinds):
                some = kinds == kind
                place, shared = _counted(posting, start[c[some]], r[some], own[some], count * n)
                enough = shared >= least.get(kind, 1)
                place, shared = place[enough], shared[enough]
                if kind != BIT["name_ngram"]:
                    found.append(_marked(place, kind))
                    continue
                x, y = np.divmod(place, np.int32(n))
                x += np.int32(first)
                for w in range(t_hot.shape[1]):
                    shared = shared + np.bitwise_count(a_hot[x, w] & t_hot[y, w])
                found.append(_marked(place[shared / (sizes[0][x] + sizes[1][y] - shared) >= gram_jaccard], kind))
                found.append(_marked(place[_alike(*names, x, y, strong_ratio)], BIT["strong_name"]))
            both = np.concatenate(found)
            if not len(both):
                continue
            both.sort()
            place = both >> 32
            head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            mask = np.bitwise_or.reduceat(both, head).astype(np.int32)
            head, mask = (v[mask & without == 0] for v in (head, mask))
            row, column = np.divmod(place[head], n)
            rows, columns, masks, waiting = [*rows, row + first], [*columns, column], [*masks, mask], waiting + len(head)
            if waiting >= ROWS:
                yield from send(ids, rows, columns, masks, measure)
                rows, columns, masks, waiting = [], [], [], 0
        if waiting:
            yield from send(ids, rows, columns, masks, measure)

    return run


def _batches(ids: list[pa.Array], rows: list[np.ndarray], columns: list[np.ndarray], masks: list[np.ndarray], measure: Measure | None) -> Iterator[pa.RecordBatch]:
    r, c, m = (np.concatenate(v) for v in (rows, columns, masks))
    for at in range(0, len(r), ROWS):
        x, y, mask = (v[at : at + ROWS] for v in (r, c, m))
        found = measure(x, y) if measure else {}
        if KEPT in found:
            kept = np.flatnonzero(found.pop(KEPT))
            x, y, mask, found = x[kept], y[kept], mask[kept], {k: v[kept] for k, v in found.items()}
        out = {"anchor_id": ids[0].take(pa.array(x)), "target_id": ids[1].take(pa.array(y)), "mask": pa.array(mask, pa.int32())}
        for name, values in found.items():
            out[name] = pa.array(values, pa.float64())
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _lists_of(ids: list[pa.Array], rows: list[np.ndarray], columns: list[np.ndarray], masks: list[np.ndarray], measure: None) -> Iterator[pa.RecordBatch]:
    """The targets of each anchor as a list; pairs come in the order of the anchors."""
    r, c = (np.concatenate(v) for v in (rows, columns))
    for at in range(0, len(r), ROWS):
        x, y = r[at : at + ROWS], c[at : at + ROWS]
        head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        targets = pa.ListArray.from_arrays(pa.array(np.append(head, len(x)), pa.int32()), ids[1].take(pa.array(y)))
        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(x[head])), targets], ["anchor_id", "targets"])


def _packed(ids: list[pa.Array], rows: list[np.ndarray], columns: list[np.ndarray], masks: list[np.ndarray], measure: Measure) -> Iterator[pa.RecordBatch]:
    """The targets of each anchor with their p, which has six places, as a few bytes for each; pairs come in the order of the anchors."""
    r, c = (np.concatenate(v) for v in (rows, columns))
    for at in range(0, len(r), ROWS):
        x, y = r[at : at + ROWS], c[at : at + ROWS]
        head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        edge = np.append(head, len(x)).astype(np.int32)
        targets = ids[1].take(pa.array(y)).cast(pa.string())
        end = np.frombuffer(targets.buffers()[1], np.int32)[targets.offset : targets.offset + len(x) + 1]
        p = np.rint(measure(x, y)["p"] * 1e6).astype(np.int32)
        binary = lambda offsets, data: pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(np.ascontiguousarray(offsets)), data])
        parts = [binary(end[edge], targets.buffers()[2]), binary(edge * np.int32(4), pa.py_buffer(np.diff(end))), binary(edge * np.int32(4), pa.py_buffer(p))]
        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(x[head])), *parts], ["anchor_id", "ids", "sizes", "p"])


def _flat(c: pa.ChunkedArray) -> np.ndarray:
    """The 32-bit numbers of all rows of a binary column."""
    return np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(v.as_buffer(), np.int32) for v in c if v.as_buffer().size]])


def unpacked(batches: Iterator[pa.RecordBatch], of: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED``, with all of every anchor's, as (anchor_id, target_id, *columns of ``of``).

    ``of`` sees the pairs of some whole anchors: numbers of the anchors in order, and millionths of p.
    """
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    names = pc.dictionary_encode(pa.concat_arrays(table["anchor_id"].chunks))
    code = names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    count = pc.binary_length(pa.concat_arrays(table["p"].chunks)).to_numpy(zero_copy_only=False)[order] // 4
    code, done = code[order], np.cumsum(count)
    edges = np.append(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])), len(code))
    first = 0
    while first < len(code):
        before = done[first - 1] if first else 0
        last = int(edges[max(np.searchsorted(edges, first, side="right"), np.searchsorted(edges, np.searchsorted(done, before + ROWS), side="right") - 1)])
        some = table.take(pa.array(order[first:last]))
        group, p, size = np.repeat(code[first:last], count[first:last]), _flat(some["p"]), _flat(some["sizes"])
        data = b"".join(v.as_buffer() for v in some["ids"])
        targets = pa.StringArray.from_buffers(len(p), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data))
        out = {"anchor_id": names.dictionary.take(pa.array(group)), "target_id": targets}
        out |= {k: pa.array(v, pa.float64()) for k, v in of(group, p).items()}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
        first = last


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _all_of(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _number(c: Column, n: int) -> Column:
    """The number of the ``c``-th of ``n`` cells."""
    return F.element_at(F.lit(numbers(n)), (c + 1).cast("int")) if n <= CHOSEN else c.cast("int")


def _records(anchors: DataFrame, targets: DataFrame, na: int, nt: int) -> DataFrame:
    """The records of both sides in every cell of their block, with ``anchor`` and ``cell``."""
    a = anchors.select(F.lit(True).alias("anchor"), "*", _block("entity_id", na).alias("_b"), _all_of(nt).alias("_c")).withColumn("cell", _number(F.col("_b") * nt + F.col("_c"), na * nt))
    t = targets.select(F.lit(False).alias("anchor"), "*", _block("entity_id", nt).alias("_b"), _all_of(na).alias("_c")).withColumn("cell", _number(F.col("_c") * nt + F.col("_b"), na * nt))
    return a.unionByName(t).drop("_b", "_c")


def _given(measures: Callable[[pa.Table, pa.Table], Measure]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        own = pc.is_valid(table["entity_id"])
        sides = [table.filter(pc.and_(own, table["anchor"] if s else pc.invert(table["anchor"]))) for s in (True, False)]
        pairs = table.filter(pc.invert(own))
        if not pairs.num_rows or not all(s.num_rows for s in sides):
            return
        ids = [s["entity_id"].combine_chunks() for s in sides]
        x, y = (_codes(pairs[c].combine_chunks(), known) for c, known in zip(("anchor_id", "target_id"), ids, strict=True))
        known = (x >= 0) & (y >= 0)
        masks = pairs["mask"].to_numpy()[known]
        yield from _batches(ids, [x[known]], [y[known]], [masks], measures(*sides))

    return run


def measured(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, measures: Callable[[pa.Table, pa.Table], Measure], columns: Sequence[str]) -> DataFrame:
    """``pairs`` (anchor_id, target_id, mask) with ``columns``, worked out in the cells where both records lie.

    Both sides have ``entity_id`` and what the measure asks for.
    """
    n = [x.count() for x in (anchors, targets)]
    na, nt = blocks(*n, anchors.sparkSession.sparkContext.defaultParallelism)
    cell = _number(_block("anchor_id", na) * nt + _block("target_id", nt), na * nt)
    own = pairs.select("anchor_id", "target_id", F.col("mask").cast("int").alias("mask"), F.lit(False).alias("anchor"), cell.alias("cell"))
    rows = _records(anchors, targets, na, nt).unionByName(own, allowMissingColumns=True)
    schema = ", ".join([SCHEMA, *[f"{c} double" for c in columns]])
    return rows.repartition(na * nt, "cell").groupBy("cell").applyInArrow(_given(measures), schema)


def met(anchors: DataFrame, targets: DataFrame, frequent: DataFrame, n_anchors: int, n_targets: int, limits: tuple[float, ...], measures: Callable[[pa.Table, pa.Table], Measure] | None = None, columns: Sequence[str] = (), without: int = 0, listed: bool = False, packed: bool = False) -> DataFrame:
    """(anchor_id, target_id, mask, *columns) of all pairs that a rule finds and no rule of ``without``.

    If ``listed``, (anchor_id, targets) instead: the same pairs, in a few lists for each anchor.
    If ``packed``, rows of ``PACKED``: such lists with p, the one column of the measure.

    Both sides have ``entity_id``, ``name``, ``grams``, the number of n-grams of the name,
    and all their ``keys`` with ``bits``. The ``frequent`` keys (key) go to every cell: they
    find no pair, and its n-grams count in the Jaccard similarity only. ``measures`` makes
    of the records of a cell, with whatever columns they have more, the measure of its
    pairs that gives ``columns``.
    """
    na, nt = blocks(n_anchors, n_targets, anchors.sparkSession.sparkContext.defaultParallelism)
    hot = F.array().cast("array<string>")
    both = _records(anchors.withColumn("hot", hot), targets.withColumn("hot", hot), na, nt)
    lists = frequent.groupBy(F.pmod(F.xxhash64("key"), F.lit(64)).alias("_l")).agg(F.collect_list("key").alias("hot"))
    f = lists.select(F.lit(False).alias("anchor"), "hot", _all_of(na * nt).alias("_c")).withColumn("cell", _number(F.col("_c"), na * nt)).drop("_c")
    rows = both.unionByName(f, allowMissingColumns=True)
    schema = PACKED if packed else LISTS if listed else ", ".join([SCHEMA, *[f"{c} double" for c in columns]])
    sent = _packed if packed else _lists_of if listed else None
    return rows.repartition(na * nt, "cell").groupBy("cell").applyInArrow(_cell(*limits, measures, without, sent), schema)
