"""Benchmark decontamination with suffix arrays of the training texts.

1. The windows of all test items are set as bits in a filter of bounded size, which is
   built by tasks and is all of the test set that is broadcast.
2. One pass over the texts hashes their words and windows. Words under windows that pass
   the filter form regions; nothing else of a text can match.
3. Equal regions of all texts are one row, so a passage that a third of the corpus repeats
   is looked at once. Test items come to the regions with which they share a window.
4. Regions are dealt to shards. Each shard sorts all whole suffixes of its regions into a
   suffix array and looks every suffix of its test items up by binary search, which gives
   all occurrences; each is followed to its full length: longest matches with places.
5. The findings of a region are joined back to the texts that hold it.

Neither the test set nor the texts pass through the driver, and the number of passes does
not grow with the test set; a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.llm import runs, tokens
from weftlink.llm.text import small_side
from weftlink.session import written

WINDOW = 13
#: Bits of the filter for each test window, the least and the most there may be (32 MB); beyond, more regions are looked at.
FILTER_BITS, MIN_FILTER, MAX_FILTER = 128, 1 << 22, 1 << 28
#: Rows of findings that are broadcast; with more both sides are shuffled.
BROADCAST_FOUND = 200_000
_SHORT = np.uint64(0xA5A5_5A5A_0F0F_F0F1)


def window_hashes(h: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all windows of n words that lie inside one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = at[text[at] == text[at + n - 1]]
    g = np.zeros(len(at), np.uint64)
    for j in range(n):
        g += h[at + j] * tokens.powers(64)[j + 1]
    return at, tokens.mixed(g + _SHORT * np.uint64(n))


ITEM = "item string, ids array<long>, n int, windows array<long>"


def _items(window: int):
    """Words and window hashes of test items; those without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column(0), []
            for first, end, body, offsets in tokens.chunks(batch.column(1)):
                h, before, _, _ = tokens.hashed_words(body, offsets, tokens.ALNUM)
                for d in range(end - first):
                    own = h[before[d] : before[d + 1]]
                    if len(own):
                        n = min(window, len(own))
                        rows.append((names[first + d], own.view(np.int64), n, window_hashes(own, np.array([0, len(own)]), n)[1].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["item", "ids", "n", "windows"])

    return run


def window_filter(items: DataFrame, windows: int) -> np.ndarray:
    """Bits of all windows of ``items``; ``MAX_FILTER`` bits at most reach the driver."""
    own = lambda batch: (g.values.to_numpy().view(np.uint64) for g in batch.column(0))
    return runs.filter_of(items.select("windows"), own, runs.filter_bytes(windows, FILTER_BITS, MIN_FILTER, MAX_FILTER))


REGION = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))]))


def _regions(shared):
    """Word counts of whole texts, and the regions whose windows pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = shared.value
        kind = pa.list_(pa.struct([("at", pa.int64()), ("ids", pa.list_(pa.int64()))]))
        for batch in batches:
            n_words: list[int] = []
            regions: list[list | None] = [None] * batch.num_rows
            for first, _, body, offsets in tokens.chunks(batch.column(0)):
                h, before, _, _ = tokens.hashed_words(body, offsets, tokens.ALNUM)
                n_words += np.diff(before).tolist()
                change = np.zeros(len(h) + 1, np.int64)
                for n in lengths:
                    at, g = window_hashes(h, before, n)
                    at = at[runs.passes(bits, g)]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n, -1)
                if not change.any():
                    continue
                inside = np.cumsum(change)[:-1] > 0
                text = np.repeat(np.arange(len(before) - 1), np.diff(before))
                begin = np.flatnonzero(inside & np.append(True, ~inside[:-1] | (text[1:] != text[:-1])))
                end = np.flatnonzero(inside & np.append(~inside[1:] | (text[1:] != text[:-1]), True)) + 1
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    d = int(text[a])
                    regions[first + d] = (regions[first + d] or []) + [{"at": a - int(before[d]), "ids": h[a:b].view(np.int64)}]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_words, pa.int64()), pa.array(regions, kind)], names=[*batch.schema.names[1:], "n_words", "regions"])

    return run


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``x`` in order, by doubling the compared length."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    n, length = len(x), 1
    while True:
        after = np.zeros(n, np.int64)
        if length < n:
            after[: n - length] = rank[length:]
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(True, pair[order][1:] != pair[order][:-1]))
        rank = new
        if n == 0 or rank.max() == n or length >= n:
            return order
        length *= 2


def matches(regions: list[np.ndarray], items: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(region, item, place in item, place in region, words) of all longest runs of an item's window or more.

    Every suffix of every item is looked up in the suffix array of the regions: the range of
    suffixes that begin as it does for one window holds all its occurrences. Those that do
    not go on to the left are followed to the right.
    """
    if not regions or not items:
        return []
    words, flat = np.unique(np.concatenate([*regions, *[ids for ids, _ in items]]), return_inverse=True)
    flat = flat + len(regions) + 1
    size, long = np.array([len(r) for r in regions]), np.array([len(ids) for ids, _ in items])
    begin = np.cumsum(size + 1) - size - 1  # a separator of its own after each region
    x, y = np.zeros(int((size + 1).sum()), np.int64), flat[int(size.sum()) :]
    inner = np.ones(len(x), bool)
    inner[begin + size] = False
    x[inner] = flat[: int(size.sum())]
    x[begin + size] = np.arange(1, len(regions) + 1)
    order, owner = suffix_array(x), np.repeat(np.arange(len(regions)), size + 1)
    first = np.cumsum(long) - long
    window = np.array([n for _, n in items])
    item = np.repeat(np.arange(len(items)), long - window + 1)
    start = np.arange(len(item)) - np.repeat(np.cumsum(long - window + 1) - (long - window + 1), long - window + 1) + first[item]
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    for j in range(int(window.max())):  # the range of suffixes that share one more word
        live = np.flatnonzero((window[item] > j) & (low < high))
        word = y[start[live] + j]
        low[live], high[live] = (_bound(x, order, j, word, low[live], high[live], side) for side in ("left", "right"))
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(start)), count)
    place = order[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    new = (start[which] == first[item[which]]) | (place == 0)
    rest = np.flatnonzero(~new)
    new[rest] = x[place[rest] - 1] != y[start[which[rest]] - 1]
    which, place = which[new], place[new]
    length, last = window[item[which]], (first + long)[item[which]]
    live = np.arange(len(which))
    while len(live):
        a, b = start[which[live]] + length[live], place[live] + length[live]
        ok = a < last[live]
        ok[ok] = y[a[ok]] == x[b[ok]]
        live = live[ok]
        length[live] += 1
    k = item[which]
    return list(zip(owner[place].tolist(), k.tolist(), (start[which] - first[k]).tolist(), (place - begin[owner[place]]).tolist(), length.tolist(), strict=True))


def _bound(x: np.ndarray, order: np.ndarray, j: int, word: np.ndarray, low: np.ndarray, high: np.ndarray, side: str) -> np.ndarray:
    """Binary search, for all suffixes at once, for ``word`` as the word at ``j`` within [low, high)."""
    lo, hi = low.copy(), np.maximum(high, low)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        at = np.minimum(order[mid] + j, len(x) - 1)
        less = x[at] < word[open_] if side == "left" else x[at] <= word[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


FOUND = "region long, n_hit long, items array<string>, longest long, matches array<struct<item:string,item_at:long,at:long,length:long>>"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard: rows of (region, ids, items), each item with its words and window."""
    for batch in batches:
        regions = [np.asarray(r.values.to_numpy()) for r in batch.column(1)]
        names: dict[str, int] = {}
        items: list[tuple[np.ndarray, int]] = []
        for own in batch.column(2):
            for it in own:
                name, ids = it["item"].as_py(), it["ids"].values.to_numpy()
                key = (name, ids.tobytes())
                if key not in names:
                    names[key] = len(items)
                    items.append((ids, it["n"].as_py()))
        labels = [name for name, _ in names]
        out: list[list] = [[] for _ in regions]
        for r, k, item_at, at, length in sorted(matches(regions, items)):
            out[r].append({"item": labels[k], "item_at": item_at, "at": at, "length": length})
        hits = []
        for r, own in zip(regions, out, strict=True):
            hit = np.zeros(len(r), bool)
            for m in own:
                hit[m["at"] : m["at"] + m["length"]] = True
            hits.append(int(hit.sum()))
        kind = pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64()), pa.array([sorted({m["item"] for m in own}) for own in out], pa.list_(pa.string())), pa.array([max((m["length"] for m in own), default=0) for own in out], pa.int64()), pa.array(out, kind)], names=["region", "n_hit", "items", "longest", "matches"])


def findings(held: DataFrame, items: DataFrame) -> DataFrame:
    """(region, n_hit, items, longest, matches) of each distinct region that holds a match.

    ``held``: rows with ``regions``. Regions are told apart by a 64-bit hash of their words.
    """
    spark, parts = held.sparkSession, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = held.select(F.explode("regions").alias("r")).select(region_key(F.col("r.ids")).alias("region"), F.col("r.ids").alias("ids"))
    distinct = written(distinct.groupBy("region").agg(F.first("ids").alias("ids")))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # 13 at most
    windows = lambda batches: _windows_of(batches, lengths)
    of_region = distinct.mapInArrow(windows, "region long, w long")
    of_item = items.select("item", "ids", "n", F.explode(F.array_distinct("windows")).alias("w"))
    touched = of_region.join(of_item.select("w").distinct(), "w", "left_semi")
    by_item = touched.join(of_item.select("w", "item", F.xxhash64("ids").alias("text")), "w").select("region", "item", "text").distinct()
    wanted = by_item.join(items.select("item", "ids", "n", F.xxhash64("ids").alias("text")), ["item", "text"]).groupBy("region").agg(F.collect_list(F.struct("item", "ids", "n")).alias("items"))
    shards = distinct.join(wanted, "region").select("region", "ids", "items").repartition(parts, "region")
    return written(shards.mapInArrow(_searched, FOUND).where("n_hit > 0"))


def _windows_of(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, found = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = np.asarray(ids.values.to_numpy()).view(np.uint64)
            g = np.unique(np.concatenate([window_hashes(h, np.array([0, len(h)]), n)[1] for n in lengths]))
            keys.append(np.full(len(g), key, np.int64))
            found.append(g.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["region", "w"])


def region_key(ids):
    return F.xxhash64(ids)


def prepared(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Test items with their words and windows, written down; null ids are empty names, items without words are left out."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))
    return written(rows.mapInArrow(_items(window), ITEM))


def held_regions(df: DataFrame, items: DataFrame, text: str, keep: Iterable[str]) -> DataFrame:
    """The columns ``keep`` as c0, c1, ... with n_words and the regions of each row; one pass over the texts."""
    count, lengths = items.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0)), F.collect_set("n")).first()
    share = df.sparkSession.sparkContext.broadcast
    rows = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("n_words", T.LongType()), T.StructField("regions", REGION)])
    return rows.mapInArrow(_regions(share((window_filter(items, count), sorted(lengths)))), schema)


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",), item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of ``df`` with the words hit and the matches of every row.

    Adds n_words, n_hit, n_items, items (names, sorted as strings), longest (words of the
    longest verbatim match), contaminated (hits in 5 % of the words or more) and matches:
    (item, place in item, place in text, length in words), one for each longest run. Null
    and empty texts have no words; very long ones are read whole. Items of one name count
    once. An empty benchmark leaves all texts clean; an empty table gives no rows. Equal
    rows are judged alike, ties do not arise. Columns not in ``keep`` are not read, and
    their names cannot clash.
    """
    keep = list(keep)
    items = prepared(benchmark, item, item_text, window)
    held = written(held_regions(df, items, text, keep)).withColumn("_row", F.monotonically_increasing_id())  # of a written table, so it is the same each time
    found = findings(held.where("regions is not null"), items)
    found = F.broadcast(found) if found.count() <= BROADCAST_FOUND else found
    each = held.where("regions is not null").select("_row", F.explode("regions").alias("r")).select("_row", F.col("r.at").alias("base"), region_key(F.col("r.ids")).alias("region")).join(found, "region")
    moved = F.transform("matches", lambda m: F.struct(m["item"], m["item_at"], (m["at"] + F.col("base")).alias("at"), m["length"]))
    of_row = each.groupBy("_row").agg(F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"), F.array_sort(F.flatten(F.collect_list(moved))).alias("matches"))
    out = held.drop("regions").join(of_row, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)],
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        items_.alias("items"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "matches",
    )


#: Texts of contaminated rows, by two hashes, up to this number are broadcast.
BROADCAST_TEXTS = 1_000_000


def clean_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df`` that are not contaminated (see ``scan``), with the columns of ``df``.

    Whether a row goes depends on its text alone, so contaminated texts are removed by two
    64-bit hashes of them; texts without a region take no further part.
    """
    marks = lambda x: [F.xxhash64(x).alias("_a"), F.xxhash64(F.lit(1), x).alias("_b")]
    rows = df.select(F.col(f"`{text}`").alias("text")).select("text", F.struct(*marks(F.col("text"))).alias("key"))
    items = prepared(benchmark, item, item_text, window)
    held = written(held_regions(rows, items, "text", ["key"]).where("regions is not null").groupBy("c0", "n_words").agg(F.first("regions").alias("regions")))
    found = findings(held, items)
    found = F.broadcast(found.select("region", "n_hit")) if found.count() <= BROADCAST_FOUND else found.select("region", "n_hit")
    each = held.select("c0", "n_words", F.explode("regions").alias("r")).select("c0", "n_words", region_key(F.col("r.ids")).alias("region")).join(found, "region")
    bad = each.groupBy("c0", "n_words").agg(F.sum("n_hit").alias("n_hit")).where("20 * n_hit >= n_words").select("c0._a", "c0._b")
    wide = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("_row"), *marks(F.col(f"`{text}`")))
    kept = wide.join(small_side(bad, BROADCAST_TEXTS), ["_a", "_b"], "left_anti")
    return kept.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])
