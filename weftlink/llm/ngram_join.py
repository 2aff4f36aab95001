"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

A document is the set of its distinct word n-grams. Two sets link when their Jaccard
similarity reaches the threshold. All sets share one order, rare n-grams first. If two
sets link, their l-prefixes (the first |set| - needed + l n-grams) share l of them, for
any l; each document takes the l with the least estimated cost: posting entries read,
plus candidates to verify, of which a longer prefix with more matches leaves fewer.

Steps, none of which sees all pairs of a group:

1. Sieve: in hash order, each document deals the n-grams of a long prefix out by n-gram
   and asks for a tenth of its set to be shared with any other document. Those that get
   fewer can link to none and leave here, without their text or set being moved.
2. The others become sets; equal ones collapse into one class. N-grams are counted over
   the classes, and the ``table_size`` most frequent ones are broadcast: they give the
   common order, in which all others, seen less often than any of them, come first.
   Those of more than ``hot`` classes for which the table has no room are bits of a filter.
3. N-grams of at most ``hot`` classes join as prefixes: at most so many partners for each
   row. Others are reached only by sets that consist of such n-grams almost wholly:
   members of large groups of near copies. Each is described by its difference from a
   virtual centre of its group, which is much smaller than the set. Members link to the
   member nearest to the centre when both differences are small enough together; for the
   rest, the differences are joined by their own prefixes. Members of different groups
   are joined as in the first case. Of these sets, small ones can differ by one or two
   n-grams only from any set that they link to; they meet where they agree without those.
4. Candidates are verified on whole sets, and links give components.

N-grams are 64-bit hashes; two that collide within a pair of documents count as one
(odds of about 1e-13 for two documents of a thousand words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm import runs, tokens
from weftlink.llm.components import connected_components
from weftlink.llm.text import small_side
from weftlink.session import checkpointed


@dataclass(frozen=True)
class Join:
    """``percent``: the least Jaccard similarity; ``n``: words in an n-gram."""

    n: int = 5
    percent: int = 80
    #: Entries of the broadcast table of frequent n-grams, 12 bytes each.
    table_size: int = 3_000_000
    #: Bits of a hash that counting looks at.
    key_bits: int = 44
    #: An n-gram of more sets than these is hot.
    hot: int = 48
    max_matches: int = 4
    #: Cost of verifying a candidate, in posting entries.
    verify_cost: int = 8
    #: One hot set in so many may become the first centre of a group.
    pivots: int = 64

    def needed(self, n: int) -> int:
        """The least overlap of a set of n with any set that it links to."""
        return (self.percent * n + 99) // 100


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text is one n-gram, an empty one none."""
    for first, end, body, offsets in tokens.chunks(texts):
        h, before, _, _ = tokens.hashed_words(body, offsets, tokens.NON_BLANK)
        grams = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for j in range(n):
            grams += h[j : j + len(grams)] * tokens.powers(64)[j + 1]
        grams = tokens.mixed(grams)
        for d in range(end - first):
            a, b = before[d], before[d + 1]
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                yield tokens.mixed((h[a:b] * tokens.powers(64)[1 : b - a + 1]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


#: A reference to a row in the sieve: 40 bits of its hash, and the matches it asks for, rounded down.
REF_BITS = 40
_STEPS = np.unique(np.concatenate([np.arange(1, 40), np.geomspace(40, 1 << 24, 216).astype(np.int64)]))[:255]
#: N-grams that a task deals out at once, about 120 bytes each while it does.
DEAL = 1 << 19
#: What stands for all rows of a run that have an n-gram in common.
MARK = np.uint64((1 << 48) - 1)
#: Centres of groups that are broadcast, if their n-grams are few enough too; with more, sets are shuffled by group.
PIVOT_SETS = 5_000
#: Bits of the filter for each hot n-gram outside the table, and the least and most there may be (32 MB).
FILTER_BITS, MIN_FILTER, MAX_FILTER = 16, 1 << 10, 1 << 28
#: Rows of a broadcast table of references or classes, 16 bytes each; beyond it Spark splits the hot keys of a shuffle.
BROADCAST_REFS = 2_000_000


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _joined(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def _dealer(join: Join, parts: int):
    """Prefixes in hash order, each n-gram with a reference to its row, by n-gram.

    Rows of a run that share an n-gram have met there: they are counted at once (in buckets
    from ``parts`` on, by row), and one mark goes out for all of them. So an n-gram that a
    third of all rows share costs one entry a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            grams = np.concatenate([g for g, _ in held])
            refs = np.repeat(np.array([r for _, r in held], np.uint64), [len(g) for g, _ in held])
            part = (grams & np.uint64(0xFFFFF)) % np.uint64(parts)
            order = np.lexsort((grams, part))
            grams, refs, part = grams[order], refs[order], part[order]
            same = grams[1:] == grams[:-1]
            first, shared = np.append(True, ~same), np.append(same, False) | np.append(False, same)
            found = _counted(refs[shared], parts, parts)
            refs[shared] = MARK
            grams, refs, part = grams[first] >> np.uint64(20), refs[first], part[first]
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()
            found += [(b, runs.pack(grams[lo:hi]), _planes(refs[lo:hi], 6)) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["bucket", "keys", "refs"])

        for batch in batches:
            for s, ref in zip(shingle_sets(batch.column(0), join.n), batch.column(1).to_pylist(), strict=True):
                n = len(s)
                if not n:
                    continue
                matches = max(1, n // 10)
                code = int(np.searchsorted(_STEPS, matches, "right")) - 1
                held.append((s[: n - join.needed(n) + matches], (ref << 8) | code))
                size += len(held[-1][0])
                if size >= DEAL:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _counted(refs: np.ndarray, parts: int, base: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, references, counts) of rows by reference, in buckets from ``base`` on."""
    ref, n = np.unique(refs, return_counts=True)
    part = (ref >> np.uint64(8)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    ref, n = ref[order], n[order]
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)).tolist()
    return [(base + b, runs.pack(ref[lo:hi]), runs.pack_counts(n[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]


def _met(parts: int):
    """How many n-grams of this range each row shares with another row, by reference; what runs counted goes on as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, refs = [], []
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["bucket", "keys", "refs"])
        for batch in batches:
            own = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            if done := [(b - parts, k, r) for b, k, r in own if b >= parts]:
                yield batch_of(done)
            keys += [runs.unpack(k) for b, k, _ in own if b < parts]
            refs += [_joined(r, 6) for b, _, r in own if b < parts]
        if not keys:
            return
        k, r = np.concatenate(keys), np.concatenate(refs)
        del keys, refs
        order = np.argsort(k, kind="stable")
        k, r = k[order], r[order]
        same = k[1:] == k[:-1]
        yield batch_of(_counted(r[(np.append(same, False) | np.append(False, same)) & (r != MARK)], parts, 0))

    return run


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The references whose rows share as many n-grams as they ask for."""
    refs, counts = [], []
    for batch in batches:
        refs += [runs.unpack(k) for k in batch.column(1).to_pylist()]
        counts += [runs.unpack_counts(c) for c in batch.column(2).to_pylist()]
    if not refs:
        return
    ref, n = runs.summed(refs, counts)
    live = np.unique(ref[n >= _STEPS[(ref & np.uint64(255)).astype(np.int64)]] >> np.uint64(8))
    yield pa.RecordBatch.from_arrays([pa.array(live.view(np.int64)), pa.array(np.ones(len(live), bool))], names=["ref", "live"])


def sieved(docs: DataFrame, join: Join) -> DataFrame:
    """(ref, live): the rows that share enough of their prefix in hash order with other rows.

    If two sets link, their l-prefixes share l n-grams; here l is a tenth of the set. A
    row that does not share l of its l-prefix with all other rows together links to none.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "bucket int, keys binary, refs binary"
    dealt = docs.select("text", "ref").mapInArrow(_dealer(join, parts), schema)
    met = dealt.repartition(parts, "bucket").mapInArrow(_met(parts), schema)
    return met.repartition(parts, "bucket").mapInArrow(_enough, "ref long, live boolean")


def _sets(join: Join):
    """Sets of the rows that are live, as sorted hashes, and a hash of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, grams = [], [], []
            for s, live in zip(shingle_sets(batch.column(1), join.n), batch.column(2).to_pylist(), strict=True):
                n.append(len(s))
                live = live and len(s) > 0
                key.append(int(tokens.mixed(s + np.arange(len(s), dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64)) if live else None)
                grams.append(s.view(np.int64) if live else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "grams"])

    return run


def _counter(join: Join, buckets: int):
    """Runs of n-gram keys, each set counted once."""
    shift = np.uint64(64 - join.key_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = runs.Counter(join.key_bits, buckets)
        for batch in batches:
            for s in batch.column(0):
                if (full := held.add(s.values.to_numpy().view(np.uint64) >> shift)) is not None:
                    yield full
        if (rest := held.flush()) is not None:
            yield rest

    return run


def frequent(grams: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted keys of the most frequent n-grams, the number of sets that have each, and a filter.

    All sets are counted. The table has ``table_size`` entries at most, the largest
    counts first: that bounds what reaches the driver and is broadcast. If n-grams of more
    than ``hot`` sets are left out, the filter has their bits, so none of them passes as
    rare; what passes by chance is only treated with more care.
    """
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = grams.mapInArrow(_counter(join, 1 << (2 * parts - 1).bit_length()), runs.SCHEMA)
    shared = checkpointed(found.repartition(parts, "bucket").mapInArrow(runs.merger(2), runs.SCHEMA))
    hist = runs.totals(shared)
    keys, counts, cut = runs.top(shared, hist, join.table_size, 2)
    left = sum(n for value, n, _ in hist if join.hot < value < cut)
    bits = None
    if left:

        def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = runs.unpack_counts(c)
                yield tokens.mixed(runs.unpack(k)[(n > join.hot) & (n < cut)])

        bits = runs.filter_of(shared, hashes, runs.filter_bytes(left, FILTER_BITS, MIN_FILTER, MAX_FILTER))
    return keys, counts.astype(np.int32), bits


ORDERED = "key long, root {id}, n long, grams array<long>, cold int, first int, prefix int, matches int"


def _preparer(join: Join, shared):
    """Sets in the common order, and the prefix with the least estimated cost.

    cold: n-grams that are not hot; first: length of the 1-prefix; prefix: of the prefix
    taken; matches: what it asks for. An n-gram outside the table counts as one of two sets,
    or as hot if the filter has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, bits = shared.value
        shift = np.uint64(64 - join.key_bits)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "grams", "cold", "first", "prefix", "matches")}
            for found in batch.column(2):
                s = found.values.to_numpy().view(np.uint64)
                n = len(s)
                k, df = s >> shift, np.full(n, 2)
                if bits is not None:
                    df[runs.passes(bits, tokens.mixed(k))] = join.hot + 1
                if len(table):
                    at = np.minimum(np.searchsorted(table, k), len(table) - 1)
                    df = np.where(table[at] == k, counts[at], df)
                need = join.needed(n)
                order = np.lexsort((s, df))
                df = df[order]
                cold = int(np.searchsorted(df, join.hot, "right"))
                first = n - need + 1
                most = 1 if first > cold else max(1, min(join.max_matches, need, cold - (n - need)))  # longer prefixes stay cold
                reads = np.cumsum(df - 1)
                cost = [reads[n - need + m - 1] * (1 + join.verify_cost / m) for m in range(1, most + 1)]
                m = 1 + int(np.argmin(cost))
                for c, v in (("n", n), ("grams", s[order].view(np.int64)), ("cold", cold), ("first", first), ("prefix", n - need + m), ("matches", m)):
                    out[c].append(v)
            kinds = {"n": pa.int64(), "grams": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, kinds.get(c, pa.int32())) for c, v in out.items()]], names=["key", "root", *out])

    return run


def _sized(join: Join, a: str, b: str):
    return (join.percent * F.col(a) <= 100 * F.col(b)) & (join.percent * F.col(b) <= 100 * F.col(a))


def cold_candidates(classes: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) that share enough n-grams of their prefixes, none of them hot.

    An n-gram that is not hot has at most ``hot`` sets, so a row meets at most so many
    others. A longer prefix is taken only where it has no hot n-gram; a set whose prefix has
    some asks for one match.
    """
    end = F.least("prefix", "cold")
    rows = classes.where(end > 0).select("key", "n", "matches", F.explode(F.slice("grams", F.lit(1), end)).alias("gram"))
    left, right = rows.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "matches")]), rows.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "matches")])
    pairs = left.join(right, "gram").where((F.col("key_a") < F.col("key_b")) & _sized(join, "n_a", "n_b"))
    met = pairs.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(F.count("*").alias("met"), F.least(F.first("matches_a"), F.first("matches_b")).alias("least"))
    return met.where("met >= least").select("a", "b")


def grouped(hot: DataFrame, join: Join) -> DataFrame:
    """(key, n, hub, diff) for the hot sets that have a centre, all pivots among them: ``diff`` is the difference from it.

    A centre starts as one of a hashed sample of the sets: of those that hold an
    n-gram, the first one counts, and a set goes where most of 16 of its n-grams
    point. It then takes in each n-gram of most differences and drops each that most
    members lack. Which centre a set has decides on work only, not on results.
    """
    pivot = hot.where(F.pmod(F.xxhash64("key"), F.lit(join.pivots)) == 0)
    of_gram = pivot.select("key", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("key").alias("hub"))
    probe = hot.select("key", F.explode(F.slice(F.array_sort(F.slice("grams", F.col("cold") + 1, F.size("grams"))), 1, 16)).alias("gram"))
    votes = probe.join(of_gram, "gram").groupBy("key", "hub").agg(F.count("*").alias("votes")).where("votes >= 5")
    hub = votes.groupBy("key").agg(F.min_by("hub", F.struct(-F.col("votes"), F.col("hub"))).alias("hub"))
    hub = hub.union(pivot.select("key", F.col("key").alias("hub")).join(hub, "key", "left_anti"))  # a pivot without a centre is its own: no set outside a group has a hub's key
    centre = pivot.select(F.col("key").alias("hub"), F.col("grams").alias("centre"))
    member = hot.select("key", "n", "grams").join(hub, "key").join(small_side(centre, PIVOT_SETS, 8 * F.size("centre")), "hub")
    other = lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a))
    member = checkpointed(member.select("key", "n", "hub", other(F.col("grams"), F.col("centre")).alias("diff")))
    size = member.groupBy("hub").agg(F.count("*").alias("size"))
    common = member.select("hub", F.explode("diff").alias("gram")).groupBy("hub", "gram").agg(F.count("*").alias("c")).join(small_side(size), "hub").where("2 * c > size").groupBy("hub").agg(F.collect_list("gram").alias("flip"))
    moved = member.join(small_side(common, PIVOT_SETS, 8 * F.size("flip")), "hub", "left")
    return checkpointed(moved.select("key", "n", "hub", F.when(F.col("flip").isNull(), F.col("diff")).otherwise(other(F.col("diff"), F.col("flip"))).alias("diff")))


def group_links(member: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that join all members of a group which links connect.

    With d the size of the difference of two sets, they link if (100 + p) d <= (100 - p)
    (n_a + n_b). As d <= |diff_a| + |diff_b|, they do if f_a + f_b <= 0, where
    f = (100 + p) |diff| - (100 - p) n. The member with the least f so links to every
    member of any such pair. A further link needs an overlap of the differences of
    (f_a + f_b) / (2 (100 + p)) n-grams at least, and one end that is not yet linked.
    """
    p, q = 100 + join.percent, 100 - join.percent
    f = (p * F.size("diff") - q * F.col("n")).cast("long")
    rows = member.withColumn("f", f)
    best = rows.groupBy("hub").agg(F.min(F.struct("f", "key")).alias("best"))
    rows = rows.join(small_side(best), "hub").withColumn("linked", (F.col("f") + F.col("best.f") <= 0) | (F.col("key") == F.col("best.key")))
    star = rows.where(F.col("linked") & (F.col("key") != F.col("best.key"))).select(F.col("key").alias("a"), F.col("best.key").alias("b"))
    least = rows.where(~F.col("linked")).groupBy("hub").agg(F.min("f").alias("low"))
    rows = checkpointed(rows.join(small_side(least), "hub"))  # groups with a member that is not linked
    grams = rows.select("hub", F.explode("diff").alias("gram")).groupBy("hub", "gram").agg(F.count("*").alias("c"))
    at = rows.select("hub", "key", "n", "f", "linked", F.col("best.f").alias("best_f"), "low", F.size("diff").alias("d"), F.explode("diff").alias("gram")).join(grams, ["hub", "gram"])
    at = at.where("c > 1").withColumn("lone", F.lit(0))
    place = F.row_number().over(Window.partitionBy("hub", "key").orderBy(F.desc("c"), F.desc("gram")))  # from the most frequent on
    # the overlap that the set needs with any partner; all but that many less one n-grams, rarest first, are its prefix
    need = F.greatest(F.lit(1), F.ceil((F.col("f") + F.when(F.col("linked"), F.col("low")).otherwise(F.least("best_f", "low"))) / (2 * p)))
    at = at.withColumn("place", place).where(F.col("place") >= need).select("hub", "gram", "key", "linked", "f", "place")
    pairs = at.where(~F.col("linked")).select("hub", "gram", F.col("key").alias("a"), F.col("f").alias("f_a"), F.col("place").alias("at_a")).join(at.select("hub", "gram", F.col("key").alias("b"), F.col("linked").alias("b_linked"), F.col("f").alias("f_b"), F.col("place").alias("at_b")), ["hub", "gram"])
    # no n-gram before the rarest shared one is shared, so from it on there are enough for the overlap
    pairs = pairs.where(2 * p * F.least("at_a", "at_b") >= F.col("f_a") + F.col("f_b"))
    pairs = pairs.where((F.col("a") < F.col("b")) | (F.col("b_linked") & (F.col("a") != F.col("b")))).select("a", "b").distinct()
    sets = rows.select("key", "n", "diff")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("diff").alias("diff_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("diff").alias("diff_b")), "b")
    d = F.size("diff_a") + F.size("diff_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    return star.union(both.where(p * d <= q * (F.col("n_a") + F.col("n_b"))).select("a", "b"))


def cross_candidates(hot: DataFrame, member: DataFrame, join: Join) -> DataFrame:
    """Pairs of hot sets of different groups that share a hot n-gram of their 1-prefixes.

    Groups that meet at an n-gram are paired first, so the members of one group are
    never set against each other. A set without a centre is a group of its own.
    """
    rows = hot.where(F.col("first") > F.col("cold")).join(member.select("key", "hub"), "key", "left")
    rows = rows.select("key", "n", F.coalesce("hub", "key").alias("hub"), F.explode(F.slice("grams", F.col("cold") + 1, F.col("first") - F.col("cold"))).alias("gram"))
    groups = rows.select("gram", "hub").distinct()
    several = groups.groupBy("gram").agg(F.count("*").alias("g")).where("g > 1").select("gram")
    groups = groups.join(several, "gram")
    meet = groups.select("gram", F.col("hub").alias("hub_a")).join(groups.select("gram", F.col("hub").alias("hub_b")), "gram").where("hub_a < hub_b")
    side = lambda x: rows.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "hub")])
    pairs = meet.join(side("a"), ["gram", "hub_a"]).join(side("b"), ["gram", "hub_b"]).where(_sized(join, "n_a", "n_b"))
    return pairs.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def few(join: Join) -> int:
    """The largest size of which a set differs by two n-grams at most from any set that it links to."""
    p, n = join.percent, 0
    while (100 - p) * (n + 1 + 100 * (n + 1) // p) < 3 * (100 + p):
        n += 1
    return n


def small_candidates(hot: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) that connect all linked sets of which the smaller has ``few`` n-grams at most.

    Every set is dealt out whole, without each n-gram, and without each two, as far as a set
    of the rest's size could link to it. Sets that meet so agree in all else, so all that
    meet are linked: each is paired with the whole one and with the first of those that lack
    one. The pairs are as many as the sets dealt out.
    """
    p = join.percent
    rows = hot.where(F.col("n") <= 100 * few(join) // p).select("key", "n", F.transform("grams", lambda g: F.xxhash64(g)).alias("h"))
    rows = rows.withColumn("whole", F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    one = F.transform("h", lambda x: F.col("whole").bitwiseXOR(x))
    two = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: F.col("whole").bitwiseXOR(x).bitwiseXOR(y))))
    none = F.array().cast("array<bigint>")
    levels = [F.array("whole"), F.when(100 * (F.col("n") - 1) >= p * F.col("n"), one).otherwise(none), F.when(100 * (F.col("n") - 2) >= p * F.col("n"), two).otherwise(none)]
    dealt = rows.select("key", "n", F.posexplode(F.array(*levels)).alias("level", "cores")).select("key", "level", (F.col("n") - F.col("level")).alias("m"), F.explode("cores").alias("core"))
    met = dealt.groupBy("core", "m").agg(F.count("*").alias("c"), F.min(F.when(F.col("level") == 0, F.col("key"))).alias("zero"), F.min(F.when(F.col("level") == 1, F.col("key"))).alias("first")).where("c > 1")
    both = dealt.join(met, ["core", "m"])
    near = 100 * F.col("m") >= p * (F.col("m") + 2)
    ends = F.array(F.when(F.col("level") > 0, F.col("zero")), F.when((F.col("level") == 1) & near, F.col("first")))
    pairs = both.select("key", F.explode(ends).alias("other")).where("other is not null and other <> key")
    return pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.where(100 * common >= join.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def linked_documents(df: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df``.

    component_id is the smallest id that links reach from the row, its own included.
    Texts without words are empty sets and linked with nothing, so each keeps its own
    id. Rows with equal sets are linked; repeated ids are rows of their own; a null id
    is never the smallest, so a component of such rows alone has none. Very long texts are
    sets as others; ties of ids cannot matter. Other columns are not read, and their names
    cannot clash. An empty table gives no rows.
    """
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).bitwiseAND((1 << REF_BITS) - 1).alias("ref"))
    share = df.sparkSession.sparkContext.broadcast
    live = small_side(sieved(docs, join), BROADCAST_REFS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.join(live, "ref", "left").select("doc_id", "text", "live").mapInArrow(_sets(join), f"doc_id {kind}, n_shingles long, key long, grams array<long>")
    sets = checkpointed(sets)
    rows = sets.where("key is not null").select("doc_id", "n_shingles", "key")
    found = checkpointed(sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("root"), F.first("grams").alias("grams")))
    table = share(frequent(found.select("grams"), join))
    classes = checkpointed(found.mapInArrow(_preparer(join, table), ORDERED.format(id=kind)))
    hot = classes.where(F.col("first") > F.col("cold"))
    large = hot.where(F.col("n") > few(join))  # of two sets that share hot n-grams only, either both are large or the small way finds them
    member = grouped(large, join)
    candidates = checkpointed(cold_candidates(classes, join).union(cross_candidates(large, member, join)).union(small_candidates(hot, join)).distinct())
    edges = verified(candidates, classes, join).union(group_links(member, join))
    parts = connected_components(edges)
    named = parts.join(classes.select(F.col("key").alias("node"), "root"), "node")
    lowest = named.groupBy("component").agg(F.min("root").alias("component_id"))
    moved = named.join(lowest, "component").select(F.col("node").alias("key"), "component_id")
    of_class = found.select("key", "root").join(moved, "key", "left").select("key", F.coalesce("component_id", "root").alias("component_id"))
    done = rows.join(small_side(of_class, BROADCAST_REFS), "key").select("doc_id", "n_shingles", "component_id")
    return done.union(sets.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
