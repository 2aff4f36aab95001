"""Candidate generation: posting limits, key joins, unions and their reports.

A limit is laid on the target side only: a key of more targets than that is dropped, so
the join that follows meets at most ``limit`` rows for each key of an anchor, and no key
is a hot spot whatever the data. Counting keys is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import constants as C
from weftlink.functions import text as X
from weftlink.operators import cells
from weftlink.operators import keys as K
from weftlink.operators.features import BROADCAST_BYTES, held_bytes
from weftlink.operators.keys import BIT


@dataclass(frozen=True)
class Retrieval:
    """Limits of the in-memory mode: postings of a key, and what the address and n-gram rules ask for."""

    max_posting: int = 5000
    floor: int = 20
    max_share: float = 0.2
    address_overlap: int = 2
    gram_overlap: int = 3
    gram_jaccard: float = 0.12
    strong_ratio: float = 0.88


def frequent_keys(keys: DataFrame, limit: Column | int) -> DataFrame:
    """(key, n): keys with more postings than ``limit``."""
    return keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def posting_bound(limit: int, wide: dict[str, int] | None = None) -> Column:
    """The limit of a key: ``limit``, or that of its prefix."""
    bound: Column = F.lit(limit)
    for prefix, n in (wide or {}).items():
        bound = F.when(F.col("key").startswith(f"{prefix}|"), F.lit(n)).otherwise(bound)
    return bound


def limited(target_keys: DataFrame, limit: int, wide: dict[str, int] | None = None) -> DataFrame:
    """Target keys without the too frequent ones; ``wide`` has other limits by the key's prefix.

    Only keys in need of removal move: they are counted and joined out, and Spark
    broadcasts them where their checked size allows.
    """
    return target_keys.join(frequent_keys(target_keys, posting_bound(limit, wide)).select("key"), "key", "left_anti")


def generic_limit(n_targets: int, max_posting: int, floor: int, max_share: float) -> int:
    """The limit of word and n-gram keys of the in-memory mode."""
    return min(max_posting, max(floor, int(n_targets * max_share)))


def memory_keys(anchors: DataFrame, targets: DataFrame, n_targets: int, r: Retrieval = Retrieval()) -> tuple[DataFrame, DataFrame]:
    """The keys of all six rules: of anchors, and of targets without the too frequent ones.

    Names, cities and postal codes have the whole limit; words and n-grams a share of the targets.
    """
    a, t = (K.key_table(x, K.memory_families()) for x in (anchors, targets))
    return a, limited(t, *_limits(n_targets, r))


def _limits(n_targets: int, r: Retrieval) -> tuple[int, dict[str, int]]:
    return generic_limit(n_targets, r.max_posting, r.floor, r.max_share), dict.fromkeys("PNC", r.max_posting)


def memory_candidates(anchors: DataFrame, targets: DataFrame, n_targets: int, r: Retrieval = Retrieval(), measures: Callable | None = None, fields: Sequence[str] = (), columns: Sequence[str] = (), without: int = 0, listed: bool = False, packed: bool = False) -> DataFrame:
    """(anchor_id, target_id, mask): pairs that any of the six rules of the in-memory mode finds.

    What pairs share is counted block against block (``cells``). Four rules need one key;
    the address rule needs several words, the n-gram rule several n-grams and a Jaccard
    similarity of the whole sets. Names that share as many n-grams and are alike enough
    count as strong. ``measures`` adds ``columns``, worked out from ``fields`` of both
    records where the pair is found. Pairs of the rules ``without`` are left out.
    If ``listed``, (anchor_id, targets): a few lists for each anchor in place of pairs.
    If ``packed``, such lists with p as bytes (``cells.PACKED``).
    """
    families = K.memory_families()
    lists, grams = K.key_lists(families), F.size(families["name_ngram"])
    side = lambda x: x.select("entity_id", F.col("name_norm").alias("name"), grams.alias("grams"), lists.alias("k"), *fields).select("entity_id", "name", "grams", F.col("k.key").alias("keys"), F.col("k.bit").alias("bits"), *fields)
    frequent = frequent_keys(K.key_table(targets, families), posting_bound(*_limits(n_targets, r))).select("key")
    limits = (r.address_overlap, r.gram_overlap, r.gram_jaccard, r.strong_ratio)
    return cells.met(side(anchors), side(targets), frequent, anchors.count(), n_targets, limits, measures, columns, without, listed, packed)


def candidates(anchor_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(anchor_id, target_id, mask): pairs that share a key, with the rules of all shared ones."""
    a = anchor_keys.select(F.col("entity_id").alias("anchor_id"), "key")
    t = target_keys.select(F.col("entity_id").alias("target_id"), "key", "bit")
    return a.join(t, "key").groupBy("anchor_id", "target_id").agg(F.bit_or("bit").alias("mask"))


def merged(*lists: DataFrame) -> DataFrame:
    """One row for each pair of any list, with the rules of all."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.groupBy("anchor_id", "target_id").agg(F.bit_or("mask").alias("mask"))


def shared_counts(anchor_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(anchor_id, target_id, shared): the number of keys that pairs share."""
    a = anchor_keys.select(F.col("entity_id").alias("anchor_id"), "key")
    t = target_keys.select(F.col("entity_id").alias("target_id"), "key")
    return a.join(t, "key").groupBy("anchor_id", "target_id").agg(F.count("*").alias("shared"))


def overlap_join(anchor_keys: DataFrame, target_keys: DataFrame, least: int) -> DataFrame:
    """Pairs that share ``least`` keys or more."""
    return shared_counts(anchor_keys, target_keys).where(F.col("shared") >= least)


def ngram_join(anchors: DataFrame, targets: DataFrame, anchor_keys: DataFrame, target_keys: DataFrame, min_overlap: int = 3, min_jaccard: float = 0.12) -> DataFrame:
    """Pairs that share enough n-grams and reach a Jaccard similarity.

    The overlap counts the kept keys only; the similarity is that of the whole sets
    ``grams`` of both sides.
    """
    pairs = overlap_join(anchor_keys, target_keys, min_overlap)
    pairs = pairs.join(anchors.select(F.col("entity_id").alias("anchor_id"), F.col("grams").alias("ga")), "anchor_id").join(targets.select(F.col("entity_id").alias("target_id"), F.col("grams").alias("gt")), "target_id")
    return pairs.withColumn("jaccard", X.jaccard(F.col("ga"), F.col("gt"))).where(F.col("jaccard") >= min_jaccard).drop("ga", "gt")


def exact_name_join(anchors: DataFrame, targets: DataFrame, limit: int = Retrieval.max_posting) -> DataFrame:
    """Pairs of equal, non-empty normalised names, in any country; names of more than ``limit`` targets are no keys."""
    name = lambda x: x.where("name_norm <> ''").select("entity_id", F.col("name_norm").alias("key"))
    a, t = name(anchors).withColumnRenamed("entity_id", "anchor_id"), limited(name(targets), limit).withColumnRenamed("entity_id", "target_id")
    return a.join(t, "key").select("anchor_id", "target_id")


def country_only_pairs(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """(n_pairs): pairs of one country, counted and never made."""
    a, t = (x.where("country_norm <> ''").groupBy("country_norm").agg(F.count("*").alias(n)) for x, n in ((anchors, "a"), (targets, "t")))
    return a.join(t, "country_norm").agg(F.coalesce(F.sum(F.col("a") * F.col("t")), F.lit(0)).cast("long").alias("n_pairs"))


def top_k(pairs: DataFrame, score: str, k: int, tie: str = "target_id") -> DataFrame:
    """The best ``k`` pairs of each anchor; Spark cuts groups before the shuffle as well."""
    w = Window.partitionBy("anchor_id").orderBy(F.desc(score), tie)
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_k_recall(pairs: DataFrame, truth: DataFrame, score: str, ks: tuple[int, ...] = (8, 16, 32, 64, 128)) -> DataFrame:
    """(k, found, recall): the share of true pairs among the best k of their anchors."""
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc(score), "target_id")))
    hit = truth.join(ranked.select("anchor_id", "target_id", "place"), ["anchor_id", "target_id"], "left")
    sums = hit.agg(F.count("*").alias("n"), *[F.count_if(F.col("place") <= k).alias(f"k{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("found")) for k in ks])).alias("r")
    return sums.select("n", rows).select("r.k", "r.found", F.round(F.try_divide("r.found", "n"), 6).alias("recall"))


def reserved_top_k(pairs: DataFrame, score: str, k: int, rule: str, slots: int, boost: float = 0.0) -> DataFrame:
    """The best ``k`` with ``slots`` places kept for pairs of a rule, whose scores may get a boost."""
    own = F.col("mask").bitwiseAND(BIT[rule]) != 0
    scored = pairs.withColumn("_s", F.col(score) + F.when(own, boost).otherwise(0.0)).withColumn("_own", own)
    within = F.row_number().over(Window.partitionBy("anchor_id", "_own").orderBy(F.desc("_s"), "target_id"))
    first = scored.withColumn("_kept", F.col("_own") & (within <= slots))
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("_kept"), F.desc("_s"), "target_id"))
    return first.withColumn("place", place).where(F.col("place") <= k).drop("_s", "_own", "_kept")


def with_rules(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("blocking_rules", X.rules_text(F.col("mask")))


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it takes few bytes by count."""
    return F.broadcast(df) if held_bytes(df) <= BROADCAST_BYTES else df


def among(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The true ones of ``pairs``, which stay where they are if the truth is small."""
    return pairs.select("anchor_id", "target_id").join(_small(truth.select("anchor_id", "target_id")), ["anchor_id", "target_id"], "left_semi")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``label`` 1 for true pairs."""
    marks = _small(truth.select("anchor_id", "target_id").distinct()).withColumn("label", F.lit(1))
    return pairs.join(marks, ["anchor_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def candidate_report(pairs: DataFrame, truth: DataFrame, anchors: DataFrame, n_targets: int) -> DataFrame:
    """Recall, mean candidates, reduction ratio and share of anchors without any."""
    n_anchors = anchors.select("anchor_id").distinct()
    per = n_anchors.join(pairs.groupBy("anchor_id").agg(F.count("*").alias("c")), "anchor_id", "left")
    true = truth.agg(F.count("*").alias("n_true"))
    found = truth.join(among(pairs, truth), ["anchor_id", "target_id"], "left_semi").agg(F.count("*").alias("found"))
    total = per.agg(F.count("*").alias("n_anchors"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_pairs"), F.count_if(F.col("c").isNull()).alias("n_zero"))
    one = total.crossJoin(F.broadcast(true)).crossJoin(F.broadcast(found))  # one row each
    return one.select(
        "n_pairs",
        F.round(F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("found") / F.col("n_true")), 6).alias("recall"),
        F.round(F.col("n_pairs") / F.col("n_anchors"), 6).alias("mean_candidates"),
        F.round(1 - F.col("n_pairs") / (F.col("n_anchors") * n_targets), 6).alias("reduction"),
        F.round(F.col("n_zero") / F.col("n_anchors"), 6).alias("zero_share"),
    )


def rule_report(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(rule, n_pairs, n_true) for each rule and, as ``combined``, for all pairs: counts of masks, then of their bits."""
    p = labelled(pairs, truth).groupBy("mask").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    names = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(C.RULES)]), lambda x: x.isNotNull())
    each = p.select(F.explode(F.concat(names, F.array(F.lit("combined")))).alias("rule"), "n", "t")
    return each.groupBy("rule").agg(F.sum("n").alias("n_pairs"), F.sum("t").cast("long").alias("n_true"))


def retrieval_audit(raw: DataFrame, retained: DataFrame, truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """(scope, rule, n, n_true): counters of a retrieval.

    For each rule the raw candidates and the true ones among raw and retained pairs; for
    anchors how many have no, one or several candidates, and how many the cap cut.
    """
    kept = retained.select("anchor_id", "target_id").withColumn("_k", F.lit(1))
    x = labelled(raw, truth).join(kept, ["anchor_id", "target_id"], "left")
    names = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(C.RULES)], F.lit("all")), lambda r: r.isNotNull())
    each = x.select(F.explode(names).alias("rule"), "label", "_k").groupBy("rule").agg(F.count("*").alias("n"), F.sum("label").alias("raw_true"), F.count("_k").alias("k"), F.sum(F.when(F.col("_k") == 1, F.col("label"))).alias("kept_true"))
    rules = each.select(F.explode(F.array(F.struct(F.lit("raw").alias("scope"), F.col("n"), F.col("raw_true").alias("n_true")), F.struct(F.lit("retained").alias("scope"), F.col("k").alias("n"), F.col("kept_true").alias("n_true")))).alias("s"), "rule").select("s.scope", "rule", "s.n", F.coalesce("s.n_true", F.lit(0)).cast("long").alias("n_true"))
    per = anchors.select("anchor_id").join(x.groupBy("anchor_id").agg(F.count("*").alias("r"), F.count("_k").alias("k")), "anchor_id", "left").fillna(0, ["r", "k"])
    k, r = F.col("k"), F.col("r")
    sums = per.agg(F.count("*").alias("anchors"), F.count_if(k == 0).alias("no candidate"), F.count_if(k == 1).alias("one candidate"), F.count_if(k > 1).alias("several candidates"), F.count_if(r > k).alias("cut by the cap"), F.max(r).alias("most raw candidates"), F.max(k).alias("most candidates"))
    rows = sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, sums.columns)), F.array(*[F.col(f"`{c}`") for c in sums.columns]))).alias("rule", "n"))
    return rules.unionByName(rows.select(F.lit("anchors").alias("scope"), "rule", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("n_true")))


def missed_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs that are not candidates."""
    return truth.join(among(pairs, truth), ["anchor_id", "target_id"], "left_anti")


def gap(raw: DataFrame, retained: DataFrame, truth: DataFrame) -> DataFrame:
    """(state, n): true pairs that were retained, cut by the cap, or never retrieved."""
    marks = lambda x, c: x.select("anchor_id", "target_id").distinct().withColumn(c, F.lit(True))
    t = truth.join(marks(raw, "r"), ["anchor_id", "target_id"], "left").join(marks(retained, "k"), ["anchor_id", "target_id"], "left")
    return t.groupBy(F.when(F.col("k"), "retained").when(F.col("r"), "capped").otherwise("never").alias("state")).agg(F.count("*").alias("n"))


def rank_positions(pairs: DataFrame, truth: DataFrame, score: str, k: int) -> DataFrame:
    """(anchor_id, target_id, place): true pairs that a cut at ``k`` drops, and where they stand."""
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc(score), "target_id")))
    return truth.join(ranked.select("anchor_id", "target_id", "place").where(F.col("place") > k), ["anchor_id", "target_id"])


def channel_what_if(missed: DataFrame, anchors: DataFrame, targets: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """(channel, n): missed pairs whose records share a key of a channel, and of any."""
    names = list(channels)
    side = lambda x, key, s: x.select(F.col("entity_id").alias(key), *[c.alias(f"{s}{i}") for i, c in enumerate(channels.values())])
    both = missed.join(side(anchors, "anchor_id", "a"), "anchor_id").join(side(targets, "target_id", "t"), "target_id")
    hits = [F.coalesce(F.arrays_overlap(f"a{i}", f"t{i}"), F.lit(False)) for i in range(len(names))]
    found = F.filter(F.array(*[F.when(h, F.lit(n)) for h, n in zip(hits, names, strict=True)]), lambda x: x.isNotNull())
    each = both.select(F.explode(F.when(F.size(found) > 0, F.concat(found, F.array(F.lit("any")))).otherwise(F.array(F.lit("none")))).alias("channel"))
    return each.groupBy("channel").agg(F.count("*").alias("n"))


def location_channels(missed: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """(channel, n): missed pairs that two further channels would find, either of them, and all.

    Phonetic: a sound of the (transliterated) name and a number or word of the address are
    shared. Relaxed address: one country, and a number with a word, or two words.
    """
    generic, stop = X.words_of(C.GENERIC_VETO), X.words_of(C.GENERIC_SOUNDEX)
    sounds = F.array_except(F.transform(F.filter(X.split_words(X.transliterated_by_name(F.col("name_norm"))), lambda w: (F.length(w) > 2) & ~F.array_contains(generic, w)), X.soundex), stop)
    side = lambda x, key, s: x.select(F.col("entity_id").alias(key), sounds.alias(f"{s}_s"), X.numbers(F.col("address_norm")).alias(f"{s}_n"), K.address_words(F.col("address_norm")).alias(f"{s}_w"), F.col("country_norm").alias(f"{s}_c"))
    x = missed.join(side(anchors, "anchor_id", "a"), "anchor_id").join(side(targets, "target_id", "t"), "target_id")
    met = lambda f: F.size(F.array_intersect(f"a_{f}", f"t_{f}"))
    one, two = (met("s") > 0) & ((met("n") > 0) | (met("w") > 0)), (F.col("a_c") == F.col("t_c")) & (((met("n") > 0) & (met("w") > 0)) | (met("w") >= 2))
    sums = x.agg(F.count_if(one).alias("phonetic"), F.count_if(two).alias("relaxed_address"), F.count_if(one | two).alias("either"), F.count("*").alias("missed"))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, sums.columns)), F.array(*sums.columns))).alias("channel", "n"))


#: The rules that see no more of a record than its name and country.
NAMED = BIT["country_name"] | BIT["name_ngram"] | BIT["strong_name"]


def alias_pairs(scored: DataFrame, targets: DataFrame, threshold: float = 0.95, limit: int = 20) -> DataFrame:
    """New pairs (anchor_id, target_id): targets that share name and country with one that an anchor surely has.

    Names of more than ``limit`` targets are left out; pairs that exist are not repeated.
    ``scored`` may lack the pairs of ``NAMED`` rules: these look at name and country only,
    so they find all targets of one name and country or none, and nothing new follows.
    """
    named = targets.where("name_norm <> ''").select(F.col("entity_id").alias("target_id"), "name_norm", "country_norm")
    sure = scored.where(F.col("p") >= threshold).join(named, "target_id").select("anchor_id", "name_norm", "country_norm").distinct()
    few = named.join(named.groupBy("name_norm", "country_norm").agg(F.count("*").alias("n")).where(F.col("n") <= limit), ["name_norm", "country_norm"]).drop("n")
    return sure.join(few, ["name_norm", "country_norm"]).select("anchor_id", "target_id").distinct().join(scored.select("anchor_id", "target_id"), ["anchor_id", "target_id"], "left_anti")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, n_right): records of one set that another has too, by name, address and country.

    ``right_id`` is the first of the ``n_right`` equal records of the other set, so a group
    of equal rows gives one row for each left record, not all pairs.
    """
    on = ["name_norm", "address_norm", "country_norm"]
    first = right.groupBy(*on).agg(F.min("entity_id").alias("right_id"), F.count("*").alias("n_right"))
    return left.select(F.col("entity_id").alias("left_id"), *on).join(first, on).select("left_id", "right_id", "n_right")
