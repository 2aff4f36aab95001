"""Pair features, one group after another.

``gathered`` puts the normalised records of both sides beside each pair (a_*, t_*); the
groups are then plain columns of one projection. Similarities that Spark lacks are Arrow
UDFs over whole batches. No feature is null.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import constants as C
from weftlink.functions import text as X
from weftlink.functions.fuzzy import indel, levenshtein_similarity, once, similarity
from weftlink.operators.pairwise import GRAMS

SIDE = ("business_name", "business_address", "name_norm", "address_norm", "country_norm", "postal_code", "city", "state", "street_number", "email", "email_domain", "website_domain", "phone")


def gathered(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, fields: Iterable[str] = SIDE) -> DataFrame:
    """``pairs`` with a_<field> and t_<field>; fields that the records lack are left out.

    Records of few bytes go to the pairs, which outnumber them by far and then stay where they are.
    """
    for key, side, records in (("anchor_id", "a", anchors), ("target_id", "t", targets)):
        own = [f for f in fields if f in records.columns]
        fetched = records.select(F.col("entity_id").alias(key), *[F.col(f).alias(f"{side}_{f}") for f in own])
        pairs = pairs.join(F.broadcast(fetched) if held_bytes(fetched) <= BROADCAST_BYTES else fetched, key)
    return pairs


#: Bytes of the records of one side that are broadcast.
BROADCAST_BYTES = 64 << 20


def held_bytes(df: DataFrame) -> int:
    """About what rows take in memory: text, and 16 bytes for each value and each entry of an array."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        size = size + 16 + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
        if kind.startswith("array"):
            size = size + 16 * F.greatest(F.size(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def both(field: str) -> tuple[Column, Column]:
    return F.col(f"a_{field}"), F.col(f"t_{field}")


def _flag(c: Column) -> Column:
    return c.cast("double")


def _count(c: Column) -> Column:
    return F.size(c).cast("double")


def text_features() -> dict[str, Column]:
    """Names and addresses: equality, Levenshtein, words, lengths, missing (18)."""
    out: dict[str, Column] = {}
    for prefix, raw in (("name", "business_name"), ("address", "business_address")):
        a, t = both(f"{prefix}_norm")
        wa, wt = F.array_distinct(X.split_words(a)), F.array_distinct(X.split_words(t))
        out |= {
            f"{prefix}_exact": X.equal(*both(raw)),
            f"{prefix}_normalized_exact": X.equal(a, t),
            f"{prefix}_levenshtein_similarity": (levenshtein_similarity if prefix == "address" else X.levenshtein_similarity)(a, t),
            f"{prefix}_jaccard_similarity": X.jaccard(wa, wt),
            f"{prefix}_token_overlap": _count(F.array_intersect(wa, wt)),
            f"{prefix}_length_difference": F.abs(F.length(a) - F.length(t)).cast("double"),
            f"{prefix}_length_ratio": X.length_ratio(a, t),
            f"{prefix}_left_missing": _flag(a == ""),
            f"{prefix}_right_missing": _flag(t == ""),
        }
    return out


def with_grams(records: DataFrame) -> DataFrame:
    """The n-gram sets of a record, made once instead of for each of its pairs."""
    return records.withColumns({f"{f}_{n}": X.ngrams(F.col(f), n) for f, n in GRAMS.values()})


def ngram_features(made: bool = False) -> dict[str, Column]:
    """Jaccard similarities of n-grams (4); ``made``: both sides come from ``with_grams``."""
    sets = lambda f, n: both(f"{f}_{n}") if made else tuple(X.ngrams(c, n) for c in both(f))
    return {name: X.jaccard(*sets(f, n)) for name, (f, n) in GRAMS.items()}


def component_features() -> dict[str, Column]:
    """Parts of the address and country: match, both present (10)."""
    out: dict[str, Column] = {}
    for name, field in (("postal_code",) * 2, ("city",) * 2, ("state",) * 2, ("street_number",) * 2, ("country", "country_norm")):
        a, t = both(field)
        out |= {f"{name}_match": X.equal(a, t), f"{name}_both_present": _flag((a != "") & (t != ""))}
    return out


def contact_features() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for field in ("email", "email_domain", "website_domain", "phone"):
        a, t = both(field)
        out |= {f"{field}_match": X.equal(a, t), f"{field}_both_present": _flag((a != "") & (t != ""))}
    a, t = both("phone")
    return out | {"phone_suffix_match": X.equal(F.right(a, F.lit(7)), F.right(t, F.lit(7)))}


def combined_feature() -> dict[str, Column]:
    one = lambda s: F.trim(F.concat(F.col(f"{s}_name_norm"), F.lit(" "), F.col(f"{s}_address_norm")))
    return {"name_address_combined_similarity": X.levenshtein_similarity(one("a"), one("t"))}


def rule_features() -> dict[str, Column]:
    """The rules that found the pair, their number, and whether the target is of source 3 (11)."""
    out = {f"blocked_by_{r}": _flag(F.col("mask").bitwiseAND(1 << i) != 0) for i, r in enumerate(C.RULES)}
    return out | {"number_of_blocking_rules": F.bit_count("mask").cast("double"), "candidate_source3": _flag(F.col("target_id").startswith("S3-"))}


def fuzzy_features() -> dict[str, Column]:
    return {
        "name_jaro_winkler": similarity("jaro_winkler", *both("name_norm")),
        "name_wratio": similarity("weighted", *both("name_norm")),
        "address_token_set_similarity": similarity("token_set", *both("address_norm")),
    }


def base_features(fuzzy: bool = True) -> dict[str, Column]:
    """The base group but for the TF-IDF cosines, which are a join (``tfidf_cosine``)."""
    return text_features() | ngram_features() | component_features() | (fuzzy_features() if fuzzy else {}) | contact_features() | combined_feature() | rule_features()


def coarse_features() -> dict[str, Column]:
    """Features of the retrieval ranker (27); two empty countries count as alike here."""
    out: dict[str, Column] = {}
    for prefix, kinds in (("name", ("indel", "weighted", "token_set", "token_sort", "jaro_winkler")), ("address", ("indel", "weighted", "token_set", "token_sort"))):
        names = {"indel": "ratio", "weighted": "wratio", "token_set": "token_set", "token_sort": "token_sort", "jaro_winkler": "jaro"}
        out |= {f"{prefix}_{names[k]}": similarity(k, *both(f"{prefix}_norm")) for k in kinds}
    for prefix in ("name", "address"):
        a, t = both(f"{prefix}_norm")
        out[f"{prefix}_length_ratio"] = F.least(F.length(a), F.length(t)) / F.greatest(F.lit(1), F.length(a), F.length(t))
    ca, ct = both("country_norm")
    out["country_match"] = _flag(ca == ct)
    for prefix in ("name", "address"):
        a, t = both(f"{prefix}_norm")
        out[f"{prefix}_missing"] = _flag((a == "") | (t == ""))
    na, nt = (F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x != "")) for c in both("address_norm"))
    out |= {"number_overlap": _count(F.array_intersect(na, nt)), "number_jaccard": F.size(F.array_intersect(na, nt)) / F.greatest(F.lit(1), F.size(F.array_union(na, nt)))}
    for prefix in ("name", "address"):
        wa, wt = (X.split_words(c) for c in both(f"{prefix}_norm"))
        out[f"{prefix}_token_jaccard"] = F.size(F.array_intersect(wa, wt)) / F.greatest(F.lit(1), F.size(F.array_union(wa, wt)))
    return out | rules()


def rules() -> dict[str, Column]:
    return {r: _flag(F.col("mask").bitwiseAND(1 << i) != 0) for i, r in enumerate(C.RULES)}


def with_runs(records: DataFrame) -> DataFrame:
    """``runs``: the distinct runs of digits of the address, joined by blanks."""
    found = F.filter(F.regexp_extract_all("address_norm", F.lit(r"\d+"), F.lit(0)), lambda x: x != "")
    return records.withColumn("runs", F.array_join(F.array_distinct(found), " "))


def with_conflicts(records: DataFrame) -> DataFrame:
    """``numbers`` of the address and ``core`` words of the name that conflicts are found by, joined by blanks."""
    core = F.array_except(F.array_distinct(X.split_words(F.col("name_norm"))), X.words_of(C.GENERIC_VETO))
    return records.withColumns({"numbers": F.array_join(X.numbers(F.col("address_norm")), " "), "core": F.array_join(core, " ")})


def with_rich(records: DataFrame) -> DataFrame:
    """What ``pairwise.rich_features`` asks of a record: its fields, its n-grams as one text each, and what conflicts are found by."""
    grams = {f"grams_{f}_{n}": F.array_join(X.ngrams(F.col(f), n), " ") for f, n in GRAMS.values()}
    x = with_conflicts(records).withColumns(grams | {"combined": F.trim(F.concat("name_norm", F.lit(" "), "address_norm")), "name": F.col("name_norm")})
    return x.select("entity_id", "name", *[f for f in SIDE if f not in ("name_norm", "email", "email_domain", "website_domain", "phone")], "numbers", "core", "combined", *grams)


def fallback_rank() -> Column:
    """The rank of a pair without a trained ranker: the better similarity and a part of the other.

    Names are compared as they stand, addresses by their words; a missing side counts 0.
    """
    n, a = similarity("indel", *both("name_norm")), similarity("token_set", *both("address_norm"))
    return F.greatest(n, a) + 0.35 * F.least(n, a)


def veto_features(fuzzy: bool = True) -> dict[str, Column]:
    """Conflicts that speak against a pair (14; 13 without the transliterated ratio)."""
    na, nt = (X.numbers(c) for c in both("address_norm"))
    shared, union = F.size(F.array_intersect(na, nt)), F.size(F.array_union(na, nt))
    first = lambda x: F.get(x, F.lit(0)).cast("decimal(38,0)")
    given = (F.size(na) > 0) & (F.size(nt) > 0)
    generic = X.words_of(C.GENERIC_VETO)
    ta, tt = (F.array_distinct(X.split_words(c)) for c in both("name_norm"))
    core_a, core_t = F.array_except(ta, generic), F.array_except(tt, generic)
    core = F.size(F.array_intersect(core_a, core_t))
    aa, at = (F.array_distinct(X.split_words(c)) for c in both("address_norm"))
    la, lt = X.legal_classes(ta), X.legal_classes(tt)
    ka, kt = X.categories(ta), X.categories(tt)
    indic = X.nonlatin(F.col("t_name_norm"))
    latin = F.when(indic > 0, X.transliterated_by_name(F.col("t_name_norm"))).otherwise(F.col("t_name_norm"))
    sounds = lambda words: F.transform(F.filter(F.array_except(words, generic), lambda w: F.length(w) > 2), X.soundex)
    out = {
        "address_number_conflict": _flag(given & (shared == 0)),
        "address_numeric_jaccard": F.when(union == 0, 1.0).otherwise(shared / F.greatest(F.lit(1), union)),
        "primary_num_diff": F.when(given, F.least(F.lit(100.0), F.abs(first(na) - first(nt)).cast("double"))).otherwise(0.0),
        "primary_num_match": F.when(given, _flag(first(na) == first(nt))).otherwise(0.5),
        "core_name_conflict": _flag((F.size(core_a) > 0) & (F.size(core_t) > 0) & (core == 0)),
        "core_name_jaccard": core / F.greatest(F.lit(1), F.size(F.array_union(core_a, core_t))),
        "shared_building_diff_name": _flag((F.size(F.array_intersect(aa, at)) / F.greatest(F.lit(1), F.size(F.array_union(aa, at))) >= 0.6) & (core == 0)),
        "acronym_score": X.acronym_score(*both("name_norm")),
        "legal_type_conflict": _flag((F.size(la) > 0) & (F.size(lt) > 0) & ~F.arrays_overlap(la, lt)),
        "category_conflict": _flag((F.size(ka) > 0) & (F.size(kt) > 0) & ~F.arrays_overlap(ka, kt)),
        "category_match": _flag(F.size(F.array_intersect(ka, kt)) > 0),
        "is_indic_target": indic,
        "phonetic_soundex_match": _flag(F.size(F.array_intersect(sounds(ta), sounds(X.split_words(latin)))) > 0),
    }
    return out | ({"indic_trans_ratio": similarity("indel", F.col("a_name_norm"), latin)} if fuzzy else {})


def enhanced_features(margins: bool = False) -> dict[str, Column]:
    """Missing addresses, conflicts that strong agreement elsewhere takes back, and margins (9).

    The margins are those of ``margin_features``; without a probability they are 0 and 1.
    """
    a, t = both("address_norm")
    no_a, no_t = F.trim(a) == "", F.trim(t) == ""
    ratio, place = similarity("indel", *both("name_norm")), F.when(no_a | no_t, 0.5).otherwise(similarity("token_set", a, t))
    v = veto_features(fuzzy=False)
    return {
        "is_target_addr_missing": _flag(no_t),
        "is_anchor_addr_missing": _flag(no_a),
        "addr_missing_either": _flag(no_a | no_t),
        "name_dominant_blank_addr": _flag(no_t & (ratio >= 0.75)),
        "name_exact_blank_addr": _flag(no_t & (F.col("a_name_norm") == F.col("t_name_norm"))),
        "veto_num_conflict_tempered": F.when((ratio >= 0.85) & (place >= 0.80), 0.0).otherwise(v["address_number_conflict"]),
        "veto_name_conflict_tempered": F.when(place >= 0.95, 0.0).otherwise(v["core_name_conflict"]),
        "margin_to_best": F.col("margin_to_best") if margins else F.lit(0.0),
        "is_top": F.col("is_top") if margins else F.lit(1.0),
    }


def margin_features(pairs: DataFrame) -> DataFrame:
    """``margin_to_best`` and ``is_top`` within anchor and source; 0 and 1 without a probability."""
    if "p" not in pairs.columns:
        return pairs.withColumns({"margin_to_best": F.lit(0.0), "is_top": F.lit(1.0)})
    m = F.max("p").over(Window.partitionBy("anchor_id", F.substring("target_id", 1, 2))) - F.col("p")
    return pairs.withColumn("margin_to_best", m).withColumn("is_top", _flag(F.col("margin_to_best") <= 1e-6))


def parts(name: Column, address: Column) -> dict[str, Column]:
    """Word sets of folded text: name, core, address, address_words, numbers, small_numbers, large_numbers."""
    words, place = F.array_distinct(X.split_words(name)), F.array_distinct(X.split_words(address))
    runs = F.filter(F.regexp_extract_all(address, F.lit(r"\d+"), F.lit(0)), lambda x: x != "")
    nums = F.array_distinct(F.transform(runs, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0"))))
    return {
        "name": words,
        "core": F.array_except(words, X.words_of(C.GENERIC_EVIDENCE)),
        "address": place,
        "address_words": F.filter(place, lambda t: ~t.rlike(r"\d")),
        "numbers": nums,
        "small_numbers": F.filter(nums, lambda x: F.length(x) < 5),
        "large_numbers": F.filter(nums, lambda x: F.length(x) >= 5),
    }


def evidence_set_features() -> dict[str, Column]:
    """Seven word sets of folded text: shared, covered, in conflict, on one side only (42)."""
    a, t = (parts(*(X.fold_accents(F.col(f"{s}_{f}")) for f in ("name_norm", "address_norm"))) for s in ("a", "t"))
    out: dict[str, Column] = {}
    for f in a:
        x, y = a[f], t[f]
        shared = F.size(F.array_intersect(x, y))
        out |= {
            f"{f}_intersection": shared.cast("double"),
            f"{f}_left_coverage": shared / F.greatest(F.lit(1), F.size(x)),
            f"{f}_right_coverage": shared / F.greatest(F.lit(1), F.size(y)),
            f"{f}_conflict": _flag((F.size(x) > 0) & (F.size(y) > 0) & (shared == 0)),
            f"{f}_left_only": _count(F.array_except(x, y)),
            f"{f}_right_only": _count(F.array_except(y, x)),
        }
    return out


def evidence_text_features() -> dict[str, Column]:
    n, a = (tuple(X.fold_accents(c) for c in both(f)) for f in ("name_norm", "address_norm"))
    core = [F.array_join(F.array_sort(parts(x, y)["core"]), " ") for x, y in zip(n, a, strict=True)]
    return {
        "name_fold_ratio": similarity("indel", *n),
        "name_fold_token_sort": similarity("token_sort", *n),
        "core_name_ratio": similarity("indel", *core),
        "address_fold_ratio": similarity("indel", *a),
        "address_partial_ratio": similarity("partial", *a),
        "name_nonlatin_left": X.nonlatin(n[0]),
        "name_nonlatin_right": X.nonlatin(n[1]),
    }


def corpus_stats(anchors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeated names by country, document frequency of words by country, and records by country."""
    words = anchors.select(F.col("country_norm").alias("country"), F.explode(F.array_distinct(X.split_words(F.col("name_norm")))).alias("token"))
    counts = anchors.groupBy(F.col("country_norm").alias("country"), F.col("name_norm").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    return counts, words.groupBy("country", "token").agg(F.count("*").alias("df")), anchors.groupBy(F.col("country_norm").alias("country")).agg(F.count("*").alias("size"))


IDF = ("name_idf_jaccard", "name_idf_left_coverage", "name_shared_max_idf", "name_unshared_max_idf", "name_anchor_frequency", "name_target_frequency")


def idf_features(pairs: DataFrame, stats: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Name frequencies and weighted word overlap (6); the weights are those of the anchor's country."""
    counts, df, sizes = stats
    key = ["anchor_id", "target_id"]
    wa, wt = (F.array_distinct(X.split_words(c)) for c in both("name_norm"))
    each = pairs.select(*key, F.col("a_country_norm").alias("country"), wa.alias("l"), wt.alias("r")).withColumn("token", F.explode(F.array_union("l", "r")))
    each = each.select(*key, "country", "token", F.array_contains("l", F.col("token")).alias("in_l"), F.array_contains("r", F.col("token")).alias("in_r"))
    each = each.join(df, ["country", "token"], "left").join(sizes, "country", "left")
    w = F.log1p(F.coalesce("size", F.lit(1)) / (1 + F.coalesce("df", F.lit(0))))
    each = each.withColumn("w", w)
    two = F.col("in_l") & F.col("in_r")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    sums = each.groupBy(*key).agg(
        (z(F.sum(F.when(two, F.col("w")))) / F.greatest(F.lit(1e-9), F.sum("w"))).alias("name_idf_jaccard"),
        (z(F.sum(F.when(two, F.col("w")))) / F.greatest(F.lit(1e-9), z(F.sum(F.when(F.col("in_l"), F.col("w")))))).alias("name_idf_left_coverage"),
        z(F.max(F.when(two, F.col("w")))).alias("name_shared_max_idf"),
        z(F.max(F.when(~two, F.col("w")))).alias("name_unshared_max_idf"),
    )
    out = pairs.join(sums, key, "left")
    for side, name in (("a", "anchor"), ("t", "target")):
        out = out.join(counts.select(F.col("country").alias(f"{side}_country_norm"), F.col("name").alias(f"{side}_name_norm"), F.col("n").alias(f"_{side}")), [f"{side}_country_norm", f"{side}_name_norm"], "left")
        out = out.withColumn(f"name_{name}_frequency", F.log1p(F.coalesce(f"_{side}", F.lit(1)))).drop(f"_{side}")
    return out.fillna(0.0, ["name_idf_jaccard", "name_idf_left_coverage", "name_shared_max_idf", "name_unshared_max_idf"])


#: The word sets of ``parts``, each as one text of a record.
EVIDENCE = ("name", "core", "address", "address_words", "numbers", "small_numbers", "large_numbers")


def with_evidence(records: DataFrame, stats: tuple[DataFrame, DataFrame, DataFrame], anchors: bool) -> DataFrame:
    """Records with what ``pairwise.evidence_features`` asks for; ``stats`` of ``corpus_stats``.

    ``evidence_<set>`` are the word sets of ``parts`` joined by blanks. ``idf`` has the weight
    of each word of the name: an anchor's in its own country, a target's in each country whose
    anchors have the word. ``idf_none`` is the weight of any other word in the own country.
    """
    counts, df, sizes = stats
    weights = df.join(sizes, "country").select("country", "token", F.log1p(F.col("size") / (1 + F.col("df"))).alias("v"))
    words = records.select("entity_id", F.col("country_norm").alias("country"), F.explode(F.array_distinct(X.split_words(F.col("name_norm")))).alias("token"))
    each = words.join(weights, ["country", "token"]) if anchors else words.drop("country").join(weights, "token")
    own = each.groupBy("entity_id").agg(F.collect_list(F.struct("token", "country", "v")).alias("idf"))
    x = records.join(own, "entity_id", "left").withColumn("idf", F.coalesce("idf", F.array().cast("array<struct<token:string,country:string,v:double>>")))
    x = x.join(sizes.select(F.col("country").alias("country_norm"), F.log1p(F.col("size")).alias("idf_none")), "country_norm", "left").withColumn("idf_none", F.coalesce("idf_none", F.log1p(F.lit(1))))
    x = x.join(counts.select(F.col("country").alias("country_norm"), F.col("name").alias("name_norm"), F.col("n").alias("_c")), ["country_norm", "name_norm"], "left")
    sets = parts(*(X.fold_accents(F.col(f)) for f in ("name_norm", "address_norm")))
    return x.withColumns({f"evidence_{k}": F.array_join(v, " ") for k, v in sets.items()} | {"idf_frequency": F.log1p(F.coalesce("_c", F.lit(1)))}).drop("_c")


def context_features(pairs: DataFrame) -> DataFrame:
    """A pair's probability among those of its anchor (13)."""
    w = Window.partitionBy("anchor_id")
    p = F.col("p")
    c = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0))
    out = {
        "base_probability": p,
        "base_logit": F.log(F.least(c(p), F.lit(1 - 1e-6)) / c(1 - p)),
        "probability_rank": F.rank().over(w.orderBy(F.desc("p"))).cast("double"),
        "group_max": F.max("p").over(w),
        "group_sum_others": F.sum("p").over(w) - p,
        "gap_to_max": F.max("p").over(w) - p,
    }
    out |= {f"others_above_{str(t).replace('.', '_')}": (F.count_if(p >= t).over(w) - (p >= t).cast("long")).cast("double") for t in (0.1, 0.3, 0.5, 0.675, 0.9, 0.99)}
    return pairs.withColumns(out | {"group_sum_squares_others": F.sum(p * p).over(w) - p * p})


PEER_MAXIMA = ("name_ratio", "name_sort", "core_ratio", "address_ratio", "address_set", "address_words", "numbers_jaccard", "number_equal", "exact_name", "exact_address", "joint", "name_with_address", "address_with_name", "name_weighted", "address_weighted", "joint_weighted", "same_source_joint", "other_source_joint")


def peer_features(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """What the best six other targets of an anchor with p of 0.15 or more say of a target (22)."""
    texts = targets.select(F.col("entity_id").alias("target_id"), F.col("name_norm").alias("n"), F.col("address_norm").alias("a"), *[v.alias(k) for k, v in parts(F.col("name_norm"), F.col("address_norm")).items() if k in ("core", "address_words", "numbers")])
    rows = pairs.select("anchor_id", "target_id", "p").join(texts, "target_id")
    peers = rows.withColumn("_r", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("p"), "target_id"))).where("_r <= 6 and p >= 0.15").drop("_r")
    side = lambda x, s: x.select("anchor_id", *[F.col(c).alias(f"{s}_{c}") for c in x.columns if c != "anchor_id"])
    two = side(rows, "x").join(side(peers, "y"), "anchor_id").where("x_target_id <> y_target_id")
    k = lambda kind, f: similarity(kind, F.col(f"x_{f}"), F.col(f"y_{f}"))
    joined = lambda s, f: F.array_join(F.col(f"{s}_{f}"), " ")
    two = two.withColumns({"nr": k("indel", "n"), "ns": k("token_sort", "n"), "cr": similarity("token_sort", joined("x", "core"), joined("y", "core")), "ar": k("indel", "a"), "aset": k("token_set", "a"), "aw": similarity("token_sort", joined("x", "address_words"), joined("y", "address_words"))})
    nx, ny, p = F.col("x_numbers"), F.col("y_numbers"), F.col("y_p")
    same = F.substring("x_target_id", 1, 2) == F.substring("y_target_id", 1, 2)
    two = two.withColumn("joint", F.when((F.col("x_a") != "") & (F.col("y_a") != ""), F.least("ns", "ar")).otherwise(F.col("ns") * 0.8))
    ns, ar, joint = F.col("ns"), F.col("ar"), F.col("joint")
    values = [F.col("nr"), ns, F.col("cr"), ar, F.col("aset"), F.col("aw"), F.size(F.array_intersect(nx, ny)) / F.greatest(F.lit(1), F.size(F.array_union(nx, ny))), _flag((F.size(nx) > 0) & (F.array_sort(nx) == F.array_sort(ny))), X.equal(F.col("x_n"), F.col("y_n")), X.equal(F.col("x_a"), F.col("y_a")), joint, F.when(ar > 0.85, ns).otherwise(0.0), F.when(ns > 0.85, ar).otherwise(0.0), p * ns, p * ar, p * joint, F.when(same, p * joint).otherwise(0.0), F.when(~same, p * joint).otherwise(0.0)]
    strong = p >= 0.9
    against = (F.size(F.array_except(nx, ny)) > 0) & (F.size(F.array_except(ny, nx)) > 0)
    sums = two.groupBy("anchor_id", F.col("x_target_id").alias("target_id")).agg(
        *[F.max(v).alias(f"peer_{n}") for n, v in zip(PEER_MAXIMA, values, strict=True)],
        F.count_if(strong).cast("double").alias("peer_strong_count"),
        F.count_if(strong & (joint >= 0.85)).cast("double").alias("peer_support_count"),
        F.count_if(strong & against).cast("double").alias("peer_number_contradiction_count"),
        F.max(p).alias("peer_max_probability"),
    )
    return pairs.join(sums, ["anchor_id", "target_id"], "left").fillna(0.0, [c for c in sums.columns if c.startswith("peer_")])


def detail_views(side: str) -> dict[str, Column]:
    """Five views of a record's text, its core words, and its numbers in order."""
    stop = X.words_of(C.GENERIC_EVIDENCE)
    name, place = (X.romanized(F.col(f"{side}_{f}")) for f in ("name_norm", "address_norm"))
    words = X.split_words(name)
    core = F.filter(words, lambda t: ~F.array_contains(stop, t))
    bones, stop_bones = F.transform(core, X.skeleton), F.transform(stop, X.skeleton)
    runs = F.filter(F.regexp_extract_all(place, F.lit(r"\d+"), F.lit(0)), lambda x: x != "")
    return {
        "ascii_name": name,
        "ascii_core": F.array_join(core, " "),
        "phonetic_name": F.array_join(F.transform(words, X.skeleton), " "),
        "phonetic_core": F.array_join(F.filter(bones, lambda t: ~F.array_contains(stop_bones, t)), " "),
        "ascii_address": place,
        "core": core,
        "numbers": F.transform(runs, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0"))),
    }


VIEWS = ("ascii_name", "ascii_core", "phonetic_name", "phonetic_core", "ascii_address")


def with_details(records: DataFrame) -> DataFrame:
    """The views of a record, made once instead of for each of its pairs (detail_<view>)."""
    own = records.select("*", *[F.col(f).alias(f"x_{f}") for f in ("name_norm", "address_norm")])
    return own.withColumns({f"detail_{k}": v for k, v in detail_views("x").items()}).drop("x_name_norm", "x_address_norm")


def detail_features(made: bool = False) -> dict[str, Column]:
    """Five views of the text, soft alignment of core words, numbers in order, lengths (42; frequencies: ``detail_frequencies``).

    ``made``: both sides come from ``with_details``.
    """
    x, y = ({k: F.col(f"{s}_detail_{k}") for k in (*VIEWS, "core", "numbers")} if made else detail_views(s) for s in ("a", "t"))
    out: dict[str, Column] = {}
    for view in VIEWS:
        out |= {f"detail_{view}_{short}": similarity(kind, x[view], y[view]) for short, kind in (("ratio", "indel"), ("sort", "token_sort"), ("set", "token_set"))}
    out |= {f"detail_{view}_partial": similarity("partial", x[view], y[view]) for view in ("ascii_name", "ascii_address")}
    soft = soft_alignment(x["ascii_core"], y["ascii_core"])
    for side in ("left", "right"):
        out |= {f"detail_soft_{side}_{m}": soft[f"{side}_{m}"] for m in ("mean", "min", "unmatched", "weighted")}
    nx, ny = x["numbers"], y["numbers"]
    joined = lambda v: F.array_join(v, " ")
    sx, sy = F.array_distinct(nx), F.array_distinct(ny)
    any_two = (F.size(nx) > 0) & (F.size(ny) > 0)
    out |= {
        "detail_number_sequence_ratio": similarity("indel", joined(nx), joined(ny)),
        "detail_number_sorted_ratio": similarity("indel", joined(F.array_sort(nx)), joined(F.array_sort(ny))),
        "detail_number_first_equal": F.coalesce(_flag(any_two & (F.get(nx, F.lit(0)) == F.get(ny, F.lit(0)))), F.lit(0.0)),
        "detail_number_last_equal": F.coalesce(_flag(any_two & (F.get(nx, F.size(nx) - 1) == F.get(ny, F.size(ny) - 1))), F.lit(0.0)),
        "detail_number_left_count": _count(nx),
        "detail_number_right_count": _count(ny),
        "detail_number_left_only": _count(F.array_except(sx, sy)),
        "detail_number_right_only": _count(F.array_except(sy, sx)),
        "detail_number_jaccard": F.size(F.array_intersect(sx, sy)) / F.greatest(F.lit(1), F.size(F.array_union(sx, sy))),
        "detail_number_subset": _flag(any_two & ((F.size(F.array_except(sx, sy)) == 0) | (F.size(F.array_except(sy, sx)) == 0))),
    }
    for side, v in (("left", x), ("right", y)):
        out |= {f"detail_{side}_name_length": F.length(v["ascii_name"]).cast("double"), f"detail_{side}_address_length": F.length(v["ascii_address"]).cast("double"), f"detail_{side}_core_count": _count(v["core"])}
    return out | {"detail_source3": _flag(F.col("target_id").startswith("S3"))}


def detail_frequencies(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``pairs`` with the frequencies of both romanised names in their own countries (2); ``counts``: the first of ``corpus_stats``."""
    for side, name in (("a", "left"), ("t", "right")):
        pairs = pairs.withColumn("_n", X.romanized(F.col(f"{side}_name_norm")))
        own = counts.select(F.col("country").alias(f"{side}_country_norm"), F.col("name").alias("_n"), F.col("n").alias("_c"))
        pairs = pairs.join(own, [f"{side}_country_norm", "_n"], "left").withColumn(f"detail_{name}_name_frequency", F.log1p(F.coalesce("_c", F.lit(1)))).drop("_c", "_n")
    return pairs


def with_own_frequency(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Records of ``with_details`` with what the pairs of a cell need besides: the numbers as one text, the number of core words, and the frequency of ``detail_frequencies``."""
    own = counts.select(F.col("country").alias("country_norm"), F.col("name").alias("detail_ascii_name"), F.col("n").alias("_c"))
    x = records.join(own, ["country_norm", "detail_ascii_name"], "left")
    return x.withColumns({"detail_runs": F.array_join("detail_numbers", " "), "detail_cores": _count(F.col("detail_core")), "detail_frequency": F.log1p(F.coalesce("_c", F.lit(1)))}).drop("_c")


def soft_alignment(a: Column, b: Column) -> dict[str, Column]:
    """How well each of the twelve longest words of a side is met by any of the other's.

    All words of a batch are compared in one call of the kernel.
    """

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict[str, list[str]] = {}
        kept = lambda s: known[s] if s in known else known.setdefault(s, sorted(s.split(), key=lambda t: (-len(t), t))[:12])
        sides = [(kept(p), kept(q)) for p, q in zip(x.fillna(""), y.fillna(""), strict=True)]
        found = once(indel, [u for p, q in sides for u in p for _ in q], [v for p, q in sides for _ in p for v in q])
        at, out = 0, np.zeros((len(sides), 8))
        for i, (p, q) in enumerate(sides):
            grid = found[at : at + len(p) * len(q)].reshape(len(p), len(q))
            at += grid.size
            for k, (own, best) in enumerate(((p, grid.max(axis=1, initial=0.0)), (q, grid.max(axis=0, initial=0.0)))):
                if own:
                    size = np.array([len(t) for t in own])
                    out[i, 4 * k : 4 * k + 4] = best.mean(), best.min(), (best < 0.65).sum(), (size * best).sum() / max(1, size.sum())
        return pd.DataFrame(out, columns=names)

    names = [f"{s}_{m}" for s in ("left", "right") for m in ("mean", "min", "unmatched", "weighted")]
    found = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(a, b)
    return {n: found[n] for n in names}


def char_grams(c: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams, repeats and blanks included."""

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1))
        return F.when(F.length(c) >= n, F.transform(at, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast(X.EMPTY))

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def tfidf_fit(records: DataFrame, field: str, max_features: int) -> DataFrame:
    """(term, idf) of the terms with the largest totals; ln((1 + N) / (1 + df)) + 1."""
    n = records.count()
    terms = records.select("entity_id", F.explode(char_grams(F.col(field))).alias("term")).groupBy("entity_id", "term").agg(F.count("*").alias("tf"))
    totals = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    return totals.orderBy(F.desc("total"), "term").limit(max_features).select("term", (F.log((F.lit(1 + n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(records: DataFrame, field: str, idf: DataFrame) -> DataFrame:
    """(entity_id, terms, weights): one sparse vector of unit length for each record that has a known term.

    Terms are 64-bit hashes, in order.
    """
    terms = records.select("entity_id", F.explode(char_grams(F.col(field))).alias("term")).groupBy("entity_id", "term").agg(F.count("*").alias("tf"))
    raw = terms.join(idf, "term").select("entity_id", F.struct(F.xxhash64("term").alias("h"), (F.col("tf") * F.col("idf")).alias("w")).alias("x"))
    whole = raw.groupBy("entity_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v["w"] * v["w"]))
    return whole.select("entity_id", F.transform("x", lambda v: v["h"]).alias("terms"), F.transform("x", lambda v: v["w"] / length).alias("weights"))


def _dot(a: pd.Series, wa: pd.Series, b: pd.Series, wb: pd.Series) -> pd.Series:
    sides = []
    for terms, weights in ((a, wa), (b, wb)):
        rows = [np.zeros(0, np.int64) if t is None else t for t in terms]
        row = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
        flat = np.concatenate([np.zeros(0), *[w for w in weights if w is not None]])
        key = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64).view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sides.append((key, row, flat))
    (ka, row, x), (kb, _, y) = sides
    if not len(ka) or not len(kb):
        return pd.Series(np.zeros(len(a)))
    order = np.argsort(kb)
    at = np.minimum(np.searchsorted(kb, ka, sorter=order), len(kb) - 1)
    hit = kb[order[at]] == ka
    return pd.Series(np.bincount(row[hit], x[hit] * y[order[at]][hit], len(a)))


def tfidf_cosine(pairs: DataFrame, anchor_vectors: DataFrame, target_vectors: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the cosine of both sides; 0 where they share no known term. A pair is one row throughout."""
    a = anchor_vectors.select(F.col("entity_id").alias("anchor_id"), F.col("terms").alias("_ta"), F.col("weights").alias("_wa"))
    t = target_vectors.select(F.col("entity_id").alias("target_id"), F.col("terms").alias("_tt"), F.col("weights").alias("_wt"))
    wide = pairs.join(a, "anchor_id", "left").join(t, "target_id", "left")
    return wide.withColumn(name, F.pandas_udf(_dot, "double")("_ta", "_wa", "_tt", "_wt")).drop("_ta", "_wa", "_tt", "_wt")


def cosine(a: Column, b: Column) -> Column:
    """Of two embeddings; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def assembled(df: DataFrame, groups: Iterable[dict[str, Column]], names: Iterable[str] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """The pair and ``keep`` with its features as floats, in the locked order of ``names``, or as given."""
    all_: dict[str, Column] = {}
    for g in groups:
        all_ |= g
    names = list(names or all_)
    return df.select("anchor_id", "target_id", *keep, *[F.coalesce(all_[n].cast("float"), F.lit(0.0).cast("float")).alias(n) for n in names])
