"""One-pass profile of a source, and categories of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import constants as C
from weftlink.functions import text as X
from weftlink.functions.fuzzy import similarity

FIELDS = ("business_name", "business_address", "country")


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, ids, missing and near-empty fields, character classes, and hints of contacts."""
    text = F.concat_ws(" ", *FIELDS)
    name, place = F.col("business_name"), F.col("business_address")
    n = lambda c, a: F.count_if(F.coalesce(c, F.lit(False))).alias(a)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("entity_id").alias("n_ids"),
        (F.count("entity_id") - F.count_distinct("entity_id")).alias("n_repeated_ids"),
        *[n(blank(F.col(f)), f"missing_{f}") for f in FIELDS],
        F.count_distinct(F.when(~blank(F.col("country")), F.col("country"))).alias("n_countries"),
        n(F.length(F.trim(name)) < 3, "near_empty_names"),
        n(name.rlike(r"[^\x00-\x7F]"), "non_ascii_names"),
        n(name.rlike("[A-Z]"), "uppercase_names"),
        n(name.rlike(r"(?U)[^\w\s]"), "punctuated_names"),
        n(text.rlike(r"(?i)https?://|www\."), "with_url"),
        n(text.rlike(r"[\w.]+@[\w-]+\.\w+"), "with_email"),
        n(text.rlike(r"(?i)\b(?:tel|phone|mobile|mob)"), "with_phone"),
        n(blank(name) & blank(place), "without_identifiers"),
    )


def repeated_records(df: DataFrame) -> DataFrame:
    """(n_groups, n_rows): records that agree in all fields but the id."""
    g = df.groupBy(*FIELDS).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"))


def match_histogram(truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """(n_matches, n_anchors), anchors without a match included."""
    per = anchors.select("anchor_id").join(truth.groupBy("anchor_id").agg(F.count("*").alias("c")), "anchor_id", "left")
    return per.groupBy(F.coalesce("c", F.lit(0)).alias("n_matches")).agg(F.count("*").alias("n_anchors"))


def _each(pairs: DataFrame, reasons: dict, name: str, rest: str) -> DataFrame:
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]), lambda x: x.isNotNull())
    kept = F.when(F.size(found) == 0, F.array(F.lit(rest))).otherwise(found)
    return pairs.select(F.explode(kept).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def missed_reasons(missed: DataFrame) -> DataFrame:
    """(reason, n): why true pairs were missed, from their a_* and t_* fields; a pair may have several reasons."""
    a, t = (lambda f: F.col(f"a_{f}")), (lambda f: F.col(f"t_{f}"))
    both = lambda f: (a(f), t(f))
    generic = X.words_of(C.GENERIC_EVIDENCE)
    wa, wt = (F.array_except(F.array_distinct(X.split_words(c)), generic) for c in both("name_norm"))
    shared = F.size(F.array_intersect(wa, wt))
    runs = [F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x != "")) for c in both("address_norm")]
    place, initials = similarity("token_set", *both("address_norm")), X.is_acronym(*both("name_norm"))
    return _each(
        missed,
        {
            "country_mismatch": (a("country_norm") != "") & (t("country_norm") != "") & (a("country_norm") != t("country_norm")),
            "missing_country": (a("country_norm") == "") | (t("country_norm") == ""),
            "acronym_or_initials": initials,
            "no_informative_name_word": shared == 0,
            "low_name_overlap": (shared == 1) & (similarity("token_set", *both("name_norm")) < 0.7),
            "address_discrepancy": place < 0.5,
            "shared_address_other_name": (place >= 0.7) & (shared == 0),
            "number_conflict": (F.size(runs[0]) > 0) & (F.size(runs[1]) > 0) & ~F.arrays_overlap(*runs),
            "name_divergence": (similarity("indel", *both("name_norm")) < 0.6) & (similarity("token_sort", *both("name_norm")) < 0.65) & ~initials,
        },
        "reason",
        "subtle",
    )


def false_positive_kinds(accepted: DataFrame) -> DataFrame:
    """(kind, n) of accepted pairs with ``label`` 0 and a_*, t_* fields; a pair may be of several kinds.

    ``claims``: how many anchors have the target among the accepted pairs.
    """
    claims = F.count("*").over(Window.partitionBy("target_id"))
    x = accepted.withColumn("_claims", claims).where("label = 0")
    wa, wt = (F.array_distinct(X.split_words(F.col(f"{s}_name_norm"))) for s in "at")
    na, nt = (X.numbers(F.col(f"{s}_address_norm")) for s in "at")
    legal = X.words_of(sorted({w for group in C.LEGAL_FORMS.values() for w in group}))
    la, lt = F.array_sort(F.array_intersect(wa, legal)), F.array_sort(F.array_intersect(wt, legal))
    shared, numbers = F.size(F.array_intersect(wa, wt)), F.arrays_overlap(na, nt)
    conflict = (F.size(na) > 0) & (F.size(nt) > 0) & ~numbers
    return _each(
        x,
        {
            "target_of_several_anchors": F.col("_claims") > 1,
            "number_conflict": conflict,
            "no_shared_name_word": shared == 0,
            "other_legal_form": (F.size(la) > 0) & (F.size(lt) > 0) & (la != lt),
            "other_place_of_same_name": ((F.col("a_name_norm") == F.col("t_name_norm")) | ((shared >= 2) & (shared == F.size(wa)))) & ~F.coalesce(numbers, F.lit(False)),
        },
        "kind",
        "other",
    )


def nearest_truth(false: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """(band, n): how like the best true target of its anchor a wrongly accepted target is.

    Half the similarity of names, half that of address words; anchors without a true target
    are a band of their own.
    """
    text = lambda key, s: targets.select(F.col("entity_id").alias(key), F.col("name_norm").alias(f"{s}_n"), F.col("address_norm").alias(f"{s}_a"))
    pairs = false.select("anchor_id", "target_id").join(text("target_id", "x"), "target_id").join(truth.select("anchor_id", F.col("target_id").alias("true_id")), "anchor_id", "left").join(text("true_id", "y"), "true_id", "left")
    near = 0.5 * similarity("indel", F.col("x_n"), F.col("y_n")) + 0.5 * similarity("token_set", F.col("x_a"), F.col("y_a"))
    best = pairs.withColumn("v", F.when(F.col("true_id").isNotNull(), near)).groupBy("anchor_id", "target_id").agg(F.max("v").alias("v"))
    band = F.when(F.col("v").isNull(), "no true target")
    for low in (0.9, 0.8, 0.7, 0.5):
        band = band.when(F.col("v") >= low, f"from {low}")
    return best.groupBy(band.otherwise("below 0.5").alias("band")).agg(F.count("*").alias("n"))


def probability_bins(pairs: DataFrame, width: float = 0.1) -> DataFrame:
    """(bin, label, n)."""
    b = F.least(F.floor(F.col("p") / width), F.lit(int(1 / width) - 1)).cast("int")
    return pairs.groupBy(b.alias("bin"), "label").agg(F.count("*").alias("n"))
