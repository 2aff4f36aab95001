"""Decisions on scored pairs: ownership, arbitration, margins and cut-offs. Input: anchor_id, target_id, p."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.operators.features import BROADCAST_BYTES, held_bytes
from weftlink.session import checkpointed


def unique_owner(pairs: DataFrame) -> DataFrame:
    """The pair with the highest p of each target; targets whose highest p is tied have none."""
    best = pairs.groupBy("target_id").agg(F.max("p").alias("top"))
    top = pairs.join(best, "target_id").where("p = top").drop("top")
    return top.join(top.groupBy("target_id").agg(F.count("*").alias("ties")).where("ties = 1").select("target_id"), "target_id")


def owner_stats(pairs: DataFrame) -> DataFrame:
    """(target_id, best, second, ties) of each target: ``second`` is the highest p below the best, 0 without any."""
    top = pairs.select("target_id", "p", F.max("p").over(Window.partitionBy("target_id")).alias("best"))
    below = F.max(F.when(F.col("p") < F.col("best"), F.col("p")))
    return top.groupBy("target_id").agg(F.max("best").alias("best"), F.coalesce(below, F.lit(0.0)).alias("second"), F.count_if(F.col("p") == F.col("best")).alias("ties"))


def graph_audit(pairs: DataFrame, anchors: DataFrame, threshold: float, margin: float = 0.1) -> DataFrame:
    """By the anchors' country: accepted pairs, those of unique owners, those won by a small margin, and anchors left empty.

    ``anchors``: anchor_id, country_norm.
    """
    x = pairs.where(F.col("p") >= threshold).join(owner_stats(pairs), "target_id")
    unique = (F.col("p") == F.col("best")) & (F.col("ties") == 1)
    per = x.groupBy("anchor_id").agg(F.count("*").alias("n"), F.count_if(unique).alias("u"), F.count_if(unique & (F.col("p") - F.col("second") < margin)).alias("m"))
    whole = anchors.select("anchor_id", "country_norm").join(per, "anchor_id", "left").fillna(0, ["n", "u", "m"])
    return whole.groupBy("country_norm").agg(F.count("*").alias("n_anchors"), F.sum("n").alias("pair_matches"), F.sum("u").alias("unique_matches"), F.sum("m").alias("small_margin_unique"), F.count_if(F.col("n") == 0).alias("pair_empty"), F.count_if(F.col("u") == 0).alias("unique_empty"))


def arbitrated(pairs: DataFrame, order: str = "anchor_id") -> DataFrame:
    """Each target's best pair; of equal ones the first by ``order``."""
    w = Window.partitionBy("target_id").orderBy(F.desc("p"), order)
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: Pairs that are left to one task, which takes them in order.
SETTLED = 1 << 18


def _beside(pairs: DataFrame, other: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    """``pairs`` joined to a stored table by columns that may be null; it goes to the pairs if it takes few bytes."""
    own = other.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    alike = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)])
    return pairs.join(F.broadcast(own) if held_bytes(own) <= BROADCAST_BYTES else own, alike, how).drop(*[f"_on{i}" for i in range(len(on))])


def _in_order(columns: list[str], source: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes pairs as they come: the greedy rule itself, for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, left = set(), {}
        for batch in batches:
            kept = []
            for a, t, s, n in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "target_id", source, "_left")), strict=True):
                n = left.get((a, s), n)
                kept.append(t not in taken and n > 0)
                if kept[-1]:
                    taken.add(t)
                    left[a, s] = n - 1
            yield batch.filter(pa.array(kept, pa.bool_())).select(columns)

    return run


def arbitrated_capped(pairs: DataFrame, cap: int, source: str = "source", order: tuple[str, ...] = ("anchor_id", "target_id")) -> DataFrame:
    """Greedy by p, then ``order``: each target once, at most ``cap`` targets of a source for each anchor.

    A pair that is its target's best and among the best of its anchor's group wins in any
    greedy order, so all such pairs are taken in rounds; groups that are full and targets
    that are taken leave between rounds. Only pairs with the highest p of a target or a
    group are ranked. Once no more than ``SETTLED`` pairs are left, one task goes through
    them in order. ``pairs`` are read several times.
    """
    by, group = [F.desc("p"), *order], ("anchor_id", source)
    live, won = pairs.withColumn("_left", F.lit(cap)), None
    while live.count() > SETTLED:
        tops = [(c, checkpointed(live.groupBy(*c).agg(F.max("p").alias(n)))) for c, n in ((("target_id",), "_t"), (group, "_g"))]
        x = live
        for on, top in tops:
            x = _beside(x, top, on, "inner")
        best, first = F.col("p").eqNullSafe(F.col("_t")), F.col("p").eqNullSafe(F.col("_g"))
        places = {"_b": F.row_number().over(Window.partitionBy("target_id").orderBy(*by)), "_k": F.row_number().over(Window.partitionBy(*group).orderBy(*by))}
        new = checkpointed(x.where(best | first).withColumns(places).where(best & first & (F.col("_b") == 1) & (F.col("_k") <= F.col("_left"))).select(*pairs.columns))
        won = new if won is None else won.unionByName(new)
        live = _beside(live, new.select("target_id"), ("target_id",), "left_anti")
        live = _beside(live, new.groupBy(*group).agg(F.count("*").cast("int").alias("_n")), group, "left")
        live = checkpointed(live.withColumn("_left", F.col("_left") - F.coalesce("_n", F.lit(0))).drop("_n").where("_left > 0"))
    rest = live.repartition(1).sortWithinPartitions(*by).mapInArrow(_in_order(pairs.columns, source), pairs.schema)
    return rest if won is None else won.unionByName(rest)


def margin_gate(pairs: DataFrame, delta: float, source: str = "source") -> DataFrame:
    """p becomes 0 where it is more than ``delta`` below the best of its anchor and source."""
    top = F.max("p").over(Window.partitionBy("anchor_id", source))
    return pairs.withColumn("p", F.when(top - F.col("p") <= delta, F.col("p")).otherwise(0.0))


def expected_f_cutoff(pairs: DataFrame, multiplier: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """The pairs of each anchor down to where expected F0.5 is highest, which may be none.

    Taking k is worth 1.25 times the sum of the k best p over (0.25 of the sum of all p,
    plus k); taking none is worth the chance that no pair is true, times ``multiplier``.
    Equal values go to the smaller k.
    """
    q = F.col("p")
    if temperature != 1.0:
        c = F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6))
        q = 1 / (1 + F.exp(-F.log(c / (1 - c)) / temperature))
    whole = Window.partitionBy("anchor_id")
    down = whole.orderBy(F.desc("q"), "target_id")
    x = pairs.withColumn("q", q).withColumns({"k": F.row_number().over(down), "s": F.sum("q").over(down.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("q").over(whole), "none": F.exp(F.sum(F.log(F.greatest(1 - F.col("q"), F.lit(1e-12)))).over(whole)) * multiplier})
    x = x.withColumn("v", F.round(1.25 * F.col("s") / (0.25 * F.col("all") + F.col("k")), 12))
    x = x.withColumns({"top": F.max("v").over(whole), "at": F.min(F.struct(-F.col("v"), F.col("k"))).over(whole)["k"]})
    return x.where((F.col("k") <= F.col("at")) & (F.col("top") > F.round("none", 12))).select(*pairs.columns, "k")


def checked(p: Column) -> Column:
    """p itself; the run stops at a null, a NaN, or a value outside [0, 1]."""
    fault = F.raise_error(F.concat(F.lit("no probability: "), F.coalesce(p.cast("string"), F.lit("null"))))
    return F.when(p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1), p).otherwise(fault.cast("double"))


def probability_faults(pairs: DataFrame) -> DataFrame:
    """(fault, n): probabilities that are null, NaN, or outside [0, 1]; no rows if there are none."""
    p = F.col("p")
    kind = F.when(p.isNull(), "null").when(F.isnan(p), "nan").when((p < 0) | (p > 1), "range")
    return pairs.select(kind.alias("fault")).where("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


def thresholded(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(checked(F.col("p")) >= F.lit(threshold))


def winners(pairs: DataFrame, won: DataFrame) -> DataFrame:
    """All pairs with ``won`` and, for those won, their probability; 0 for the others."""
    marks = won.select("anchor_id", "target_id").withColumn("won", F.lit(True))
    out = pairs.join(marks, ["anchor_id", "target_id"], "left").withColumn("won", F.coalesce("won", F.lit(False)))
    return out.withColumn("p", F.when(F.col("won"), F.col("p")).otherwise(0.0))


def arbitration_comparison(pairs: DataFrame, threshold: float, cap: int = 1) -> DataFrame:
    """(policy, n_pairs, n_targets, max_claims, n_duplicates) without arbitration, by target, and with a cap for each source.

    What wins depends on pairs with no lower p only, so pairs below the threshold leave first.
    """
    pairs, out = checkpointed(thresholded(pairs, threshold)), None
    for name, kept in (("none", pairs), ("target", arbitrated(pairs)), ("capped", arbitrated_capped(pairs, cap))):
        one = claims_report(kept).select(F.lit(name).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def claims_report(pairs: DataFrame) -> DataFrame:
    """(n_pairs, n_targets, max_claims, n_duplicates): how targets are claimed."""
    per = pairs.groupBy("target_id").agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n_pairs"), F.count("*").alias("n_targets"), F.coalesce(F.max("c"), F.lit(0)).alias("max_claims"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))
