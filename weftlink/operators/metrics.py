"""Entity-level and pair-level metrics. Pairs: anchor_id, target_id, p; truth: anchor_id, target_id."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.text import fbeta
from weftlink.session import written


def memory_grid() -> list[float]:
    """0.10 to 0.95 by 0.05, then 0.99, 1 and the next double, which rejects all."""
    return [0.10 + i * 0.05 for i in range(18)] + [0.99, 1.0, math.nextafter(1.0, 2)]


def disk_grid() -> list[float]:
    return [0.05 + i * 0.025 for i in range(37)] + [0.975, 0.99, 0.995, 0.999, 1.0, math.nextafter(1.0, 2)]


def per_anchor(predicted: DataFrame, truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, tp, n_pred, n_true, precision, recall, f05) for every anchor; empty and empty is 1."""
    hits = predicted.join(truth.select("anchor_id", "target_id").withColumn("_t", F.lit(1)), ["anchor_id", "target_id"], "left")
    counts = hits.groupBy("anchor_id").agg(F.count("*").alias("n_pred"), F.count("_t").alias("tp"))
    x = anchors.select("anchor_id").join(counts, "anchor_id", "left").join(truth.groupBy("anchor_id").agg(F.count("*").alias("n_true")), "anchor_id", "left").fillna(0, ["n_pred", "tp", "n_true"])
    return with_scores(x)


def with_scores(x: DataFrame) -> DataFrame:
    empty = (F.col("n_pred") == 0) & (F.col("n_true") == 0)
    share = lambda n: F.when(empty, 1.0).when(F.col(n) == 0, 0.0).otherwise(F.col("tp") / F.col(n))
    return x.withColumns({"precision": share("n_pred"), "recall": share("n_true")}).withColumn("f05", fbeta(F.col("precision"), F.col("recall")))


def entity_report(predicted: DataFrame, truth: DataFrame, anchors: DataFrame, n_targets: int) -> DataFrame:
    """One row: means over all anchors, pooled values, false-positive rate, and singletons."""
    x = per_anchor(predicted, truth, anchors)
    single = F.col("n_true") == 0
    s = x.agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f05")],
        F.sum("tp").alias("tp"),
        F.sum(F.col("n_pred") - F.col("tp")).alias("fp"),
        F.sum(F.col("n_true") - F.col("tp")).alias("fn"),
        F.count("*").alias("n"),
        F.sum("n_true").alias("n_true"),
        F.count_if(single).alias("singletons"),
        F.count_if(single & (F.col("n_pred") == 0)).alias("right"),
    )
    pooled = lambda other, rest: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise((F.col(rest) == 0).cast("double"))
    s = s.withColumns({"micro_precision": pooled("fp", "fn"), "micro_recall": pooled("fn", "fp"), "negatives": F.col("n") * n_targets - F.col("n_true")})
    r = lambda c: F.round(c, 6)
    return s.select(
        *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f05", "micro_precision", "micro_recall")],
        r(fbeta(F.col("micro_precision"), F.col("micro_recall"))).alias("micro_f05"),
        r(F.when(F.col("negatives") > 0, F.col("fp") / F.col("negatives")).otherwise(0.0)).alias("false_positive_rate"),
        r(F.when(F.col("singletons") > 0, F.col("right") / F.col("singletons"))).alias("singleton_accuracy"),
        "singletons",
        "tp",
        "fp",
        "fn",
    )


def threshold_sweep(pairs: DataFrame, truth: DataFrame, anchors: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(step, threshold, precision, recall, f05): means over all anchors at each threshold of the grid.

    A pair counts up to the last threshold that its p reaches, so it is dealt to that step
    once. The counts by step are summed from there down inside the anchor's row; neither
    pairs nor anchors are multiplied by the grid in a shuffle.
    """
    marks = F.array(*[F.lit(t) for t in grid])
    step = reduce(add, [(F.col("p") >= F.lit(t)).cast("int") for t in grid]) - 1
    hits = pairs.join(truth.select("anchor_id", "target_id").withColumn("_t", F.lit(1)), ["anchor_id", "target_id"], "left").withColumn("step", step).where("step >= 0")
    dealt = hits.groupBy("anchor_id", "step").agg(F.count("*").alias("n"), F.count("_t").alias("t")).groupBy("anchor_id").agg(F.collect_list(F.struct("step", "n", "t")).alias("dealt"))
    x = anchors.select("anchor_id").join(truth.groupBy("anchor_id").agg(F.count("*").alias("n_true")), "anchor_id", "left").join(dealt, "anchor_id", "left").fillna(0, ["n_true"])
    own = F.coalesce("dealt", F.array().cast(dealt.schema["dealt"].dataType))
    above = lambda i, f: F.aggregate(F.filter(own, lambda s: s["step"] >= i), F.lit(0).cast("long"), lambda v, s: v + s[f])
    steps = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda i: F.struct(i.alias("step"), above(i, "n").alias("n_pred"), above(i, "t").alias("tp")))
    x = x.select("n_true", F.explode(steps).alias("s")).select("n_true", "s.step", "s.n_pred", "s.tp")
    y = with_scores(x).groupBy("step").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f05")])
    return y.withColumn("threshold", F.get(marks, F.col("step"))).select("step", "threshold", "precision", "recall", "f05")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The step with the highest F0.5, then precision, then threshold."""
    return sweep.orderBy(F.desc("f05"), F.desc("precision"), F.desc("threshold")).limit(1)


def probability_report(pairs: DataFrame) -> DataFrame:
    """One row from (p, label): average precision, ROC area, Brier score and log loss.

    Pairs of equal p are one step of both curves. The steps are written in ranges of p;
    each range is summed by itself on top of the totals of those above it, so no task
    holds the whole curve.
    """
    by = pairs.groupBy("p").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    by = written(by.repartitionByRange(F.desc("p")).withColumn("part", F.spark_partition_id()))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = by.groupBy("part").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("t").over(up), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n0"))
    w = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    c = by.join(base, "part").withColumns({"ct": F.col("t0") + F.sum("t").over(w), "cn": F.col("n0") + F.sum("n").over(w)})
    sums = c.agg(F.sum("t").alias("P"), F.sum("n").alias("N"), F.sum(F.col("t") * F.col("ct") / F.col("cn")).alias("ap"), F.sum((F.col("n") - F.col("t")) * (F.col("ct") - F.col("t") / 2)).alias("auc"))
    q = F.least(F.greatest("p", F.lit(1e-8)), F.lit(1 - 1e-8))
    loss = pairs.agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), F.avg(-F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    one = sums.crossJoin(F.broadcast(loss))  # one row each
    return one.select(F.round(F.try_divide("ap", "P"), 6).alias("average_precision"), F.round(F.try_divide(F.col("auc"), F.col("P") * (F.col("N") - F.col("P"))), 6).alias("roc_auc"), F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


def confusion(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.groupBy("label", (F.col("p") >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def country_scores(predicted: DataFrame, truth: DataFrame, anchors: DataFrame) -> DataFrame:
    """(country_norm, n, f05): the mean score of the anchors of each country."""
    return per_anchor(predicted, truth, anchors).join(anchors.select("anchor_id", "country_norm"), "anchor_id").groupBy("country_norm").agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("f05"))


def model_changes(pairs: DataFrame, before: str, after: str, threshold: float) -> DataFrame:
    """(slice, n): pairs that two models decide differently, by truth."""
    was, now, true = F.col(before) >= threshold, F.col(after) >= threshold, F.col("label") == 1
    kind = F.when(true & ~was & now, "recovered_true").when(~true & was & ~now, "removed_false").when(~true & ~was & now, "new_false").when(true & was & ~now, "lost_true")
    return pairs.select(kind.alias("slice")).dropna().groupBy("slice").agg(F.count("*").alias("n"))


def top_changes(pairs: DataFrame, before: str, after: str, n: int = 12) -> DataFrame:
    """The ``n`` pairs whose probability changes most."""
    return pairs.withColumn("change", F.abs(F.col(after) - F.col(before))).orderBy(F.desc("change"), "anchor_id", "target_id").limit(n)


#: Groups of rows that are drawn together; at most so many rows reach the driver.
DRAWN = 8192


def bootstrap_interval(deltas: DataFrame, column: str, rounds: int = 2000, seed: int = 7) -> tuple[float, float, float]:
    """(mean, low, high): the mean of a column and its 95 % interval over resamples.

    Rows fall into ``DRAWN`` groups by their hash, whose sums are partial aggregates; each
    round weighs every group by a seeded Poisson draw, as resampling does for many groups.
    """
    import numpy as np

    bucket = F.pmod(F.xxhash64(F.lit(seed), *deltas.columns), F.lit(DRAWN))
    rows = deltas.groupBy(bucket.alias("g")).agg(F.count(column).alias("n"), F.sum(F.col(column).cast("double")).alias("s")).orderBy("g").toPandas()
    n, s = rows["n"].to_numpy(float), rows["s"].fillna(0.0).to_numpy(float)
    draw = np.random.default_rng(seed)
    w = [draw.poisson(1.0, (50, len(n))) for _ in range(-(-rounds // 50))]
    means = np.concatenate([(x @ s) / np.maximum(x @ n, 1) for x in w])[:rounds]
    return float(s.sum() / max(1.0, n.sum())), float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))
