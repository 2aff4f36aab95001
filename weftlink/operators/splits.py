"""Seeded samples, splits and folds.

The order of an MD5 sum stands in for a shuffle: it is the same on any cluster and in any
engine. Exact places in that order come without a global sort: counts of 4,096 ranges of
sums are added up, and rows are ranked inside their range only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.text import hex_number


def digest(key: str | Column, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def draw(key: str | Column, seed: int) -> Column:
    """A uniform number in [0, 1) for each key."""
    return hex_number(F.substring(digest(key, seed), 1, 8)) / F.lit(float(1 << 32))


def split(df: DataFrame, key: str, shares: Mapping[str, float], seed: int) -> DataFrame:
    """``split``: the name of the part that each key falls in, in about these shares. Needs no shuffle."""
    u, cut, name = draw(key, seed), 0.0, F.lit(None).cast("string")
    for part, share in shares.items():
        name = F.when(u >= cut, F.lit(part)).otherwise(name)
        cut += share
    return df.withColumn("split", name)


def placed(df: DataFrame, key: str, seed: int, stratum: Column | None = None) -> DataFrame:
    """``place``: from 0 on, in the seeded order of distinct keys, within a stratum; ``size``: of the stratum."""
    rows = df.withColumns({"_s": F.lit(0) if stratum is None else stratum, "_h": digest(key, seed)}).withColumn("_b", F.substring("_h", 1, 3))
    ranges = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_s")
    base = ranges.select("_s", "_b", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_0"), F.sum("_n").over(w).alias("size"))
    inside = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)) - 1
    return rows.join(F.broadcast(base), ["_s", "_b"]).withColumn("place", F.col("_0") + inside).drop("_s", "_b", "_h", "_0")  # 4,096 rows for each stratum


def dealt(df: DataFrame, key: str, sizes: Mapping[str, int], seed: int) -> DataFrame:
    """``split`` with exactly so many keys in each part, in seeded order; the others are left out."""
    out, cut, name = placed(df, key, seed), 0, F.lit(None).cast("string")
    for part, n in sizes.items():
        name = F.when((F.col("place") >= cut) & (F.col("place") < cut + n), F.lit(part)).otherwise(name)
        cut += n
    return out.withColumn("split", name).where("split is not null").drop("place", "size")


def stratified(df: DataFrame, key: str, flag: Column, seed: int, calibration: float = 0.2, validation: float = 0.2) -> DataFrame:
    """``split`` into fit, calibration and validation with the same shares of both values of ``flag``.

    The held-out parts are rounded up. At least ten keys are needed; where a value of the
    flag has too few for three parts, the split is seeded but not stratified.
    """
    marked = df.withColumn("_f", F.coalesce(flag.cast("int"), F.lit(0)))
    counts = {r["_f"]: r["n"] for r in marked.groupBy("_f").agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) < 10:
        raise ValueError("a split needs ten anchors or more")
    even = all(n >= 3 for n in counts.values())
    out = placed(marked, key, seed, F.col("_f") if even else None)
    held = F.ceil(F.round(F.col("size") * validation, 9))
    rest = F.ceil(F.round((F.col("size") - held) * (calibration / (1 - validation)), 9))
    return out.withColumn("split", F.when(F.col("place") < held, "validation").when(F.col("place") < held + rest, "calibration").otherwise("fit")).drop("place", "size", "_f")


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(draw(key, seed) * k).cast("int"))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows that come first in the seeded order, or all."""
    return df.orderBy(digest(key, seed), key).limit(n)


def unused(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in none of the used ones."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def holdout(df: DataFrame, used: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A fresh sample of ``n`` rows that no earlier part has."""
    return sample(unused(df, used, key), key, n, seed)


def ceiling(n: int, share: float) -> int:
    return math.ceil(round(n * share, 9))
