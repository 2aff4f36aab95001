"""Column expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.session import checkpointed

#: The six ASCII blanks between words.
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The maximal runs of non-blank characters, in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def small_side(df: DataFrame, rows: int = 100_000, size: Column | None = None, most: int = 64 << 20) -> DataFrame:
    """``df`` written down, and marked for broadcast if it has no more than ``rows`` rows; beyond that a join shuffles.

    ``size``: the bytes of a row, where rows have no small bound; their sum may be ``most``.
    """
    df = checkpointed(df)
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)) if size is not None else F.lit(0)).first()
    return F.broadcast(df) if n <= rows and held <= most else df


def shared_out(counts: dict[str, int], n: int) -> dict[str, int]:
    """At most ``n`` places for labels with so many rows each: equal shares, and what one cannot fill goes to the others."""
    out, open_, left = {}, sorted(counts, key=lambda k: (counts[k], k)), n
    while open_:
        share = left // len(open_)
        k = open_.pop(0)
        out[k] = min(counts[k], share)
        left -= out[k]
    return out


def dealt_sample(rows: DataFrame, label: str, h: str, n: int, labels: int) -> DataFrame:
    """(label, h) of at most ``n`` rows, dealt out to the ``labels`` most frequent labels in equal parts.

    Of each label those with the least ``h`` are taken, a hash of 63 bits; rows of one hash
    count once, so repeated rows take one place. All rows take part in the choice: they are
    counted, and of each label about four times as many as there are places are put in order.
    """
    known = rows.groupBy(label).agg(F.approx_count_distinct(h, 0.02).alias("c")).orderBy(F.desc("c"), label).limit(labels).collect()
    places = shared_out({r[label]: r["c"] for r in known}, n)
    kind = rows.schema[label].dataType.simpleString()
    plan = []
    for r in known:
        q, c = places[r[label]], r["c"]
        q = int(1.2 * c) + 20 if q >= c else q  # all of a rare label; counts are near ones
        plan.append((r[label], q, min(1.0, 4 * (q + 20) / max(1, c))))
    plan = rows.sparkSession.createDataFrame(plan, f"{label} {kind}, _q int, _u double")
    few = rows.select(label, h).join(F.broadcast(plan), label).where(F.col(h) <= F.col("_u") * float(1 << 63)).distinct()  # ``labels`` rows
    place = F.row_number().over(Window.partitionBy(label).orderBy(h))
    return few.withColumn("_r", place).where("_r <= _q").select(label, h)
