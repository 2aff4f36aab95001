"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions.

A token budget goes down a tree (domain, language, source by default). Each node deals
its budget to its children by weight; what a child cannot supply goes to its siblings
first, and only what a whole subtree lacks goes up to the parent's siblings. A leaf takes
whole epochs, then a prefix of a last one; each epoch has its own seeded order.

Nothing of the tree reaches the driver, so it may have as many leaves as there are hosts:
every level is dealt at once by filling all nodes to their common level. Texts are read
once for their lengths; all decisions fall on a narrow table of lengths and hashes. A
prefix needs no global sort: sums over ranges of the seeded order find the range, and the
range in it, in which a leaf ends, and only the rows of that are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.text import small_side, words
from weftlink.session import written

#: Ranges of the seeded order, and of each range again, that are summed before rows are looked at.
RANGE_BITS = 8
#: Leaves whose plan is broadcast, about 100 bytes each; with more both sides are shuffled.
BROADCAST_LEAVES = 200_000


@dataclass(frozen=True)
class Mixture:
    """Weights by path from the root; a path not named weighs ``default`` among its siblings."""

    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    default: float = 1.0
    #: Tokens wanted, as a share of all tokens supplied.
    share: float = 0.5
    max_epochs: int = 1
    seed: int = 17


def _weighed(nodes: DataFrame, path: Sequence[str], mixture: Mixture) -> DataFrame:
    """``nodes`` with w: the weight of each among its siblings."""
    named = [(*k, float(w)) for k, w in mixture.weights.items() if len(k) == len(path)]
    if not named:
        return nodes.withColumn("w", F.lit(max(0.0, mixture.default)))
    given = nodes.sparkSession.createDataFrame(named, ", ".join(f"{c} string" for c in path) + ", _w double")
    return nodes.join(F.broadcast(given), list(path), "left").withColumn("w", F.greatest(F.lit(0.0), F.coalesce("_w", F.lit(float(mixture.default))))).drop("_w")  # as many rows as weights were stated


def _levels(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """(parent, level): where sum(min(level w, room)) over a node's children is its budget; null if all are to be full.

    ``children``: the parent's columns and budget, w and room, both above 0. Children count
    by the level at which they are full. Ranges of that level are summed first; only in the
    range in which a parent's level lies are the single values put in order.
    """
    at = children.withColumn("full_at", F.col("room") / F.col("w"))
    band = F.floor(F.log2("full_at") * 8)
    at = at.groupBy(*parent, "budget", "full_at", band.alias("band")).agg(F.sum("room").alias("room"), F.sum("w").alias("w"))
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = whole.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = at.groupBy(*parent, "budget", "band").agg(F.sum("room").alias("r"), F.sum("w").alias("v"), F.min("full_at").alias("low"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    bands = bands.withColumns({"r0": z(F.sum("r").over(before)), "v0": z(F.sum("v").over(before)), "v_all": F.sum("v").over(whole), "r_all": F.sum("r").over(whole)})
    # a range comes into question if at its lowest level not more than the budget is dealt; of those the last
    open_ = bands.where((F.col("budget") < F.col("r_all")) & (F.col("r0") + F.col("low") * (F.col("v_all") - F.col("v0")) <= F.col("budget")))
    last = open_.groupBy(*parent).agg(F.max_by(F.struct("band", "r0", "v0", "v_all"), "band").alias("s")) if parent else open_.agg(F.max_by(F.struct("band", "r0", "v0", "v_all"), "band").alias("s")).where("s is not null")
    lowest = bands.where("budget < r_all").groupBy(*parent).agg(F.min_by(F.struct("band", "r0", "v0", "v_all"), "band").alias("f")) if parent else bands.where("budget < r_all").agg(F.min_by(F.struct("band", "r0", "v0", "v_all"), "band").alias("f")).where("f is not null")
    pick = (lowest.join(last, list(parent), "left") if parent else lowest.join(last, F.lit(True), "left")).select(*parent, F.coalesce("s", "f").alias("s")).select(*parent, "s.*")
    inside = at.join(pick, [*parent, "band"])
    order = whole.orderBy("full_at").rowsBetween(Window.unboundedPreceding, 0)
    # the level if all values up to this one are full: right for the last of them that lies below it
    inside = inside.withColumns({"r1": F.col("r0") + F.sum("room").over(order), "v1": F.col("v0") + F.sum("w").over(order)})
    up_to = (F.col("budget") - F.col("r1")) / (F.col("v_all") - F.col("v1"))
    first = (F.col("budget") - F.col("r0")) / (F.col("v_all") - F.col("v0"))
    met = F.when((F.col("v_all") > F.col("v1")) & (up_to >= F.col("full_at")), F.struct("full_at", up_to.alias("level")))
    sums = [F.max(met).alias("m"), F.first(first).alias("level0")]
    return (inside.groupBy(*parent).agg(*sums) if parent else inside.agg(*sums).where("level0 is not null")).select(*parent, F.coalesce("m.level", "level0").alias("level"))


def leaf_budgets(supply: DataFrame, path: Sequence[str], mixture: Mixture, total: float) -> DataFrame:
    """(path, n, budget): tokens for each leaf of ``supply`` (path, n), at most ``max_epochs`` times what it has.

    What a node may take is what its children of a weight above 0 may; a branch of weight 0
    gets nothing and counts as no supply.
    """
    rooms: dict[int, DataFrame] = {}
    nodes = supply.withColumn("room", F.col("n").cast("double") * mixture.max_epochs)
    for depth in range(len(path), 0, -1):
        own = list(path[:depth])
        rooms[depth] = written(_weighed(nodes, own, mixture).withColumn("room", F.when(F.col("w") > 0, F.col("room")).otherwise(0.0)))
        nodes = rooms[depth].groupBy(*own[:-1]).agg(F.sum("room").alias("room"))
    given = None
    for depth in range(1, len(path) + 1):
        own = list(path[:depth])
        children = rooms[depth].withColumn("budget", F.lit(float(total))) if given is None else rooms[depth].join(given.select(*own[:-1], "budget"), own[:-1])
        children = children.where("room > 0 and w > 0")
        level = _levels(children, own[:-1])
        dealt = children.join(level, own[:-1], "left") if depth > 1 else children.join(F.broadcast(level), F.lit(True), "left")  # one row
        budget = F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("w")))
        given = written(dealt.select(*own, F.least(budget, F.col("budget")).alias("budget")))
    return supply.join(given, list(path), "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))


def _order(row: Column, seed: int, epoch: Column) -> Column:
    """The place of a row in the order of an epoch, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), row), 1)


def _ends(rows: DataFrame, leaf: Sequence[str]) -> DataFrame:
    """(leaf, star, copies): the place at which the prefix of ``rest`` tokens of each leaf ends, exclusive.

    ``rows``: leaf, rest, u, n. Rows of one place are equal; of those at the end, ``copies``
    still fit.
    """
    shift, found = 63 - RANGE_BITS, rows.withColumn("before", F.lit(0).cast("long"))
    w = Window.partitionBy(*leaf)
    for _ in range(2):
        part = F.shiftright("u", shift).bitwiseAND((1 << RANGE_BITS) - 1)
        own = found.withColumn("part", part)
        sums = own.groupBy(*leaf, "rest", "before", "part").agg(F.sum("n").alias("t"))
        start = F.col("before") + F.coalesce(F.sum("t").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = sums.withColumn("start", start).where((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("t") > F.col("rest"))).select(*leaf, "part", F.col("start").alias("before"))
        found = own.drop("before").join(small_side(cut, BROADCAST_LEAVES), [*leaf, "part"]).drop("part")
        shift -= RANGE_BITS
    places = found.groupBy(*leaf, "rest", "before", "u").agg(F.sum("n").alias("t"), F.max("n").alias("n"))
    start = F.col("before") + F.coalesce(F.sum("t").over(w.orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = places.withColumn("start", start).where((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("t") > F.col("rest")))
    return ends.select(*leaf, F.col("u").alias("star"), F.floor((F.col("rest") - F.col("start")) / F.col("n")).cast("int").alias("copies"))


def mix(df: DataFrame, levels: Mapping[str, str], mixture: Mixture = Mixture(), text: str = "text", added: Sequence[str] = ("epoch", "n_tokens"), keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``df`` that the mixture takes, once for each epoch that takes them.

    Adds the epoch (0 for the first) and, with a second name in ``added``, the tokens to the
    columns ``keep`` (all, if not named), in place of columns of those names. ``levels`` names
    the tree from the root down, each level as an SQL expression; nulls are a branch of their
    own. Null and empty texts have no tokens and are taken with the prefix that they fall in;
    a leaf without tokens gives nothing. Very long texts are rows as others; one that does
    not fit ends the prefix. Rows equal in every column stand side by side in the order, and
    the budget may part them: so many of them are taken as fit. Ties of different rows are
    broken by their hashes. An empty table gives no rows.
    """
    columns = [c for c in (keep or df.columns) if c not in added]
    leaf = [f"l{i}" for i in range(len(levels))]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")
    place = [F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(f"l{i}") for i, c in enumerate(levels.values())]
    tokens, mark = F.size(words(F.col(f"`{text}`"))).cast("long").alias("n"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("id")
    whole_rows = text in columns
    narrow = written(df.select(*([] if whole_rows else [row]), *place, tokens, mark))
    supply = written(narrow.groupBy(*leaf).agg(F.sum("n").alias("n")))
    total = supply.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    plan = leaf_budgets(supply, leaf, mixture, mixture.share * total).where("n > 0")
    epochs = F.floor(F.col("budget") / F.col("n"))
    plan = plan.select(*leaf, epochs.cast("int").alias("whole"), F.floor(F.col("budget") - epochs * F.col("n")).cast("long").alias("rest"))
    plan = small_side(plan, BROADCAST_LEAVES)
    u = _order(F.col("id"), mixture.seed, F.col("whole"))
    ends = written(_ends(narrow.select(*leaf, "n", "id").join(plan, leaf).where("rest > 0").withColumn("u", u).drop("id", "whole"), leaf))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_LEAVES else ends
    rows = df.select(row, *place, *([tokens] if len(added) > 1 else []), mark) if whole_rows else narrow
    dealt = rows.join(plan, leaf).join(ends, leaf, "left").withColumn("u", u)
    name = lambda x, epoch: x.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)], epoch.cast("int").alias(added[0]), *[F.col("n").alias(c) for c in added[1:]])
    none = F.array().cast("array<int>")
    taken = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(none), F.when(F.col("u") < F.col("star"), F.array("whole")).otherwise(none))
    out = name(dealt.withColumn("e", F.explode(taken)), F.col("e"))
    if ends.where("copies > 0").isEmpty():
        return out
    again = dealt.where("u = star and copies > 0").groupBy(*leaf, "whole", "copies").agg(F.first("row").alias("row"), *[F.first("n").alias("n") for _ in added[1:]])
    return out.union(name(again.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies")))), F.col("whole")))


#: The tree of ``documents``: the domain is the letters that begin the source.
LEVELS = {"domain": "regexp_extract(source, '^[A-Za-z]*', 0)", "lang": "lang", "source": "source"}
_WEIGHTS = {("src", "en"): 0.5, ("src", "de"): 0.2, ("src", "fr"): 0.2, ("src", "es"): 0.1}

#: Targets for the languages of ``documents``; sources of a language weigh alike. As many tokens as there are, in up to three epochs.
LANGUAGES = Mixture(_WEIGHTS, share=1.0, max_epochs=3)
#: The same targets for half of the tokens, no document twice: what the corpus pipeline keeps.
HALF = Mixture(_WEIGHTS, share=0.5, max_epochs=1)
