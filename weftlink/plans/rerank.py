"""Stacked reranking: out-of-fold probabilities, what they say within an anchor, and a second model on top."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.operators import features as feat
from weftlink.operators import metrics, models, splits
from weftlink.session import written

DEPTHS = (5, 7, 9)


def meta_features(scored: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """(anchor_id, target_id, features): context (13), peers (22) and details (44) of pairs with ``p``."""
    pairs = scored.select("anchor_id", "target_id", "p")
    context = feat.context_features(pairs).drop("p")
    peers = feat.peer_features(pairs, targets).drop("p")
    fields = ("name_norm", "country_norm", *[f"detail_{k}" for k in (*feat.VIEWS, "core", "numbers")])
    wide = feat.gathered(pairs, feat.with_details(anchors), feat.with_details(targets), fields)
    frequent = feat.detail_frequencies(wide, feat.corpus_stats(anchors)[0])
    names = ("detail_left_name_frequency", "detail_right_name_frequency")
    details = feat.assembled(frequent, [feat.detail_features(made=True), {n: F.col(n) for n in names}])
    return context.join(peers, ["anchor_id", "target_id"]).join(details, ["anchor_id", "target_id"])


def stacked(x: DataFrame, names: list[str], anchors: DataFrame, targets: DataFrame, truth: DataFrame, depths: tuple[int, ...] = DEPTHS, trees: int = 20, base_depth: int = 5, seed: int = 17) -> tuple[PipelineModel, list[tuple]]:
    """The best second model, and (depth, weight, threshold, precision, f05) of all that were tried.

    ``x``: pairs with features, ``label`` and ``split``. Fitting anchors get probabilities from
    models that saw none of their fold; the others from one model of all fitting anchors. The
    second model stops early and is calibrated on the calibration part, and is chosen, alone
    and blended with the first, on the validation part.
    """
    options = {"trees": trees, "depth": base_depth, "seed": seed}
    fit = splits.folds(x.where("split = 'fit'"), "anchor_id", 3, seed)
    champion = models.fit("boosting", fit, names, **options)
    first = written(models.out_of_fold("boosting", fit, names, 3, **options).drop("fold").unionByName(models.predict(champion, x.where("split <> 'fit'"))).select("anchor_id", "target_id", "p", "label", "split"))
    described = meta_features(first, anchors, targets)
    meta = [c for c in described.columns if c not in ("anchor_id", "target_id")]
    y = written(described.join(first.withColumnRenamed("p", "champion"), ["anchor_id", "target_id"]))
    own = x.where("split = 'validation'").select("anchor_id").distinct()
    true = truth.join(own, "anchor_id", "left_semi")
    rows, best = [], None
    for depth in depths:
        m = models.fit("boosting", y.where("split = 'fit'"), meta, stop=y.where("split = 'calibration'"), trees=trees, depth=depth, step=0.04, seed=seed)
        slope, offset = models.calibration(models.predict(m, y.where("split = 'calibration'")))
        challenger = written(models.calibrated(models.predict(m, y.where("split = 'validation'")), slope, offset).select("anchor_id", "target_id", "champion", F.col("p").alias("challenger")))
        for weight, threshold, precision, f05 in models.blending_grid(challenger, "champion", "challenger", true, own, metrics.disk_grid()):
            rows.append((depth, weight, threshold, precision, f05))
            if best is None or (f05, precision) > best[0]:
                best = ((f05, precision), m)
    return best[1], rows
