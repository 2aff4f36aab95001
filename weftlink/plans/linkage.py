"""The whole linkage: from records to match lists, with a learned ranker and learned scores.

Retrieved pairs are described by cheap features and cut to the best of each anchor by a
ranker; the rest get the rich features, in one locked order, and a calibrated model.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import constants as C
from weftlink.operators import blocking, cells, decide, keys, metrics, models, pairwise, splits
from weftlink.operators import features as feat
from weftlink.session import written


@dataclass(frozen=True)
class Settings:
    limit: int = 240
    wide: int = 5
    k: int = 32
    delta: float = 0.2
    kinds: Sequence[str] = models.KINDS
    #: Names of features to use; empty means all rich ones.
    features: Sequence[str] = ()
    seed: int = 17
    trees: int = 20
    depth: int = 5
    rank_trees: int = 160
    rank_step: float = 0.08
    rank_weight: float = 20.0
    tfidf_terms: int = 100_000

    def __post_init__(self):
        if self.limit < 1 or self.wide < 1 or self.k < 1 or not 0 <= self.delta <= 1 or not set(self.kinds) <= set(models.KINDS):
            raise ValueError("a setting is out of range")

    @classmethod
    def load(cls, text: str) -> Settings:
        """From JSON; keys that are no settings are refused."""
        given = json.loads(text)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)


RANK = "boosting"


@dataclass
class Chosen:
    """The winner of a selection with all that a run needs, and the comparison that it won."""

    kind: str
    model: PipelineModel
    slope: float
    offset: float
    threshold: float
    features: list[str]
    ranker: PipelineModel | None = None
    idf: dict[str, DataFrame] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)
    recall: list[tuple] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "kind string, calibrated boolean, threshold double, precision double, recall double, f05 double")

    def importances(self) -> list[tuple[str, float]]:
        """Features by weight; none for a model that has no such weights."""
        return models.importances(self.model, self.features) if self.kind != "logistic" else []

    def save(self, spark: SparkSession, path: str) -> None:
        """The models beside small tables of what else a run needs."""
        self.model.write().overwrite().save(f"{path}/model")
        if self.ranker is not None:
            self.ranker.write().overwrite().save(f"{path}/ranker")
        for name, idf in self.idf.items():
            idf.write.mode("overwrite").parquet(f"{path}/idf_{name}")
        row = (self.kind, self.slope, self.offset, self.threshold, self.features, self.ranker is not None, list(self.idf))
        spark.createDataFrame([row], "kind string, slope double, offset double, threshold double, features array<string>, ranker boolean, idf array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/chosen")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Chosen:
        r = spark.read.parquet(f"{path}/chosen").first()
        return cls(r["kind"], PipelineModel.load(f"{path}/model"), r["slope"], r["offset"], r["threshold"], list(r["features"]), PipelineModel.load(f"{path}/ranker") if r["ranker"] else None, {n: spark.read.parquet(f"{path}/idf_{n}") for n in r["idf"]})

    def score(self, df: DataFrame) -> DataFrame:
        return models.calibrated(models.predict(self.model, df), self.slope, self.offset)


def wide_keys(records: DataFrame) -> DataFrame:
    """Both wide key families of a record in one table; keys of the two never meet."""
    return keys.key_table(records, keys.joined(keys.disk_families(), keys.supplement_families()))


def retrieve(anchors: DataFrame, targets: DataFrame, s: Settings) -> DataFrame:
    """Candidates of both key sets: one table of keys for each side, one join, one union of rules."""
    return blocking.candidates(wide_keys(anchors), blocking.limited(wide_keys(targets), s.limit, {p: s.wide * s.limit for p in "NA"}))


def coarse(pairs: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """The features of the ranker for every pair, worked out in cells and rounded; the mask of rules stays."""
    names = [n for n in feat.coarse_features() if n not in C.RULES]
    side = lambda x: feat.with_runs(x.select("entity_id", F.col("name_norm").alias("name"), "address_norm", "country_norm"))
    x = cells.measured(pairs, side(anchors), side(targets), pairwise.coarse_features, names)
    return feat.assembled(x, [{n: F.col(n) for n in names}, feat.rules()], keep=("mask",))


def fit_ranker(described: DataFrame, truth: DataFrame, ids: DataFrame, s: Settings) -> tuple[PipelineModel, list[tuple]]:
    """A ranker from half of the anchors, and (k, found, recall) of all others. ``ids``: anchors whose labels may be used."""
    placed = splits.placed(ids.select("anchor_id"), "anchor_id", s.seed + 311)
    own = F.floor(F.col("size") / 2)
    rows = blocking.labelled(described, truth).join(placed, "anchor_id")
    names = list(feat.coarse_features())
    model = models.fit(RANK, rows.where(F.col("place") < own), names, positive=s.rank_weight, trees=s.rank_trees, depth=5, step=s.rank_step, seed=s.seed + 2)
    held = placed.where(F.col("place") >= own)
    ranked = models.predict(model, described.join(held.select("anchor_id"), "anchor_id", "left_semi"))
    curve = blocking.top_k_recall(ranked, truth.join(held.select("anchor_id"), "anchor_id", "left_semi"), "p")
    return model, [tuple(r) for r in curve.collect()]


def cut(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, ranker: PipelineModel | None, s: Settings) -> DataFrame:
    """(anchor_id, target_id, mask) of the best ``k`` pairs of each anchor, by the ranker or, without one, by similarity."""
    if ranker is not None:
        return best(coarse(pairs, anchors, targets), ranker, s)
    ranked = feat.gathered(pairs, anchors, targets, ("name_norm", "address_norm")).withColumn("rank", feat.fallback_rank())
    return _top(ranked, s)


def best(described: DataFrame, ranker: PipelineModel, s: Settings) -> DataFrame:
    """``cut`` of pairs that have the features of the ranker."""
    return _top(models.predict(ranker, described).withColumnRenamed("p", "rank"), s)


def _top(ranked: DataFrame, s: Settings) -> DataFrame:
    return blocking.top_k(ranked.select("anchor_id", "target_id", "mask", "rank"), "rank", s.k).select("anchor_id", "target_id", "mask")


def fit_terms(anchors: DataFrame, targets: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Term weights of names and addresses, from the anchors given and all targets."""
    own = anchors.select("entity_id", "name_norm", "address_norm").union(targets.select("entity_id", "name_norm", "address_norm"))
    return {f: written(feat.tfidf_fit(own, f"{f}_norm", s.tfidf_terms)) for f in ("name", "address")}


def rich_groups() -> list[dict]:
    """All rich features in their locked order: base (58 with the cosines), veto (14) and enhanced (9)."""
    cosines = {f"{f}_tfidf_cosine": F.col(f"{f}_tfidf_cosine") for f in ("name", "address")}
    veto = {f"veto_{k}": v for k, v in feat.veto_features().items()}
    return [feat.base_features(), cosines, veto, feat.enhanced_features()]


def rich(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, idf: dict[str, DataFrame], s: Settings) -> DataFrame:
    """The pairs with the features of ``s``, or all rich ones; most are worked out in cells, and rounded there."""
    made = [*feat.text_features(), *feat.component_features(), *feat.enhanced_features(), *feat.ngram_features(), *feat.fuzzy_features(), *feat.combined_feature()]
    pairs = cells.measured(pairs, feat.with_rich(anchors), feat.with_rich(targets), pairwise.rich_features, made)
    for f, weights in idf.items():
        vectors = [feat.tfidf_vectors(x, f"{f}_norm", weights) for x in (anchors, targets)]
        pairs = feat.tfidf_cosine(pairs, *vectors, f"{f}_tfidf_cosine")
    groups = [{k: F.col(k) if k in made else v for k, v in g.items()} for g in rich_groups()]
    return feat.assembled(feat.gathered(pairs, anchors, targets), groups, s.features or None)


def select_model(spark: SparkSession, anchors: DataFrame, targets: DataFrame, truth: DataFrame, s: Settings = Settings()) -> Chosen:
    """Fits ranker, terms and each learner on one part of the anchors, calibrates on another, and chooses on a third by F0.5."""
    flag = anchors.select(F.col("entity_id").alias("anchor_id")).join(truth.select("anchor_id").distinct().withColumn("_t", F.lit(True)), "anchor_id", "left")
    parts = written(splits.stratified(flag, "anchor_id", F.col("_t"), s.seed).drop("_t"))
    part = lambda name: parts.where(F.col("split") == name).select("anchor_id")
    pairs = written(retrieve(anchors, targets, s))
    cheap = written(coarse(pairs, anchors, targets))
    ranker, recall = fit_ranker(cheap, truth, part("fit"), s)
    idf = fit_terms(anchors.join(part("fit").withColumnRenamed("anchor_id", "entity_id"), "entity_id", "left_semi"), targets, s)
    described = rich(written(best(cheap, ranker, s)), anchors, targets, idf, s)
    names = [c for c in described.columns if c not in ("anchor_id", "target_id")]
    x = written(blocking.labelled(described, truth).join(parts, "anchor_id"))
    own, true = part("validation"), truth.join(part("validation"), "anchor_id", "left_semi")
    rows, won = [], None
    for kind in s.kinds:
        options = {} if kind == "logistic" else {"trees": s.trees, "depth": s.depth, "seed": s.seed}
        m = models.fit(kind, x.where("split = 'fit'"), names, stop=x.where("split = 'calibration'"), **options)
        slope, offset = models.calibration(models.predict(m, x.where("split = 'calibration'")))
        raw = written(models.predict(m, x.where("split = 'validation'")).select("anchor_id", "target_id", "p"))
        for a, b in ((1.0, 0.0), (slope, offset)):
            top = metrics.best_threshold(metrics.threshold_sweep(models.calibrated(raw, a, b), true, own, metrics.disk_grid())).first()
            rows.append((kind, (a, b) != (1.0, 0.0), top["threshold"], top["precision"], top["recall"], top["f05"]))
            rank = (top["f05"], top["precision"], top["threshold"], kind)
            if won is None or rank > won[0]:
                won = (rank, Chosen(kind, m, a, b, top["threshold"], names, ranker, idf))
    won[1].rows, won[1].recall = rows, recall
    return won[1]


def link(anchors: DataFrame, targets: DataFrame, chosen: Chosen, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates): retrieve, rank, describe, score, arbitrate, gate and cut, in this order."""
    kept = cut(retrieve(anchors, targets, s), anchors, targets, chosen.ranker, s)
    scored = written(chosen.score(rich(kept, anchors, targets, chosen.idf, s)).select("anchor_id", "target_id", "p"))
    won = decide.winners(scored, decide.arbitrated(scored)).withColumn("source", F.substring("target_id", 1, 2))
    return decide.thresholded(decide.margin_gate(won, s.delta), chosen.threshold).where("won"), scored
