"""Training as one plan, and explanation with the trained model."""

from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.models.attribution import Leaves, leaves_of
from alertloom.models.bundle import Bundle
from alertloom.models.evaluate import average_precision, classification_report, score_quantile
from alertloom.models.forest import AlertModel, ForestSettings, fit, fit_prototypes
from alertloom.models.split import stratified_split
from alertloom.operators.canonical import canonicalize
from alertloom.operators.features import feature_names, fill_enriched, project_features
from alertloom.operators.policy import apply_policy
from alertloom.operators.rolling import rolling_counters
from alertloom.plans import pipeline
from alertloom.session import stored


# Rows of a part of the training table: below the first no more parts are made, above the second there are
# more parts than cores.
LEAST_ROWS, MOST_ROWS = 10_000, 250_000


@dataclass
class Trained:
    model: AlertModel
    parts: DataFrame        # feature rows with label, weight and part, in the shared folder
    settings: ForestSettings
    feature_map: dict | None = None
    enrich: bool = False
    bad_rows: int = 0       # rows of the input that were no alerts
    _bundle: Bundle | None = None
    _background: tuple | None = None

    @property
    def leaves(self) -> Leaves:
        return self.bundle.leaves

    def prototypes(self) -> DataFrame:
        return fit_prototypes(self.parts.where("part = 'train'"), self.model.names, self.settings)

    @property
    def background(self) -> tuple[np.ndarray, np.ndarray]:
        """Prototype matrix and weights: at most ``settings.prototypes`` rows."""
        if self._background is None:
            rows = self.prototypes().toPandas()
            weights = rows.pop("weight").to_numpy()
            self._background = rows.to_numpy(), weights
        return self._background

    @property
    def bundle(self) -> Bundle:
        """The model with its leaves, without prototypes, which cost a clustering."""
        if self._bundle is None:
            self._bundle = Bundle(self.feature_map, self.model, self.enrich,
                                  leaves_of(self.model.forest, self.model.names), None, asdict(self.settings))
        return self._bundle

    def packed(self) -> Bundle:
        """The whole bundle, prototypes included."""
        return replace(self.bundle, background=self.background)

    def score(self, features: DataFrame) -> DataFrame:
        return self.model.score(features)

    def attributed(self, decided: DataFrame, method: str = "tree") -> DataFrame:
        """Adds ``phi``. Background attribution is limited to rows the policy grants it; the
        others, and the ``importances`` method, show the forest's global importances."""
        return (self.packed() if method == "background" else self.bundle).attributed(decided, method)

    def test_scores(self) -> DataFrame:
        return self.model.score(self.parts.where("part = 'test'"))

    def evaluation(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Average precision, the 99.5 % score cut and the class report at 0.5."""
        scored = stored(self.test_scores().select("label", "score"), "test-scores")  # read by three reports
        predicted = scored.withColumn("predicted", F.expr("if(score >= 0.5D, 1L, 0L)"))
        return (average_precision(scored), score_quantile(scored), classification_report(predicted))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The frame in as many parts as the learner needs to use all cores, rows in a fixed order.

    Adaptive execution leaves few, since feature rows are short; each of them costs the learner as many steps as
    there are trees. Every part costs it a shuffled table of statistics per tree level, so there are no more
    than that. Small tables stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))
    if parts <= 1:
        return df
    return df.repartition(parts).sortWithinPartitions(F.xxhash64(*df.columns), *df.columns)


def train(alerts: DataFrame, feature_map: dict | None,
          settings: ForestSettings = ForestSettings(), enrich: bool = False) -> Trained:
    """Fits the model. Rows marked ``bad`` teach nothing; they are counted in the written feature rows, so
    the input is read once."""
    marked = "bad" in alerts.columns
    rows = stored(pipeline.training_rows(alerts, feature_map, enrich, ("bad",) if marked else ()), "training-rows")
    bad = rows.where("bad").count() if marked else 0
    if marked:
        rows = rows.where("NOT bad").drop("bad")
    # Read once per tree level by the learner and again by calibration.
    parts = stored(dealt(stratified_split(rows, seed=settings.seed), rows.count()), "training-parts")
    return Trained(fit(parts, feature_names(feature_map), settings), parts, settings, feature_map, enrich, bad)


def explain(alerts: DataFrame, explainer: Trained | Bundle, policy: dict, feature_map: dict | None = None,
            method: str | None = None, requested_k: int | None = None,
            alert: tuple[str, ...] = (), mode: str = "intended") -> DataFrame:
    """Alerts to explanation documents, with a trained model, a stored bundle, or a bundle without one.

    Features are made, and enriched, as they were for training. Overrides see the features and whatever
    else of the canonical row they mention. ``feature_map`` is only needed where the explainer has none.
    """
    feature_map = explainer.feature_map or feature_map
    names, keep = feature_names(feature_map), ("doc_id", "timestamp", *alert)
    canon = canonicalize(alerts, (*keep, *(["event_ts"] if explainer.enrich else [])))
    if explainer.enrich:
        canon = fill_enriched(rolling_counters(canon))
    mentioned = {name for o in policy.get("overrides") or [] for name in o.get("when", {})}
    context = tuple(sorted((mentioned & set(canon.columns)) - set(names) - set(keep)))
    features = project_features(canon, feature_map, (*keep, "policy_source", *context))
    decided = apply_policy(explainer.score(features), policy, "score", mode=mode,
                           columns={*names, *context})
    phi = explainer.attributed(decided, method) if method else explainer.attributed(decided)
    return pipeline.explain_with(phi, policy, feature_map, requested_k, alert=alert)
