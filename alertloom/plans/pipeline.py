"""Whole plans: alerts to features, to policy decisions and to explanation documents."""

from pyspark.sql import Column, DataFrame

from alertloom.operators.canonical import canonicalize
from alertloom.operators.explain import clamp_top_k, explanation_documents, rank_features
from alertloom.operators.features import (
    feature_names, fill_enriched, project_features,
)
from alertloom.operators.policy import apply_policy, top_k
from alertloom.operators.rolling import rolling_counters
from alertloom.operators.weaklabel import weak_label, weak_score


def feature_rows(alerts: DataFrame, feature_map: dict | None, keep: tuple[str, ...] = ("doc_id",),
                 enrich: bool = False,
                 extra_columns: dict[str, Column] | None = None) -> DataFrame:
    """Alerts to ordered feature columns. ``enrich`` fills what is declared but has no path:
    DNS, RDP logon, private addresses, hour of day and the rolling counters."""
    needed = tuple(dict.fromkeys([*keep, *(["event_ts"] if enrich else [])]))
    canon = canonicalize(alerts, needed, extra_columns)
    if enrich:
        canon = fill_enriched(rolling_counters(canon))
    return project_features(canon, feature_map, keep)


def training_rows(alerts: DataFrame, feature_map: dict | None, enrich: bool = False,
                  also: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns with weak label and weight, one row per alert."""
    labelled = weak_label(weak_score(alerts))
    keep = ("doc_id", "label", "weight", *also)
    return feature_rows(labelled, feature_map, keep, enrich)


def decided_rows(scored: DataFrame, policy: dict, feature_map: dict | None,
                 score: str = "score", mode: str = "intended",
                 keep: tuple[str, ...] = ("doc_id", "timestamp")) -> DataFrame:
    """Scored alerts to feature columns with the policy decision.

    ``intended`` overrides look at the canonical row, ``observed`` ones only at the features.
    """
    names = feature_names(feature_map)
    canon = canonicalize(scored, tuple(dict.fromkeys([*keep, score])))
    columns = set(names) if mode == "observed" else set(canon.columns)
    decided = apply_policy(canon, policy, score, mode=mode, columns=columns)
    kept = (*keep, score, "policy_source", "threshold", "tag", "policy_action", "recommendation",
            "do_shap", "top_k")
    return project_features(decided, feature_map, tuple(dict.fromkeys(kept)))


def explain_with(decided: DataFrame, policy: dict, feature_map: dict | None,
                 requested_k: int | None = None, score: str = "score",
                 alert: tuple[str, ...] = ()) -> DataFrame:
    """Decided rows with an attribution array ``phi`` to explanation documents."""
    names = feature_names(feature_map)
    k = clamp_top_k(top_k(policy) if requested_k is None else requested_k, len(names))
    return explanation_documents(rank_features(decided, names, k), names, score, alert)
