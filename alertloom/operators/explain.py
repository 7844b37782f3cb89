"""Ranked features, texts and the explanation document."""

from pyspark.sql import DataFrame

from alertloom import constants as K
from alertloom.functions.coerce import add
from alertloom.operators.features import nonzero_map_sql


def clamp_top_k(requested: int | None, n_features: int) -> int:
    """All features of a short vector; otherwise at least the floor and at most the vector."""
    base = max(1, K.TOP_K_DEFAULT if requested is None else int(requested))
    if n_features < 10:
        return n_features
    return min(max(base, K.TOP_K_FLOOR), n_features)


def attribution_array_sql(names: list[str], phi: str = "phi") -> str:
    """ARRAY of (feature, value, impact) from feature columns and an array in the same order."""
    items = ", ".join(
        f"named_struct('feature', '{n}', 'value', `{n}`, 'impact', {phi}[{j}])"
        for j, n in enumerate(names))
    return f"array({items})"


def top_features_sql(items: str, k: int | str) -> str:
    """Features with a value other than zero, largest absolute impact first, at most ``k``.

    Stays inside the row: no shuffle is needed to rank the features of one document.
    """
    keyed = (f"transform(filter({items}, t -> t.value <> 0.0D AND t.impact IS NOT NULL), "
             "t -> named_struct('o', -abs(t.impact), 'feature', t.feature, 'value', t.value, 'impact', t.impact))")
    return (f"transform(slice(array_sort({keyed}), 1, {k}), t -> named_struct("
            "'feature', t.feature, 'value', t.value, 'impact', t.impact))")


REASON = ("CASE WHEN size(top_features) > 0 THEN concat('Top impact: ', "
          "array_join(transform(top_features, t -> t.feature), ', ')) "
          "ELSE 'Model score only' END")


def rank_features(df: DataFrame, names: list[str], k: int, phi: str = "phi") -> DataFrame:
    """Adds ``top_features`` to rows with feature columns and an attribution array."""
    return add(df, top_features=top_features_sql(attribution_array_sql(names, phi), k))


def decide(df: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``label`` and ``reason``, and the recommendation where the policy gave none."""
    texted = add(df, predicted_label=f"CASE WHEN {score} >= threshold THEN 'malicious' "
                                     "ELSE 'benign' END", reason=REASON)
    columns = [c for c in texted.columns if c != "recommendation"]
    return texted.selectExpr(
        *[f"`{c}`" for c in columns],
        "coalesce(nullif(recommendation, ''), CASE predicted_label WHEN 'malicious' "
        "THEN 'Investigate' ELSE 'Monitor traffic' END) AS recommendation")


def explanation_documents(df: DataFrame, names: list[str], score: str = "score",
                          alert: tuple[str, ...] = ()) -> DataFrame:
    """The stored document. ``df`` carries the policy columns, ``top_features`` and ``timestamp``.

    ``alert`` lists the alert columns to embed.
    """
    embedded = ", ".join(f"'{c}', `{c}`" for c in alert)
    return decide(df, score).selectExpr(
        "doc_id",
        *([f"named_struct({embedded}) AS alert"] if alert else []),
        f"'{K.MODEL_VERSION}' AS model_version",
        f"{score} AS predicted_score",
        "predicted_label",
        "top_features",
        f"{nonzero_map_sql(names)} AS features",
        "reason", "recommendation", "timestamp",
        "tag", "policy_action AS action",
    )


def findings_documents(df: DataFrame, names: list[str], score: str = "score") -> DataFrame:
    """The nested shape of the same result: model, policy and explanation sections."""
    return decide(df, score).selectExpr(
        "doc_id", "true AS ok",
        f"{nonzero_map_sql(names)} AS features",
        "named_struct("
        f"'model', named_struct('version', '{K.MODEL_VERSION}', 'score', {score}, "
        "'label', predicted_label), "
        "'policy', named_struct('source', policy_source, 'threshold', threshold, 'tag', tag, "
        "'action', policy_action, 'recommendation', recommendation, 'do_shap', do_shap, "
        "'top_k_effective', top_k), "
        "'explanation', named_struct('top_features', top_features, 'reason', reason)) "
        "AS findings",
    )


def valid_attributions(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per top feature, without entries that lack a feature or an impact.

    The outer explode keeps Spark from inferring a filter on the array, which would be pushed down
    and copy the whole chain of expressions behind it once more.
    """
    return (docs.selectExpr(*keep, "explode_outer(top_features) AS t")
            .where("t.feature IS NOT NULL AND t.impact IS NOT NULL")
            .selectExpr(*keep, "t.feature AS feature", "coalesce(t.value, 0.0D) AS value",
                        "t.impact AS impact"))
