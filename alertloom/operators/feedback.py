"""Analyst feedback: clamping, metrics and the link to explanations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.ordering import linear_quantiles


def clamp_trust(feedback: DataFrame) -> DataFrame:
    """Trust scores limited to 1..5; a missing one counts as 3."""
    return feedback.withColumn(
        "trust_score",
        F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce("trust_score", F.lit(3)))).cast("bigint"))


def feedback_metrics(feedback: DataFrame) -> DataFrame:
    """Total, mean trust and override rate. A row that could not be read (``bad``) still counts
    in the total; without rows both rates are NULL."""
    bad = F.col("bad") if "bad" in feedback.columns else F.lit(False)
    trust = F.when(bad, 0).otherwise(F.coalesce("trust_score", F.lit(3)))
    overridden = F.coalesce("overridden", F.lit(False)) & ~bad
    total = F.count("*")
    return feedback.agg(
        total.alias("total_feedback"),
        (F.sum(trust) / F.nullif(total, F.lit(0))).alias("avg_trust"),
        (F.count_if(overridden) / F.nullif(total, F.lit(0))).alias("override_rate"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Mean trust, override rate, median and 95th percentile of the decision time, and n."""
    times = linear_quantiles(feedback, "decision_ms",
                             {"decision_ms_p50": 0.5, "decision_ms_p95": 0.95})
    return feedback.agg(
        F.avg(F.col("trust_score").cast("double")).alias("trust_mean"),
        F.avg(F.col("overridden").cast("double")).alias("override_rate"),
        F.count("*").alias("n"),
    ).withColumn("_t", times.select(F.struct("decision_ms_p50", "decision_ms_p95").alias("t")).scalar()
                 ).select("trust_mean", "override_rate", "n", "_t.*")


def join_explanations(feedback: DataFrame, documents: DataFrame) -> DataFrame:
    """Feedback with the explanation it judges, where there is one."""
    return feedback.join(documents, feedback.alert_id == documents.doc_id, "left")


def join_provenance(documents: DataFrame, raw_alerts: DataFrame) -> DataFrame:
    """Enriched documents back to the raw alert they came from."""
    return documents.join(raw_alerts, ["_os_index", "_os_doc_id"])
