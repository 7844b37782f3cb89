"""Latency records and their summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.ordering import linear_quantiles, nearest_rank


def successful(latency: DataFrame) -> DataFrame:
    """Drops records that carry a status other than 200 or an ``ok`` other than true."""
    return latency.where("coalesce(status_code, 200) = 200 AND coalesce(ok, true)")


def latency_summary(latency: DataFrame, only_success: bool = True) -> DataFrame:
    """Samples, median, nearest-rank p95 and p99, mean, min and max in one row."""
    kept = successful(latency) if only_success else latency
    kept = kept.where("latency_ms IS NOT NULL")
    ranked = linear_quantiles(kept, "latency_ms", {"median": 0.5},
                              extra={"p95": nearest_rank(95), "p99": nearest_rank(99)})
    return kept.agg(
        F.count("*").alias("samples"), F.avg("latency_ms").alias("mean"),
        F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"),
    ).withColumn("_r", ranked.select(F.struct("median", "p95", "p99").alias("r")).scalar()).select(
        "samples", "mean", "min", "max", "_r.median", "_r.p95", "_r.p99")
