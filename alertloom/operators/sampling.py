"""Seeded picks of alerts for repeatability and load runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.ordering import numbered


def first_k(alerts: DataFrame, k: int, order: tuple[str, ...] = ("event_ts", "doc_id")) -> DataFrame:
    return alerts.orderBy(*order).limit(k)


def random_k(alerts: DataFrame, k: int, seed: int = 1337, key: str = "doc_id") -> DataFrame:
    """k rows without replacement: the smallest seeded hashes, found as a top-k."""
    return (alerts.withColumn("_h", F.xxhash64(key, F.lit(seed)))
            .orderBy("_h", key).limit(k).drop("_h"))


def shuffled(alerts: DataFrame, seed: int = 1337, key: str = "doc_id") -> DataFrame:
    """All rows with ``row_no`` 1..n in a seeded random order."""
    return numbered(alerts, key, seed=seed)


def resample(alerts: DataFrame, n: int, seed: int = 1337, key: str = "doc_id") -> DataFrame:
    """n rows with replacement: every draw picks a row number by a seeded hash."""
    spark = alerts.sparkSession
    rows = numbered(alerts, key, seed=seed)
    total = alerts.agg(F.count("*").alias("n")).select("n").scalar()
    draws = spark.range(n).select(
        F.col("id").alias("draw"),
        (F.pmod(F.xxhash64("id", F.lit(seed)), total) + 1).alias("row_no"))
    return draws.join(rows, "row_no").drop("row_no")
