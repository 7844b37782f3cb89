"""Evaluation of scores against labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.ordering import linear_quantiles, running_totals


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum over distinct score thresholds of precision times the gain in recall."""
    by_score = (df.groupBy((-F.col(score)).cast("double").alias("x"))
                .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")))
    totals = running_totals(by_score, "x", ["n", "pos"])
    return totals.agg(
        (F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
         / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"),
        F.sum("pos").alias("positives"), F.sum("n").alias("n"))


def score_quantile(df: DataFrame, score: str = "score", fraction: float = 0.995) -> DataFrame:
    """The score cut that the given fraction of rows stays below, linearly interpolated."""
    return linear_quantiles(df, score, {"cut": fraction})


def classification_report(df: DataFrame, label: str = "label",
                          predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows.

    Everything comes from one aggregation; a division by zero counts as 0.
    """
    counts = df.agg(*[
        F.count_if((F.col(label) == y) & (F.col(predicted) == p)).alias(f"c{y}{p}")
        for y in (0, 1) for p in (0, 1)])

    def ratio(a: str, b: str) -> str:
        return f"coalesce(cast({a} AS DOUBLE) / nullif({b}, 0), 0.0D)"

    measured = counts.selectExpr(
        "*", "c00 + c01 AS s0", "c10 + c11 AS s1", "c00 + c01 + c10 + c11 AS n",
        f"{ratio('c00', 'c00 + c10')} AS p0", f"{ratio('c11', 'c11 + c01')} AS p1",
        f"{ratio('c00', 'c00 + c01')} AS r0", f"{ratio('c11', 'c10 + c11')} AS r1")
    scored = measured.selectExpr(
        "*", f"{ratio('2 * p0 * r0', 'p0 + r0')} AS f0", f"{ratio('2 * p1 * r1', 'p1 + r1')} AS f1")

    def mean(x: str) -> str:
        return f"({x}0 + {x}1) / 2"

    def weighted(x: str) -> str:
        return ratio(f"({x}0 * s0 + {x}1 * s1)", "n")

    accuracy = ratio("(c00 + c11)", "n")
    return scored.selectExpr(
        f"stack(5, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, "
        f"'accuracy', {accuracy}, {accuracy}, {accuracy}, n, "
        f"'macro avg', {mean('p')}, {mean('r')}, {mean('f')}, n, "
        f"'weighted avg', {weighted('p')}, {weighted('r')}, {weighted('f')}, n) "
        "AS (name, precision, recall, f1, support)")
