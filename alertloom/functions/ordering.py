"""Exact ranks and running totals over a whole table without a global sort in one task.

Rows are range partitioned by their order, from a sample of the data, so long tails and infinities fill
partitions as evenly as anything else. The partitions are written once with their numbers; totals per
partition give every partition its starting offset, and inside a partition an ordinary window does the
rest. The offset table has one row per partition whatever the size of the input, so it can be broadcast.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import cut_lineage


def in_ranges(df: DataFrame, *by: str) -> DataFrame:
    """Adds ``_b``, the number of a row's range partition in the order of ``by``.

    Range bounds are sampled anew in every run of a plan, so the result is written before it is used.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *by).withColumn("_b", F.spark_partition_id()))


def running_totals(df: DataFrame, x: str, measures: list[str]) -> DataFrame:
    """Adds ``cum_<m>``: the sum of ``m`` over all rows with a value of ``x`` up to this one's, and
    ``all_<m>``: the sum over all rows.

    ``df`` holds each value of ``x`` once (aggregate first).
    """
    placed = in_ranges(df, x)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_b").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = totals.select(
        "_b", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(Window.partitionBy(F.lit(0))).alias(f"all_{m}") for m in measures])
    inside = Window.partitionBy("_b").orderBy(x).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(F.broadcast(offsets), "_b")  # one row per partition
        .withColumns({f"cum_{m}": F.col(f"_o_{m}") + F.sum(m).over(inside) for m in measures})
        .drop("_b", *[f"_o_{m}" for m in measures])
    )


def row_numbers(df: DataFrame, *by: str, name: str = "row_no") -> DataFrame:
    """Adds the number of each row, from 1, in the order of ``by``; equal rows in any order."""
    placed = in_ranges(df, *by)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_b").agg(F.count("*").alias("_c")).select(
        "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy(*by)
    return (placed.join(F.broadcast(offsets), "_b")  # one row per partition
            .withColumn(name, F.col("_o") + F.row_number().over(inside)).drop("_b", "_o"))


def order_statistics(df: DataFrame, value: str, ranks: dict[str, str]) -> DataFrame:
    """One row with ``n`` and the exact order statistics at the given 0-based positions.

    ``ranks`` maps a result name to SQL text over ``n`` giving the position.
    """
    counted = (df.groupBy(F.col(value).cast("double").alias("x"))
               .agg(F.count(value).alias("c")).where("c > 0"))  # no rows for NULL
    n = F.col("n")
    return (
        running_totals(counted, "x", ["c"]).withColumnRenamed("all_c", "n")
        .agg(F.max(n).alias("n"),
             *[F.max(F.when((F.expr(pos) < F.col("cum_c"))
                            & (F.expr(pos) >= F.col("cum_c") - F.col("c")), F.col("x")))
               .alias(name) for name, pos in ranks.items()])
    )


def nearest_rank(percent: float) -> str:
    """Position of the nearest-rank percentile: half-even rounding of p/100*(n-1)."""
    if percent <= 0:
        return "0"
    if percent >= 100:
        return "n - 1"
    return f"cast(rint({percent / 100.0}D * (n - 1)) AS BIGINT)"


def linear_positions(fraction: float) -> tuple[str, str, str]:
    """Lower position, upper position and weight of the linearly interpolated quantile."""
    at = f"({fraction}D * (n - 1))"
    return f"cast(floor{at} AS BIGINT)", f"cast(ceil{at} AS BIGINT)", f"({at} - floor{at})"


def linear_quantiles(df: DataFrame, value: str, fractions: dict[str, float],
                     extra: dict[str, str] | None = None) -> DataFrame:
    """One row with ``n``, linearly interpolated quantiles and further order statistics."""
    ranks, formulas = dict(extra or {}), []
    for name, fraction in fractions.items():
        low, high, weight = linear_positions(fraction)
        ranks[f"_{name}_low"], ranks[f"_{name}_high"] = low, high
        formulas.append(f"_{name}_low + {weight} * (_{name}_high - _{name}_low) AS `{name}`")
    return order_statistics(df, value, ranks).selectExpr("n", *formulas, *(extra or {}))


def numbered(df: DataFrame, key: str, by: list[str] | None = None, seed: int = 42,
             buckets: int = 16384) -> DataFrame:
    """Adds ``row_no`` 1..n (per ``by`` group) in the order of a seeded hash of ``key``.

    The hash spreads every group evenly over the buckets, so no group meets in one task.
    """
    by = by or []
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    hashed = hashed.withColumn("_hb", F.shiftrightunsigned(
        "_h", 64 - (buckets.bit_length() - 1)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy(*by, "_hb").agg(F.count("*").alias("_c"))
               .select(*by, "_hb", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy(*by, "_hb").orderBy("_h", key)
    return (hashed.join(offsets, [*by, "_hb"])
            .withColumn("row_no", F.col("_o") + F.row_number().over(inside))
            .drop("_h", "_hb", "_o"))
