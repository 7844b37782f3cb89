"""Rolling counters per source address.

Counts are taken per (address, instant) first. Each count enters its window at its instant and leaves
it one microsecond after the window's length, so a running sum of entries and departures is the
counter: linear in the number of instants, whatever the density. The running sum is taken inside
minutes and the minutes' totals are carried on, so an address meets in one task only by its minutes.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SECOND = 1_000_000
_SLICE = 60 * _SECOND
NAMES = ("auth_fail_5m", "auth_fail_1h", "conn_count_5m")


def rolling_counters(canon: DataFrame, address: str = "src_ip", ts: str = "event_ts") -> DataFrame:
    """Adds auth_fail_5m, auth_fail_1h and conn_count_5m; rows without an address get 0.

    A window covers [t - length, t], including the row itself and all rows of the same instant.
    """
    keyed = canon.withColumn("_us", F.unix_micros(ts))
    usable = (F.coalesce(F.col(address), F.lit("")) != "") & F.col("_us").isNotNull()
    counts = (
        keyed.where(usable).groupBy(F.col(address).alias("_addr"), "_us")
        .agg(F.sum("auth_result_neg").alias("fails"), F.count("*").alias("conns"))
    )
    five, hour = 300 * _SECOND + 1, 3600 * _SECOND + 1
    changes = counts.select("_addr", F.expr(
        "inline(array(named_struct('_us', _us, 'a', fails, 'b', fails, 'c', conns, 'own', true), "
        f"named_struct('_us', _us + {five}, 'a', -fails, 'b', 0L, 'c', -conns, 'own', false), "
        f"named_struct('_us', _us + {hour}, 'a', 0L, 'b', -fails, 'c', 0L, 'own', false)))"))
    changes = (changes.groupBy("_addr", "_us", F.expr(f"_us div {_SLICE}").alias("_slice"))
               .agg(*[F.sum(c).alias(c) for c in "abc"], F.bool_or("own").alias("own")))
    slices = Window.partitionBy("_addr").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        changes.groupBy("_addr", "_slice").agg(*[F.sum(c).alias(c) for c in "abc"])
        .select("_addr", "_slice", *[F.coalesce(F.sum(c).over(slices), F.lit(0)).alias(f"_{c}")
                                     for c in "abc"]))
    inside = Window.partitionBy("_addr", "_slice").orderBy("_us").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rolled = (
        changes.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in "abc"}).where("own")
        .join(carried, ["_addr", "_slice"])
        .select("_addr", "_us", *[(F.col(f"_in_{c}") + F.col(f"_{c}")).alias(name)
                                  for c, name in zip("abc", NAMES)]))
    base = keyed.drop(*NAMES)
    # Every row gets a partner key, so that rows without an address spread over their instants.
    joined = base.withColumn("_addr", F.coalesce(F.col(address), F.lit(""))).join(
        rolled, ["_addr", "_us"], "left")
    return (joined.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in NAMES})
            .drop("_addr", "_us"))


def tumbling_volume(alerts: DataFrame, minutes: int = 10, ts: str = "event_ts") -> DataFrame:
    """Alerts per tumbling window, keyed by the window start in epoch seconds."""
    return (alerts.groupBy(F.window(ts, f"{minutes} minutes").alias("w"))
            .agg(F.count("*").alias("n"))
            .select(F.unix_seconds("w.start").alias("window_start"), "n"))
