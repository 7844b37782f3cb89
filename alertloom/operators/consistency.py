"""Repeatability of explanations: the same alerts scored over several rounds.

Features of one record sit in one array (at most the vector length), so Jaccard and Spearman are
computed inside the row. Rows are keyed by (alert key, block of rounds); a key with very many
rounds is spread over its blocks and only its block totals meet.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.coerce import add

BLOCK = 512


def jaccard_sql(a: str, b: str) -> str:
    """Shared over united features; two empty sets agree, one empty set does not."""
    return (f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D "
            f"WHEN size({a}) = 0 OR size({b}) = 0 THEN 0.0D "
            f"ELSE cast(size(array_intersect({a}, {b})) AS DOUBLE) "
            f"/ size(array_union({a}, {b})) END")


def _average_ranks(values: str, up: str, down: str) -> str:
    """Twice the average rank of each element, from the values sorted both ways: ties share the mean of
    their first and last place."""
    return (f"transform({values}, x -> array_position({up}, x) + size({up}) + 1L - array_position({down}, x))")


def spearman(df: DataFrame, first: str, current: str, name: str) -> DataFrame:
    """Adds the rank correlation of two impact maps over the features they share.

    NULL with fewer than two shared features or when one side has no variance. Ranks are kept
    doubled and the sums in whole numbers, so the result does not depend on summation order.
    """
    staged = add(df, _shared=f"array_intersect(map_keys({first}), map_keys({current}))")
    staged = add(staged, _x=f"transform(_shared, f -> {first}[f])",
                 _y=f"transform(_shared, f -> {current}[f])")
    staged = add(staged, _ux="sort_array(_x)", _uy="sort_array(_y)", _dx="sort_array(_x, false)",
                 _dy="sort_array(_y, false)", _n="size(_shared)")
    staged = add(staged, _rx=_average_ranks("_x", "_ux", "_dx"), _ry=_average_ranks("_y", "_uy", "_dy"))

    def total(expr: str) -> str:
        return f"aggregate(sequence(0, _n - 1), 0L, (s, i) -> s + {expr})"

    staged = add(staged, _sums=(
        "CASE WHEN _n >= 2 THEN named_struct("
        f"'x', _n * (_n + 1L), 'y', _n * (_n + 1L), 'xy', {total('_rx[i] * _ry[i]')}, "
        f"'xx', {total('_rx[i] * _rx[i]')}, 'yy', {total('_ry[i] * _ry[i]')}) END"))
    staged = add(staged, _cov="_n * _sums.xy - _sums.x * _sums.y",
                 _vx="_n * _sums.xx - _sums.x * _sums.x", _vy="_n * _sums.yy - _sums.y * _sums.y")
    out = add(staged, **{name: "CASE WHEN _vx > 0 AND _vy > 0 "
                               "THEN _cov / (sqrt(cast(_vx AS DOUBLE)) * sqrt(cast(_vy AS DOUBLE)))"
                               " END"})
    return out.drop("_shared", "_x", "_y", "_ux", "_uy", "_dx", "_dy", "_rx", "_ry", "_n", "_sums",
                    "_cov", "_vx", "_vy")


def _last_by_name(entries: str) -> str:
    """The entries of an array whose name does not come again later."""
    return (f"filter({entries}, (t, at) -> NOT exists(slice({entries}, at + 2, size({entries})), "
            "u -> u.feature = t.feature))")


def _own(records: DataFrame) -> DataFrame:
    """Records with their block, feature names, impacts by name and place within the key.

    Records of one round and number are told apart by their content, so the order is the same in
    every run.
    """
    named = "filter(top_features, t -> t.feature IS NOT NULL)"
    return add(
        records.selectExpr(
            "key", "round", "i", "score", "label", f"(round - 1) div {BLOCK} AS block",
            f"{named} AS _named")
        .selectExpr(
            "*", "array_distinct(_named.feature) AS _names", "filter(_named, t -> t.impact IS NOT NULL) AS _entries")
        .withColumn("_lone", F.expr("size(_names) = size(_named)")),  # no name comes twice
        _impacts=f"map_from_entries(transform(CASE WHEN _lone THEN _entries ELSE {_last_by_name('_entries')} END, "
                 "t -> struct(t.feature, t.impact)))",
        _place="struct(round, i, label, score, xxhash64(_names, _entries) AS content)",
    ).drop("_named", "_entries", "_lone")


def _with_base(records: DataFrame) -> DataFrame:
    """Records with ``_names1`` and ``_impacts1`` of their key's first record by (round, number), and
    ``_first``, that record's place.

    The first record of a key lies in its lowest block. A key's records of the first block find it in
    the window that orders them anyway; only records of later blocks, if there are any, meet a table of
    their keys' first records, which are found by an aggregation that combines before the shuffle.
    """
    own = _own(records.where("key IS NOT NULL AND round IS NOT NULL"))
    order = Window.partitionBy("key", "block").orderBy("_place")
    # One column each, so that a report that needs no impacts does not carry them along.
    base = {"_names1": "_names", "_impacts1": "_impacts", "_first": "_place"}
    near = own.where("block = 0").withColumns({n: F.first(c).over(order) for n, c in base.items()})
    far_records = records.where(f"key IS NOT NULL AND (round - 1) div {BLOCK} <> 0")
    if not far_records.isEmpty():
        keys = far_records.select("key").distinct()
        bases = own.join(keys, "key", "left_semi").groupBy("key").agg(
            *[F.min_by(c, "_place").alias(n) for n, c in base.items()])
        near = near.unionByName(own.where("block <> 0").join(bases, "key"))
    return near


def _measured(records: DataFrame) -> DataFrame:
    """One row per (key, block) with everything the report sums up."""
    joined = _with_base(records)
    compared = spearman(add(joined, jaccard=jaccard_sql("_names1", "_names")),
                        "_impacts1", "_impacts", "rho")
    order = Window.partitionBy("key", "block").orderBy("_place")
    placed = compared.withColumns({"_prev": F.lag("label").over(order),
                                   "_pos": F.row_number().over(order)})
    later = ~((F.col("_pos") == 1) & (F.col("_place") == F.col("_first")))
    return placed.groupBy("key", "block").agg(
        F.count_if((F.col("_pos") > 1) & ~F.col("label").eqNullSafe(F.col("_prev"))).alias("flips"),
        F.count("*").alias("n"), F.max("round").alias("rounds"),
        F.min_by("label", "_place").alias("first_label"),
        F.max_by("label", "_place").alias("last_label"),
        F.collect_set("label").alias("labels"),  # the label names, two of them
        F.count("score").alias("n_score"), F.avg("score").alias("mean"),
        F.var_pop("score").alias("var"),
        F.min("score").alias("low"), F.max("score").alias("high"),
        F.sum(F.when(later, F.col("jaccard"))).alias("jaccard"),
        F.sum(F.when(later, F.col("rho"))).alias("rho"),
        F.count(F.when(later, F.col("rho"))).alias("n_rho"),
    )


def consistency_report(records: DataFrame) -> DataFrame:
    """The full per-key report: one pass over the records by (key, block), one merge by key.

    Flip rate over consecutive records, sample deviation of the score (0 for one) and its range,
    mean Jaccard (1 without other records) and mean Spearman against the key's first record.
    """
    edge = Window.partitionBy("key").orderBy("block")
    crossed = F.when(F.lag("n").over(edge).isNotNull()
                     & ~F.col("first_label").eqNullSafe(F.lag("last_label").over(edge)), 1).otherwise(0)
    blocks = _measured(records).withColumn("flips", F.col("flips") + crossed)
    n_score = F.col("n_score")
    merged = blocks.groupBy("key").agg(
        F.sum("flips").alias("flips"), F.sum("n").alias("n"), F.max("rounds").alias("rounds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("label_set"),
        F.sum("n_score").alias("n_score"),
        (F.sum(n_score * F.col("mean")) / F.sum("n_score")).alias("mean"),
        F.collect_list(F.struct("n_score", "mean", "var")).alias("_parts"),
        (F.max("high") - F.min("low")).alias("score_max_delta"),
        F.sum("jaccard").alias("jaccard"), F.sum("rho").alias("rho"), F.sum("n_rho").alias("n_rho"))
    # Squared deviations of the blocks around the common mean.
    square = ("aggregate(filter(_parts, p -> p.n_score > 0), 0D, (s, p) -> s + p.n_score * "
              "(p.var + (p.mean - mean) * (p.mean - mean)))")
    return merged.selectExpr(
        "key", "cast(rounds AS BIGINT) AS rounds", "label_set",
        "CASE WHEN n > 1 THEN flips / (n - 1) ELSE 0.0D END AS label_flip_rate",
        f"CASE WHEN n_score > 1 THEN sqrt({square} / (n_score - 1)) WHEN n_score = 1 THEN 0.0D END "
        "AS score_std",
        "score_max_delta",
        "CASE WHEN n > 1 THEN jaccard / (n - 1) ELSE 1.0D END AS topfeat_jaccard_mean_vs_r1",
        "CASE WHEN n_rho > 0 THEN rho / n_rho END AS impact_spearman_mean_vs_r1")


def label_flips(records: DataFrame) -> DataFrame:
    """Per key: the labels seen and the share of consecutive records whose label changed."""
    return consistency_report(records).select("key", "label_set", "label_flip_rate")


def score_spread(records: DataFrame) -> DataFrame:
    """Per key: sample deviation of the score (0 for one record) and its range."""
    return consistency_report(records).select("key", "score_std", "score_max_delta")


def explanation_overlap(records: DataFrame) -> DataFrame:
    """Per key: mean Jaccard (1 without other records) and mean Spearman against the first record."""
    return consistency_report(records).select(
        "key", "topfeat_jaccard_mean_vs_r1", "impact_spearman_mean_vs_r1")


def consistency_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("alerts"), F.max("rounds").alias("rounds"),
        F.avg("label_flip_rate").alias("flip_rate_mean"),
        F.avg("topfeat_jaccard_mean_vs_r1").alias("jaccard_mean"),
        F.avg("score_std").alias("score_std_mean"))


def worst(report: DataFrame, k: int = 10) -> DataFrame:
    """The k keys with most flips, then least overlap."""
    return report.orderBy(F.col("label_flip_rate").desc(), F.col("topfeat_jaccard_mean_vs_r1"),
                          F.col("key")).limit(k)
