"""Log templates: messages grouped by what stays the same in them.

Variable tokens are masked first, and messages with the same mask are counted before anything is
shuffled further. Templates of equal length that differ in one token are then merged: every
template offers one key per position that leaves this position out, so templates meet by key and
no pairs are formed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as variable, replaced in this order. RE2 and Java read them alike.
MASKS = (
    (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"[0-9]+", "<NUM>"),
)
WILDCARD = "<*>"


def mask_sql(message: str) -> str:
    out = message
    for pattern, token in MASKS:
        escaped = pattern.replace("\\", "\\\\")
        out = f"regexp_replace({out}, '{escaped}', '{token}')"
    return f"trim(regexp_replace({out}, '\\\\s+', ' '))"


def template_id_sql(template: str) -> str:
    return f"substring(md5({template}), 1, 16)"


def masked_templates(messages: DataFrame, message: str = "message") -> DataFrame:
    """Distinct masked messages with their number of tokens and of messages."""
    return (
        messages.where(f"{message} IS NOT NULL")
        .selectExpr(f"{mask_sql(message)} AS template")
        .groupBy("template").agg(F.count("*").alias("n"))
        .selectExpr(f"{template_id_sql('template')} AS template_id", "template",
                    "cast(size(split(template, ' ')) AS BIGINT) AS tokens", "n")
    )


def merge_templates(masked: DataFrame) -> DataFrame:
    """Adds ``merged``: the masked template with the one varying token replaced by a wildcard.

    A template joins at most one family: the position with the most distinct templates, the
    leftmost of equals. The key of a position is the sum of position-wise token hashes without
    that position, taken twice with different seeds, so its size does not grow with the text.
    """
    tokens = "split(template, ' ')"
    hashed = masked.selectExpr(
        "template_id", "template", "tokens", "n",
        *[f"transform({tokens}, (t, j) -> xxhash64(t, j, {seed})) AS h{seed}" for seed in (1, 2)])
    summed = hashed.selectExpr(
        "*", *[f"aggregate(transform(h{s}, x -> x div 1048576), 0L, (a, x) -> a + x) AS s{s}"
               for s in (1, 2)])
    keyed = summed.selectExpr(
        "template_id", "tokens", "s1", "s2", "posexplode_outer(arrays_zip(h1, h2)) AS (pos, h)"
    ).selectExpr("template_id", "tokens", "pos",
                 "s1 - (h.h1 div 1048576) AS k1", "s2 - (h.h2 div 1048576) AS k2")
    families = (keyed.groupBy("tokens", "pos", "k1", "k2").agg(F.count("*").alias("members"))
                .where("members > 1"))
    best = (
        keyed.join(families, ["tokens", "pos", "k1", "k2"])
        .groupBy("template_id").agg(F.max_by("pos", F.struct("members", -F.col("pos"))).alias("pos"))
    )
    return (
        masked.join(best, "template_id", "left")
        .selectExpr(
            "template_id", "template", "tokens", "n",
            f"CASE WHEN pos IS NULL OR tokens < 2 THEN template ELSE array_join(transform({tokens}, "
            f"(t, j) -> if(j = pos, '{WILDCARD}', t)), ' ') END AS merged")
    )


def log_templates(messages: DataFrame, message: str = "message") -> DataFrame:
    """Templates after merging, with an id, the number of messages and of masked variants."""
    return (
        merge_templates(masked_templates(messages, message))
        .groupBy("merged").agg(F.sum("n").alias("n"), F.count("*").alias("variants"))
        .selectExpr(f"{template_id_sql('merged')} AS template_id", "merged AS template", "n",
                    "variants")
    )


def label_messages(messages: DataFrame, message: str = "message") -> DataFrame:
    """Every message with its template: the join key is the masked text, which is computed twice
    rather than shuffling whole messages through the merge."""
    merged = merge_templates(masked_templates(messages, message)).selectExpr(
        "template AS _masked", f"{template_id_sql('merged')} AS template_id", "merged AS template")
    return messages.withColumn("_masked", F.expr(mask_sql(message))).join(
        merged, "_masked", "left").drop("_masked")


