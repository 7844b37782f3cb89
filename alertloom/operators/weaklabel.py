"""Rule-based risk score and the training label that follows from it.

Points are whole hundredths, so the cut points at 12 and 30 do not depend on summation order.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import constants as K
from alertloom.functions.coerce import (
    add, any_word, array_of, case, lower_text, quoted_list, to_int,
)


def _points(condition: str, points: int) -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE 0 END"


def weak_score(alerts: DataFrame) -> DataFrame:
    """Adds ``weak_points`` (0..100) and ``weak_score`` (0..1) to alerts."""
    staged = add(
        alerts,
        _level=to_int("rule.level"),
        _groups="transform(coalesce(rule.groups, cast(array() AS array<string>)), "
                "g -> lower(g))",
        _words="lower(concat_ws('\n', rule.description, full_log))",
        _log="lower(concat_ws('\n', full_log, data.attack))",
        _port=to_int("data.dstport"),
        _bytes=f"{to_int('data.sentbyte')} + {to_int('data.rcvdbyte')}",
        _dur=to_int("data.duration"),
        _sub=lower_text("data.subtype"),
    )

    def matched(names) -> str:
        return f"least(size(array_intersect(_groups, {array_of(names)})), 2)"

    parts = [
        case(*[(f"_level >= {floor}", str(points)) for floor, points in K.LEVEL_POINTS],
             otherwise="0"),
        f"30 * {matched(K.RISK_CRITICAL_GROUPS)}",
        f"10 * {matched(K.RISK_MEDIUM_GROUPS)}",
        _points(any_word("_words", K.RISK_CRITICAL_WORDS), 20),
        _points(any_word("_words", K.RISK_MEDIUM_WORDS), 8),
        "CASE lower(data.severity) WHEN 'critical' THEN 35 WHEN 'high' THEN 25 "
        "WHEN 'medium' THEN 10 ELSE 0 END",
        _points("lower(data.apprisk) IN ('high', 'elevated')", 20),
        _points(any_word("_log", K.RISK_TOOL_WORDS), 25),
        _points(f"_port IN ({quoted_list(K.RISK_PORTS)})", 12),
        _points(f"_port IN ({quoted_list(K.RISK_PORTS)}) AND {lower_text('data.action')} "
                f"NOT IN ({quoted_list(K.RISK_STOPPED_ACTIONS)})", 10),
        case(("_bytes > 5000000", "25"), ("_bytes > 1000000", "10"), otherwise="0"),
        case(("_dur > 7200", "20"), ("_dur > 1800", "10"), otherwise="0"),
        case(("_sub = 'malware'", "30"), ("_sub IN ('ips', 'ids')", "10"), otherwise="0"),
    ]
    pointed = add(staged, weak_points=f"cast(least({' + '.join(parts)}, 100) AS BIGINT)")
    return pointed.selectExpr(*alerts.columns, "weak_points",
                              "cast(weak_points AS DOUBLE) / 100.0D AS weak_score")


def weak_label(scored: DataFrame, low: int = K.LABEL_LOW, high: int = K.LABEL_HIGH,
               grey_weight: float = K.GREY_WEIGHT) -> DataFrame:
    """Adds ``label`` and ``weight``: clear positives and negatives weigh 1, the grey zone less."""
    return add(
        scored,
        label=f"CASE WHEN weak_points <= {low} THEN 0L ELSE 1L END",
        weight=f"CASE WHEN weak_points > {low} AND weak_points < {high} "
               f"THEN {float(grey_weight)}D ELSE 1.0D END",
    )


def class_balance(labelled: DataFrame) -> DataFrame:
    """One row: rows per class, their weight and the positive rate."""
    positive = F.col("label") == 1
    return labelled.agg(
        F.count("*").alias("n"),
        F.count_if(~positive).alias("n_negative"),
        F.count_if(positive).alias("n_positive"),
        F.sum("weight").alias("weight_sum"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
    )


def check_classes(balance) -> None:
    """Stops training on an empty or single-class table."""
    if balance["n"] == 0:
        raise ValueError("no usable training rows")
    if balance["n_negative"] == 0 or balance["n_positive"] == 0:
        raise ValueError("only one class present: adjust the label cut points or add data")
