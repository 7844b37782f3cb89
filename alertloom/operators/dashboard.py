"""Data behind the alert dashboard: newest documents, one page, one selected document."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Size of the search, page size, features and log pieces shown.
NEWEST, PAGE_ROWS, SHOWN_FEATURES, LOG_PIECE, LOG_PIECES = 200, 15, 12, 72, 4


def newest(docs: DataFrame, n: int = NEWEST, ts: str = "timestamp") -> DataFrame:
    return docs.orderBy(F.col(ts).desc(), F.col("doc_id")).limit(n)


def ranked(docs: DataFrame, n: int = NEWEST) -> DataFrame:
    """The newest documents with rank and display fields. The rank runs over these n rows only."""
    order = Window.orderBy(F.col("timestamp").desc(), F.col("doc_id"))
    return (
        newest(docs, n).withColumn("rank", F.row_number().over(order))
        .selectExpr(
            "cast(rank AS BIGINT) AS rank", "doc_id", "timestamp AS ts",
            "coalesce(predicted_score, 0.0D) AS score",
            "floor(coalesce(predicted_score, 0.0D) * 1000.0D + 0.5D) / 10.0D AS score_pct",
            "coalesce(predicted_label, 'N/A') AS label",
            "coalesce(alert.agent.name, '') AS agent",
            "coalesce(alert.rule.description, '') AS rule_desc",
            "coalesce(nullif(alert.rule.description, ''), nullif(reason, ''), 'No description') "
            "AS snippet")
    )


def page(ranked_docs: DataFrame, number: int = 1, size: int = PAGE_ROWS) -> DataFrame:
    return ranked_docs.where(f"rank > {(number - 1) * size} AND rank <= {number * size}")


def selected(docs: DataFrame, doc_id: str | None = None) -> DataFrame:
    """The chosen document, by default the newest one."""
    return newest(docs, 1) if doc_id is None else docs.where(F.col("doc_id") == doc_id)


def feature_lines(docs: DataFrame, shown: int = SHOWN_FEATURES) -> DataFrame:
    """Display lines of the strongest features, numbered from 1."""
    kept = ("transform(filter(top_features, t -> t.feature IS NOT NULL AND t.impact IS NOT NULL), "
            "t -> named_struct('o', -abs(t.impact), 'feature', t.feature, "
            "'value', coalesce(t.value, 0.0D), 'impact', t.impact))")
    return (
        docs.selectExpr("doc_id", f"posexplode_outer(slice(array_sort({kept}), 1, {shown})) AS (p, t)")
        .where("p IS NOT NULL")
        .selectExpr(
            "doc_id", "cast(p + 1 AS BIGINT) AS row", "t.feature AS feature", "t.value AS value",
            "t.impact AS impact",
            "format_string('%d. %s | value=%.3f | impact=%.4f', p + 1, t.feature, t.value, "
            "t.impact) AS line_text")
    )


# Label and source of the summary rows, in display order.
SUMMARY = (
    ("Rule", "alert.rule.description"), ("Agent", "alert.agent.name"),
    ("Decoder", "alert.decoder.name"), ("Location", "alert.location"),
    ("Rule ID", "alert.rule.id"), ("Level", "alert.rule.level"),
    ("Src IP", "alert.data.srcip"), ("Dst IP", "alert.data.dstip"),
    ("Service", "alert.data.service"), ("Port", "alert.data.dstport"),
    ("Action", "alert.data.action"), ("Severity", "alert.data.severity"),
)


def summary_rows(docs: DataFrame) -> DataFrame:
    """Label and value rows of a document, without empty ones, numbered over what is left."""
    items = ", ".join(f"named_struct('label', '{label}', 'val', cast({field} AS STRING))"
                      for label, field in SUMMARY)
    return (
        docs.selectExpr("doc_id", f"posexplode_outer(filter(array({items}), "
                                  "t -> coalesce(t.val, '') NOT IN ('', '—'))) AS (p, t)")
        .where("p IS NOT NULL")
        .selectExpr("doc_id", "cast(p + 1 AS BIGINT) AS rownum", "t.label AS label",
                    "t.val AS val")
    )


# Lines of the raw view in order; None marks a section heading.
RAW_LINES = (
    ("doc_id:         ", "doc_id"), ("timestamp:      ", "timestamp"),
    ("predicted_score: ", "format_string('%.4f', coalesce(predicted_score, 0.0D))"),
    ("predicted_label: ", "coalesce(predicted_label, 'N/A')"),
    ("---  alert  ---", None),
    ("rule.id:         ", "alert.rule.id"), ("rule.level:      ", "alert.rule.level"),
    ("rule.desc:       ", "alert.rule.description"), ("agent.id:        ", "alert.agent.id"),
    ("agent.name:      ", "alert.agent.name"), ("decoder:         ", "alert.decoder.name"),
    ("location:        ", "alert.location"),
    ("---  data  ---", None),
    ("src_ip:          ", "alert.data.srcip"), ("dst_ip:          ", "alert.data.dstip"),
    ("service:         ", "alert.data.service"), ("dst_port:        ", "alert.data.dstport"),
    ("action:          ", "alert.data.action"), ("severity:        ", "alert.data.severity"),
    ("subtype:         ", "alert.data.subtype"), ("proto:           ", "alert.data.proto"),
    ("---  xai  ---", None),
    ("reason:          ", "reason"), ("recommendation:  ", "recommendation"),
    ("---  full_log  ---", None),
)


def raw_lines(docs: DataFrame) -> DataFrame:
    """The raw view as numbered lines, followed by up to four pieces of the log text."""
    lines = [
        f"'{label}'" if field is None else
        f"concat('{label}', coalesce(nullif(cast({field} AS STRING), ''), '—'))"
        for label, field in RAW_LINES
    ] + [f"substring(coalesce(alert.full_log, ''), {n * LOG_PIECE + 1}, {LOG_PIECE})"
         for n in range(LOG_PIECES)]
    return (
        docs.selectExpr("doc_id", f"posexplode_outer(filter(array({', '.join(lines)}), "
                                  "l -> l <> '')) AS (p, line)")
        .where("p IS NOT NULL")
        .selectExpr("doc_id", "cast(p + 1 AS BIGINT) AS row", "line")
    )
