"""Alert files: JSON lines, arrays, single documents and wrappers, read into typed alerts.

Lines are read splittable. A file that holds one JSON document has to be read whole; convert very
large arrays once with ``sinks.write_shards`` and read them as lines from then on.
"""

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.schema import ALERT_COLUMNS, RAW_ALERT, WIN_EVENT

_CORRUPT = "_corrupt_record"
_READ_AS = T.StructType([*RAW_ALERT.fields, T.StructField(_CORRUPT, T.StringType())])

# Keys under which a document may wrap its alerts, in order of preference.
WRAPPERS = ("alerts", "items", "data")


def _strip(text: str) -> str:
    """Without blanks, tabs and line ends around it."""
    return f"trim(BOTH ' \\t\\r\\n' FROM {text})"


def typed_alert_columns(parsed: str, raw: str) -> list[str]:
    """SQL of the alert columns from a struct read with ``schema.RAW_ALERT``."""
    groups = (f"CASE WHEN startswith({parsed}.rule.groups, '[') "
              f"THEN from_json({parsed}.rule.groups, 'array<string>') "
              f"WHEN {parsed}.rule.groups IS NOT NULL "
              f"THEN transform(split({parsed}.rule.groups, ','), g -> trim(g)) END")
    event = f"from_json({parsed}.win.event, '{WIN_EVENT.simpleString()}')"
    stamp = f"coalesce(nullif({parsed}.timestamp, ''), {parsed}.`@timestamp`)"
    return [
        f"coalesce(nullif({parsed}.id, ''), sha2({raw}, 256)) AS doc_id",
        f"{parsed}.id AS id",
        f"coalesce(nullif({parsed}.`@timestamp`, ''), {parsed}.timestamp) AS timestamp",
        f"try_cast({stamp} AS TIMESTAMP) AS event_ts",
        f"named_struct('level', {parsed}.rule.level, 'id', {parsed}.rule.id, 'description', "
        f"{parsed}.rule.description, 'groups', {groups}) AS rule",
        f"{parsed}.agent AS agent", f"{parsed}.decoder AS decoder",
        f"{parsed}.location AS location", f"{parsed}.full_log AS full_log",
        f"{parsed}.data AS data",
        f"named_struct('event', {event}) AS win",
        f"coalesce(replace({parsed}.win.event, ' ', '') NOT IN ('', '{{}}'), false) "
        "AS has_win_event",
        f"{raw} AS raw",
    ]


def parse_alerts(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per JSON text: the alert columns, other input columns, and ``bad`` for text that
    is no JSON object (those rows have no alert)."""
    others = [c for c in lines.columns if c != value]
    parsed = lines.where(f"{_strip(value)} <> ''").withColumn("_p", F.from_json(
        value, _READ_AS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    return parsed.selectExpr(*typed_alert_columns("_p", value), *others,
                             f"_p IS NULL OR _p.{_CORRUPT} IS NOT NULL AS bad")


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where("NOT bad").drop("bad")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Text that could not be read, kept for a later look and counted instead of lost."""
    return parsed.where("bad").select("raw", *[c for c in parsed.columns
                                              if c not in ALERT_COLUMNS and c != "bad"])


def read_lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def unwrapped(documents: DataFrame) -> DataFrame:
    """Whole documents to one JSON text per alert.

    An array gives its elements, a wrapper those of its first list, a search export its sources,
    any other object itself. Text that is no JSON document is taken as lines.
    """
    shape = ("struct<" + ",".join(f"{w}:string" for w in WRAPPERS)
             + ",hits:struct<hits:array<struct<_source:string>>>>")
    opened = documents.selectExpr("file", f"{_strip('value')} AS value").selectExpr(
        "*", "try_parse_json(value) IS NOT NULL AS _whole", "substring(value, 1, 1) AS _c",
        f"from_json(value, '{shape}') AS _w")
    lists = " ".join(f"WHEN startswith(_w.{w}, '[') THEN from_json(_w.{w}, 'array<string>')"
                     for w in WRAPPERS)
    items = ("CASE WHEN NOT _whole THEN split(value, '\\n') "
             "WHEN _c = '[' THEN from_json(value, 'array<string>') "
             f"{lists} WHEN _w.hits.hits IS NOT NULL THEN transform(_w.hits.hits, h -> h._source) "
             "ELSE array(value) END")
    return (
        opened.selectExpr("file", "_whole", f"explode_outer({items}) AS value")
        .where(f"{_strip('value')} <> '' AND (NOT _whole OR startswith(value, '{{'))")
        .select("value", "file")
    )


def layouts(spark: SparkSession, paths) -> DataFrame:
    """Per file: ``lines`` when its first or its last line is an object of its own, else ``document``.

    A document over several lines begins and ends with a line that is none, so a file of lines with a
    broken line at one end stays one.
    """
    edges = (
        spark.read.text(paths)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.struct(F.col("_metadata.file_block_start"),
                         F.monotonically_increasing_id()).alias("at"))
        .where(f"{_strip('value')} <> ''")
        .groupBy("file").agg(F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"))
    )
    wrapper = " OR ".join(f"startswith(coalesce(m['{w}'], ''), '[')" for w in WRAPPERS)

    def own(line: str) -> str:
        return (f"transform(array(CASE WHEN try_parse_json({line}) IS NOT NULL AND "
                f"startswith({_strip(line)}, '{{') THEN from_json({line}, 'map<string,string>') END), "
                f"m -> m IS NOT NULL AND NOT ({wrapper} OR map_contains_key(m, 'hits')))[0]")

    return edges.selectExpr("file", f"CASE WHEN {own('first')} OR {own('last')} THEN 'lines' ELSE 'document' END "
                                    "AS layout")


def read_alerts(spark: SparkSession, paths, layout: str = "auto") -> DataFrame:
    """Alerts of all files, with ``file`` and ``bad``. Give ``layout`` ("lines" or "document")
    where it is known: telling them apart costs a pass over the first lines."""
    if layout == "auto":
        # One short row per file, like the listing the driver holds anyway.
        found: dict[str, list[str]] = {"lines": [], "document": []}
        for row in layouts(spark, paths).toLocalIterator():
            found[row["layout"]].append(row["file"])
    else:
        found = {"lines": [], "document": [], layout: [paths] if isinstance(paths, str) else paths}
    empty = spark.createDataFrame([], "value STRING, file STRING")
    texts = empty
    if found["lines"]:
        texts = read_lines(spark, found["lines"])
    if found["document"]:
        whole = spark.read.text(found["document"], wholetext=True).select(
            "value", F.col("_metadata.file_path").alias("file"))
        texts = texts.unionByName(unwrapped(whole)) if found["lines"] else unwrapped(whole)
    return parse_alerts(texts)


def first_available(candidates: list, read: Callable[[object], DataFrame]) -> tuple[DataFrame, object]:
    """The first of several places that can be read and holds a row, and which one it was.

    ``read`` turns a place (a path, a list of paths) into a frame. A place that is missing, cannot be
    listed or is empty is passed over; if none is left, the reasons are told.
    """
    reasons = []
    for place in candidates:
        try:
            found = read(place)
            if not found.isEmpty():
                return found, place
            reasons.append(f"{place}: empty")
        except (PySparkException, Py4JJavaError) as error:
            reasons.append(f"{place}: {str(error).splitlines()[0]}")
    raise ValueError("nothing to read: " + "; ".join(reasons))


def require_alerts(alerts: DataFrame) -> DataFrame:
    """The same frame; fails when it holds no alert."""
    if alerts.isEmpty():
        raise ValueError("no alerts found in the given files")
    return alerts


def read_batch(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Metadata rows and alerts of window batch files."""
    lines = read_lines(spark, paths).withColumn(
        "_meta", F.expr("coalesce(get_json_object(value, '$._batch_meta') = 'true', false)"))
    meta = lines.where("_meta").select(
        F.from_json("value", "window_start STRING, window_end STRING, alert_count BIGINT, "
                             "created_at STRING").alias("m"), "file").select("m.*", "file")
    return meta, parse_alerts(lines.where("NOT _meta").drop("_meta"))


def read_latency(spark: SparkSession, paths) -> DataFrame:
    """Latency log lines with a numeric latency; other lines are skipped."""
    return parse_latency(spark.read.text(paths))


def parse_latency(lines: DataFrame, value: str = "value") -> DataFrame:
    """As ``read_latency``, from text. A status that is there but no number becomes 0, an ``ok`` that
    is there but not JSON true becomes false: both count as failures."""
    record = F.from_json(value, "doc_id STRING, latency_ms DOUBLE, status_code VARIANT, ok VARIANT")
    return (
        lines.select(record.alias("r")).select("r.*").where("latency_ms IS NOT NULL")
        .selectExpr(
            "doc_id", "latency_ms",
            "CASE WHEN status_code IS NULL OR is_variant_null(status_code) THEN NULL "
            "WHEN schema_of_variant(status_code) = 'BIGINT' "
            "THEN coalesce(try_variant_get(status_code, '$', 'int'), 0) ELSE 0 END AS status_code",
            "CASE WHEN ok IS NULL OR is_variant_null(ok) THEN NULL "
            "ELSE schema_of_variant(ok) = 'BOOLEAN' AND try_variant_get(ok, '$', 'boolean') END AS ok")
    )


def read_feedback(spark: SparkSession, paths) -> DataFrame:
    """Feedback log lines; a line that cannot be read stays as a row with ``bad`` set."""
    return parse_feedback(spark.read.text(paths))


def parse_feedback(lines: DataFrame, value: str = "value") -> DataFrame:
    """As ``read_feedback``, from text. The trust is 3 if absent, numbers lose their fraction, text
    must be a whole number; null and anything else make the row bad."""
    trust = ("CASE WHEN r.trust_score IS NULL THEN 3L "
             "WHEN schema_of_variant(r.trust_score) = 'STRING' THEN CASE WHEN "
             "try_variant_get(r.trust_score, '$', 'string') RLIKE '^\\\\s*[+-]?[0-9]+\\\\s*$' "
             "THEN try_cast(trim(try_variant_get(r.trust_score, '$', 'string')) AS BIGINT) END "
             "WHEN NOT is_variant_null(r.trust_score) "
             "THEN try_cast(try_variant_get(r.trust_score, '$', 'double') AS BIGINT) END")
    return (
        lines.select(F.col(value), F.from_json(
            value, "alert_id STRING, trust_score VARIANT, overridden BOOLEAN, decision_ms BIGINT")
            .alias("r"))
        .selectExpr("r.alert_id", f"{trust} AS _trust", "coalesce(r.overridden, false) AS overridden",
                    "r.decision_ms", f"try_parse_json({value}) IS NULL AS _broken")
        .selectExpr("alert_id", "coalesce(_trust, 3L) AS trust_score", "overridden", "decision_ms",
                    "_broken OR _trust IS NULL AS bad")
    )


def read_responses(responses: DataFrame, value: str = "value") -> DataFrame:
    """Explanation responses, flat or nested, to score, label, top features and reason.

    Entries of the feature list that are no objects or name no feature are skipped one by one.
    """
    inner = ("predicted_score STRING, predicted_label STRING, score STRING, label STRING, "
             "model STRUCT<score: STRING, label: STRING>, reason STRING, top_features ARRAY<STRING>, "
             "explanation STRUCT<reason: STRING, top_features: ARRAY<STRING>>")
    core = (f"from_json(CASE WHEN startswith(get_json_object({value}, '$.explanation'), '{{')"
            f" THEN get_json_object({value}, '$.explanation') ELSE {value} END, '{inner}')")
    top = ("CASE WHEN coalesce(size(c.top_features), 0) > 0 THEN c.top_features "
           "ELSE coalesce(c.explanation.top_features, array()) END")
    others = [c for c in responses.columns if c != value]
    return responses.selectExpr(*others, f"{core} AS c").selectExpr(
        *others,
        "coalesce(try_cast(c.predicted_score AS DOUBLE), try_cast(c.model.score AS DOUBLE), "
        "try_cast(c.score AS DOUBLE)) AS score",
        "coalesce(c.predicted_label, c.model.label, c.label) AS label",
        f"filter(transform(filter({top}, t -> startswith(t, '{{')), t -> named_struct("
        "'feature', get_json_object(t, '$.feature'), 'value', get_json_object(t, '$.value'), "
        "'impact', try_cast(get_json_object(t, '$.impact') AS DOUBLE))), "
        "t -> t.feature IS NOT NULL) AS top_features",
        "coalesce(nullif(c.reason, ''), c.explanation.reason) AS reason")
