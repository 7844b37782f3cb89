"""Documents of a search export, nested or with flat dotted keys, to typed alerts."""

from pyspark.sql import DataFrame

from alertloom.schema import RAW_ALERT
from alertloom.sources.files import typed_alert_columns

SECTIONS = ("rule", "agent", "manager", "data", "decoder", "predecoder", "win")


def nested_section_sql(key: str, source: str = "m") -> str:
    """JSON text of one section: the nested object when it has content, else the ``key.*`` entries
    one level deep, else NULL."""
    own = f"{source}['{key}']"
    flat = f"map_filter({source}, (k, v) -> startswith(k, '{key}.'))"
    return (f"CASE WHEN startswith({own}, '{{') AND replace({own}, ' ', '') <> '{{}}' "
            f"THEN {own} WHEN size({flat}) > 0 THEN to_json(transform_keys({flat}, "
            f"(k, v) -> substring(k, {len(key) + 2}))) END")


def normalize_payload(hits: DataFrame) -> DataFrame:
    """Rows of (index, doc_id, source) to alerts with their provenance.

    Groups given as a comma string become a trimmed list, the id falls back to the document's, and
    the raw text is rebuilt without empty sections. Manager and predecoder stay as JSON text.
    """
    opened = hits.selectExpr(
        "index AS _os_index", "doc_id AS _os_doc_id",
        "from_json(source, 'map<string,string>') AS m"
    ).selectExpr("*", *[f"{nested_section_sql(s)} AS _{s}" for s in SECTIONS])
    fields = {f.name: f.dataType.simpleString() for f in RAW_ALERT.fields}
    sections = ", ".join(
        f"'{s}', from_json(_{s}, '{fields[s]}')" for s in ("rule", "agent", "decoder", "data", "win"))
    built = opened.selectExpr(
        "_os_index", "_os_doc_id", "_manager AS manager", "_predecoder AS predecoder",
        "named_struct('id', coalesce(m['id'], _os_doc_id), "
        "'timestamp', coalesce(nullif(m['timestamp'], ''), m['@timestamp'], ''), "
        f"'@timestamp', cast(NULL AS STRING), {sections}, "
        "'location', coalesce(m['location'], ''), 'full_log', coalesce(m['full_log'], '')) AS _p")
    return built.selectExpr("*", "to_json(_p) AS _raw").selectExpr(
        *typed_alert_columns("_p", "_raw"), "_os_index", "_os_doc_id", "manager", "predecoder")
