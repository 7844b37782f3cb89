"""Feature maps and the numeric feature columns they select."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom import constants as K
from alertloom.functions.coerce import flag


def feature_specs(feature_map: dict) -> list[tuple[str, str, float]]:
    """(name, path, default) triples from any accepted layout of a feature map.

    ``features`` may be a list (names or {name, path, default}), a flat dict (name to path or
    {path, default}) or a dict of sections, in which the inner keys are names and paths at once.
    """
    spec = feature_map.get("features")
    if isinstance(spec, list):
        entries = [(e, e) if isinstance(e, str) else (None, e) for e in spec]
    elif isinstance(spec, dict):
        flat = all("path" in v if isinstance(v, dict) else True for v in spec.values())
        if flat:
            entries = list(spec.items())
        else:
            entries = [
                (name, inner if isinstance(inner, dict) else name)
                for section in spec.values() if isinstance(section, dict)
                for name, inner in section.items()
            ]
    else:
        raise ValueError("a feature map needs a 'features' list or dict")

    out = []
    for name, entry in entries:
        if isinstance(entry, dict):
            name = name or entry.get("name") or entry.get("path")
            path, default = entry.get("path") or name, entry.get("default", 0)
        elif isinstance(entry, str):
            path, default = entry, 0
        else:
            raise ValueError(f"invalid feature entry for {name!r}")
        if not name or not path:
            raise ValueError(f"feature entry without a name or path: {entry!r}")
        out.append((str(name), str(path), float(default)))
    return out


def feature_names(feature_map: dict | None) -> list[str]:
    if feature_map is None:
        return list(K.COMPACT_FEATURES)
    return [name for name, _, _ in feature_specs(feature_map)]


def project_features(canon: DataFrame, feature_map: dict | None,
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ordered feature columns as DOUBLE; a path the canonical row lacks gives its default."""
    if feature_map is None:
        specs = [(n, n, 0.0) for n in K.COMPACT_FEATURES]
    else:
        specs = feature_specs(feature_map)
    have = set(canon.columns)
    return canon.selectExpr(*keep, *[
        (f"coalesce(try_cast(`{path}` AS DOUBLE), {default}D)" if path in have else f"{default}D")
        + f" AS `{name}`"
        for name, path, default in specs
    ])


def align_features(features: DataFrame, names: list[str],
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Exactly ``names`` in that order: absent ones become 0.0, others are dropped."""
    have = set(features.columns)
    return features.selectExpr(
        *keep,
        *[f"cast(`{n}` AS DOUBLE) AS `{n}`" if n in have else f"0.0D AS `{n}`" for n in names])


def feature_map_sql(names: list[str]) -> str:
    """MAP of all features by name, in vector order."""
    return "map(" + ", ".join(f"'{n}', `{n}`" for n in names) + ")"


def nonzero_map_sql(names: list[str]) -> str:
    return f"map_filter({feature_map_sql(names)}, (k, v) -> v <> 0.0D)"


def fill_enriched(canon: DataFrame) -> DataFrame:
    """Fills the declared features that follow from canonical data but have no path there.

    Rolling counters come from ``operators.rolling``; geo, ASN and TLS have no data source.
    """
    out = canon.withColumns({
        "service_dns": F.expr(flag("service_label = 'DNS'")),
        "logon_type_rdp": F.expr(flag("logon_type IN ('10', '7')")),
        "src_private": F.col("src_is_private"),
        "dst_private": F.col("dst_is_private"),
    })
    if "event_ts" in canon.columns:
        utc = F.to_utc_timestamp("event_ts", F.current_timezone())
        out = out.withColumn("hour", F.coalesce(F.hour(utc).cast("bigint"), F.lit(0)))
    return out
