"""Per-source policy: threshold, severity band, overrides and attribution budget.

With a handful of sources and bands the policy is compiled into CASE expressions; the join form
over broadcast policy tables gives the same rows for policies kept as tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.coerce import add, quoted

_COMPARISONS = (">=", "<=", ">", "<")


def _default(policy: dict, key: str, fallback):
    return policy.get("defaults", {}).get(key, fallback)


def _per_source(policy: dict, of_source, otherwise: str, source: str) -> str:
    whens = " ".join(f"WHEN {quoted(name)} THEN {of_source(spec)}"
                     for name, spec in policy.get("sources", {}).items())
    return f"CASE {source} {whens} ELSE {otherwise} END" if whens else otherwise


def _bands(spec: dict) -> list[dict]:
    return sorted(spec.get("bands", []), key=lambda b: -float(b.get("min", 0)))


def threshold_sql(policy: dict, source: str = "policy_source") -> str:
    fallback = float(_default(policy, "decision_threshold", 0.5))
    return _per_source(policy, lambda s: f"{float(s.get('decision_threshold', fallback))}D",
                       f"{fallback}D", source)


def band_sql(policy: dict, field: str, score: str, source: str = "policy_source") -> str:
    """``tag``, ``action`` or ``recommend`` of the highest band the score reaches."""
    fallback = {"tag": _default(policy, "default_tag", "LOW"),
                "action": _default(policy, "min_action", "Queue"),
                "recommend": _default(policy, "min_recommendation", "Monitor traffic")}[field]

    def of_source(spec: dict) -> str:
        base = spec.get("default_tag", fallback) if field == "tag" else fallback
        whens = " ".join(
            f"WHEN {score} >= {float(b.get('min', 0))}D THEN {quoted(b.get(field, base))}"
            for b in _bands(spec))
        return f"CASE {whens} ELSE {quoted(base)} END" if whens else quoted(base)

    return _per_source(policy, of_source, quoted(fallback), source)


def override_sql(when: dict, columns: set[str], mode: str = "intended") -> str:
    """Condition of one override. A column that is not there is 0 for comparisons and equals nothing.

    ``observed`` reproduces the strict reading of ``>=`` and ``<=`` (both also have to pass the
    strict test); ``intended`` includes the bound.
    """
    tests = []
    for name, wanted in when.items():
        operator = next((o for o in _COMPARISONS if str(wanted).startswith(o)), None) \
            if isinstance(wanted, str) else None
        if operator:
            bound = float(wanted[len(operator):])
            if mode == "observed":
                operator = operator[0]
            value = (f"try_cast(coalesce(nullif(cast(`{name}` AS STRING), ''), '0') AS DOUBLE)"
                     if name in columns else "0D")
            tests.append(f"coalesce({value} {operator} {bound}D, false)")
        elif name not in columns:
            tests.append("false")
        else:
            literal = quoted(wanted) if isinstance(wanted, str) else str(wanted)
            tests.append(f"coalesce(`{name}` = {literal}, false)")
    return " AND ".join(tests) if tests else "true"


def tag_sql(policy: dict, base: str, columns: set[str], mode: str = "intended") -> str:
    """The band tag after all overrides; a later matching override wins."""
    whens = []
    for override in reversed(policy.get("overrides") or []):
        to = override.get("downgrade_to", override.get("elevate_to"))
        if to is not None:
            whens.append(f"WHEN {override_sql(override.get('when', {}), columns, mode)} "
                         f"THEN {quoted(to)}")
    return f"CASE {' '.join(whens)} ELSE {base} END" if whens else base


def top_k(policy: dict) -> int:
    return max(int(_default(policy, "top_k_min", 10)), int(_default(policy, "top_k", 12)))


def apply_policy(df: DataFrame, policy: dict, score: str = "score",
                 source: str = "policy_source", mode: str = "intended",
                 columns: set[str] | None = None) -> DataFrame:
    """Adds threshold, tag, action, recommendation, do_shap and top_k to scored canonical rows.

    ``columns`` limits what overrides may look at (the numeric features in ``observed`` mode).
    """
    seen = set(df.columns) if columns is None else columns
    enabled = str(bool(_default(policy, "shap_enabled", True))).lower()
    floor = float(_default(policy, "shap_min_score", 0.2))
    banded = add(df, _tag=band_sql(policy, "tag", score, source))
    return add(
        banded,
        threshold=threshold_sql(policy, source),
        tag=tag_sql(policy, "_tag", seen, mode),
        policy_action=band_sql(policy, "action", score, source),
        recommendation=band_sql(policy, "recommend", score, source),
        do_shap=f"{enabled} AND {score} >= {floor}D",
        top_k=str(top_k(policy)),
    ).drop("_tag")


def policy_tables(spark: SparkSession, policy: dict) -> tuple[DataFrame, DataFrame]:
    """The policy as two small tables: one row per source, one row per band."""
    fallback = float(_default(policy, "decision_threshold", 0.5))
    default_tag = _default(policy, "default_tag", "LOW")
    sources, bands = [], []
    for name, spec in policy.get("sources", {}).items():
        sources.append((name, float(spec.get("decision_threshold", fallback)),
                        spec.get("default_tag", default_tag)))
        for band in spec.get("bands", []):
            bands.append((name, band.get("name"), float(band.get("min", 0)), band.get("tag"),
                          band.get("action"), band.get("recommend")))
    def table(rows: list[tuple], columns: str) -> DataFrame:
        values = ", ".join("(" + ", ".join(
            "NULL" if v is None else f"{v!r}D" if isinstance(v, float) else quoted(v)
            for v in row) + ")" for row in rows)
        return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")

    return (
        table(sources, "policy_source, source_threshold, source_tag"),
        table(bands, "policy_source, band, min_score, band_tag, band_action, band_recommend"),
    )


def join_threshold(df: DataFrame, sources: DataFrame, policy: dict) -> DataFrame:
    """Threshold by equi join; unknown sources get the default row's value.

    The policy side is one row per configured source, so it is broadcast.
    """
    fallback = float(_default(policy, "decision_threshold", 0.5))
    return (df.join(F.broadcast(sources), "policy_source", "left")
            .withColumn("threshold", F.coalesce("source_threshold", F.lit(fallback)))
            .drop("source_threshold", "source_tag"))


def join_bands(df: DataFrame, sources: DataFrame, bands: DataFrame, policy: dict,
               score: str = "score") -> DataFrame:
    """Band by join on the source: all bands of a source as one sorted array on its row."""
    packed = bands.groupBy("policy_source").agg(F.sort_array(F.collect_list(F.struct(
        "min_score", "band_tag", "band_action", "band_recommend")), asc=False).alias("_bands"))
    per_source = sources.join(packed, "policy_source", "left")
    return (
        df.join(F.broadcast(per_source), "policy_source", "left")
        .withColumn("_band", F.expr(f"try_element_at(filter(_bands, b -> b.min_score <= {score}), 1)"))
        .withColumns({
            "tag": F.coalesce("_band.band_tag", "source_tag",
                              F.lit(_default(policy, "default_tag", "LOW"))),
            "policy_action": F.coalesce("_band.band_action",
                                        F.lit(_default(policy, "min_action", "Queue"))),
            "recommendation": F.coalesce(
                "_band.band_recommend",
                F.lit(_default(policy, "min_recommendation", "Monitor traffic"))),
        })
        .drop("_bands", "_band", "source_threshold", "source_tag")
    )
