from pyspark.sql import functions as F

import pytest

from alertloom.operators import policy as P
from alertloom.operators.canonical import canonicalize
from alertloom.operators.explain import clamp_top_k
from alertloom.operators.features import align_features, feature_specs, project_features
from alertloom.operators.weaklabel import check_classes, weak_label, weak_score
from alertloom.sources.config import default_feature_map, default_policy


def test_feature_map_layouts():
    assert feature_specs({"features": ["a", {"name": "b", "path": "p", "default": 2}]}) == [
        ("a", "a", 0.0), ("b", "p", 2.0)]
    assert feature_specs({"features": {"a": "x", "b": {"path": "y", "default": 1}}}) == [
        ("a", "x", 0.0), ("b", "y", 1.0)]
    assert feature_specs({"features": {"net": {"a": "text", "b": {"default": 3}}}}) == [
        ("a", "a", 0.0), ("b", "b", 3.0)]
    for broken in ({}, {"features": "x"}, {"features": [1]}, {"features": [{"default": 1}]}):
        with pytest.raises(ValueError):
            feature_specs(broken)


def test_default_map_has_46_features():
    assert len(feature_specs(default_feature_map())) == 46


def test_projection_defaults_and_alignment(make_alerts):
    canon = canonicalize(make_alerts({"id": "1", "rule": {"level": 4}}),
                         extra_columns={"twice_level": F.col("rule_level") * 2})
    fmap = {"features": ["rule_level", "action", "twice_level",
                         {"name": "geo", "path": "geo", "default": 7}]}
    row = project_features(canon, fmap).first()
    assert row.asDict() == {"doc_id": "1", "rule_level": 4.0, "action": 0.0, "twice_level": 8.0,
                            "geo": 7.0}
    aligned = align_features(project_features(canon, fmap), ["geo", "missing"])
    assert aligned.columns == ["doc_id", "geo", "missing"]
    assert aligned.first().asDict() == {"doc_id": "1", "geo": 7.0, "missing": 0.0}


WEAK = [
    ({"rule": {"level": 15}}, 60),
    ({"rule": {"level": "12", "groups": ["brute_force", "BRUTE_FORCE", "c2", "recon"]}}, 100),
    ({"rule": {"level": 4, "groups": ["syscheck"]}}, 14),
    ({"rule": {"description": "user visited store"}}, 20),
    ({"full_log": "sudo: permission denied"}, 8),
    ({"data": {"severity": "HIGH", "apprisk": "elevated"}}, 45),
    ({"data": {"attack": "CVE-2021-44228"}}, 25),
    ({"data": {"dstport": "443", "action": "accept"}}, 22),
    ({"data": {"dstport": 22, "action": "Blocked"}}, 12),
    ({"data": {"sentbyte": "4000000", "rcvdbyte": "1000001", "duration": 1801}}, 35),
    ({"data": {"subtype": "malware"}}, 30),
]


def test_weak_points(make_alerts):
    alerts = make_alerts(*[dict(a, id=str(n)) for n, (a, _) in enumerate(WEAK)])
    got = {int(r["doc_id"]): r["weak_points"] for r in weak_score(alerts).collect()}
    assert [got[n] for n in range(len(WEAK))] == [points for _, points in WEAK]


def test_label_cut_points(spark):
    rows = weak_label(spark.createDataFrame([(12,), (13,), (29,), (30,)], "weak_points BIGINT"))
    assert [(r["label"], r["weight"]) for r in rows.orderBy("weak_points").collect()] == [
        (0, 1.0), (1, 0.5), (1, 0.5), (1, 1.0)]
    with pytest.raises(ValueError):
        check_classes({"n": 0, "n_negative": 0, "n_positive": 0})
    with pytest.raises(ValueError):
        check_classes({"n": 5, "n_negative": 5, "n_positive": 0})


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id STRING, score DOUBLE, policy_source STRING, dst_svc_sensitive BIGINT, "
              "action STRING, pf_osks BIGINT, severity_ord BIGINT, service_snmp BIGINT")


def test_policy_bands_and_overrides(spark):
    rows = scored(spark, [
        ("a", 0.90, "network", 0, "na", 0, 0, 0), ("b", 0.5499, "network", 0, "na", 0, 0, 0),
        ("c", 0.70, "endpoint", 1, "allowed", 0, 0, 0), ("d", 0.99, "other", 0, "na", 0, 0, 0),
        ("e", 0.10, "server", 0, "na", 1, 2, 0), ("f", 0.95, "server", 0, "dropped", 1, 1, 1)])

    def tags(mode):
        out = P.apply_policy(rows, default_policy(), mode=mode)
        return {r["doc_id"]: (r["tag"], r["threshold"], r["policy_action"], r["do_shap"])
                for r in out.collect()}
    intended, observed = tags("intended"), tags("observed")
    assert intended["a"] == ("CRITICAL", 0.65, "Page on-call", True)
    assert intended["b"] == ("LOW", 0.65, "Queue", True)
    assert intended["c"][0] == "HIGH" and intended["d"] == ("LOW", 0.5, "Queue", True)
    assert intended["e"] == ("HIGH", 0.70, "Queue", False) and observed["e"][0] == "LOW"
    assert intended["f"][0] == "LOW" and observed["f"][0] == "CRITICAL"


def test_join_form_equals_compiled_form(spark):
    rows = scored(spark, [(f"{s}{n}", n / 100, s, 0, "x", 0, 0, 0)
                          for s in ("network", "endpoint", "server", "other")
                          for n in range(0, 101, 5)])
    sources, bands = P.policy_tables(spark, default_policy())
    joined = P.join_threshold(P.join_bands(rows, sources, bands, default_policy()), sources,
                              default_policy())
    columns = ["doc_id", "tag", "policy_action", "recommendation", "threshold"]
    compiled = P.apply_policy(rows, {**default_policy(), "overrides": []})
    assert joined.select(columns).exceptAll(compiled.select(columns)).count() == 0


def test_override_conditions():
    assert P.override_sql({"gone": ">=1"}, set()) == "coalesce(0D >= 1.0D, false)"
    assert P.override_sql({"gone": "x"}, set()) == "false"
    assert "> 2.0D" in P.override_sql({"a": ">=2"}, {"a"}, "observed")


def test_top_k():
    assert [clamp_top_k(k, n) for k, n in ((None, 46), (12, 46), (3, 46), (50, 46), (3, 5))] == [
        10, 12, 10, 46, 5]
