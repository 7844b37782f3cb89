"""Reports against brute force in Python."""

import math
import random
import statistics
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from alertloom.functions import ordering as O
from alertloom.models.evaluate import average_precision, classification_report
from alertloom.operators import consistency as C
from alertloom.operators import feedback as B
from alertloom.operators import latency as L
from alertloom.operators import rolling, sampling, templates


def test_order_statistics_on_a_long_tail(spark):
    rng = random.Random(3)
    values = [rng.choice([1.5, 2.5, 1e9 * rng.random(), rng.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x DOUBLE")
    s = sorted(values)
    for p in (0, 1, 50, 95, 99, 100):
        expected = s[0] if p <= 0 else s[-1] if p >= 100 else s[round(p / 100 * (len(s) - 1))]
        assert O.order_statistics(df, "x", {"v": O.nearest_rank(p)}).first()["v"] == expected
    row = O.linear_quantiles(df, "x", {"m": 0.5, "q": 0.995}).first()
    at = 0.995 * (len(s) - 1)
    low = s[math.floor(at)]
    assert row["m"] == statistics.median(values)
    assert math.isclose(row["q"], low + (at - math.floor(at)) * (s[math.ceil(at)] - low))


def test_single_value_and_empty(spark):
    one = spark.createDataFrame([(4.0,), (4.0,)], "x DOUBLE")
    assert O.linear_quantiles(one, "x", {"m": 0.5}).first()["m"] == 4.0
    assert O.linear_quantiles(one.limit(0), "x", {"m": 0.5}).first()["m"] is None


def test_numbering_is_complete_and_seeded(spark):
    df = spark.range(1000).selectExpr("cast(id AS STRING) AS k", "id % 3 AS g")
    rows = O.numbered(df, "k", ["g"], buckets=64).collect()
    for g in range(3):
        mine = sorted(r["row_no"] for r in rows if r["g"] == g)
        assert mine == list(range(1, len(mine) + 1))
    again = O.numbered(df.repartition(7), "k", ["g"], buckets=64).collect()
    assert {(r["k"], r["row_no"]) for r in rows} == {(r["k"], r["row_no"]) for r in again}


def test_resample_size_and_repeatability(spark):
    df = spark.range(50).selectExpr("cast(id AS STRING) AS doc_id")
    first = sampling.resample(df, 200).collect()
    assert len(first) == 200 and sorted(first) == sorted(sampling.resample(df, 200).collect())
    assert sampling.random_k(df, 10).count() == 10


def test_latency_filters(spark):
    rows = [(1.0, 200, True), (2.0, None, None), (3.0, 500, None), (4.0, 200, False),
            (5.0, None, True)]
    df = spark.createDataFrame(rows, "latency_ms DOUBLE, status_code INT, ok BOOLEAN")
    assert L.latency_summary(df).first().asDict() == {
        "samples": 3, "mean": 8 / 3, "min": 1.0, "max": 5.0, "median": 2.0, "p95": 5.0, "p99": 5.0}
    assert L.latency_summary(df, only_success=False).first()["samples"] == 5


def test_feedback(spark):
    rows = [("a", 9, True, 10, False), ("b", -1, False, 20, False), ("c", None, None, 30, False),
            ("x", 3, True, None, True)]
    df = spark.createDataFrame(
        rows, "alert_id STRING, trust_score BIGINT, overridden BOOLEAN, decision_ms BIGINT, bad BOOLEAN")
    clamped = B.clamp_trust(df)
    assert [r["trust_score"] for r in clamped.orderBy("alert_id").collect()] == [5, 1, 3, 3]
    assert B.feedback_metrics(clamped).first().asDict() == {
        "total_feedback": 4, "avg_trust": 9 / 4, "override_rate": 1 / 4}
    empty = B.feedback_metrics(clamped.limit(0)).first()
    assert empty["total_feedback"] == 0 and empty["avg_trust"] is None


def records(spark, rows):
    return spark.createDataFrame(
        rows, "key STRING, round BIGINT, i BIGINT, score DOUBLE, label STRING, "
              "top_features ARRAY<STRUCT<feature: STRING, value: DOUBLE, impact: DOUBLE>>")


def brute_spearman(xs, ys):
    def ranks(v):
        return [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]
    if len(xs) < 2 or len(set(xs)) < 2 or len(set(ys)) < 2:
        return None
    return statistics.correlation(ranks(xs), ranks(ys))


def test_consistency_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)  # several blocks per key
    rng, n_rounds, data = random.Random(5), 11, []
    for key in ("a", "b", "c"):
        for r in range(1, n_rounds + 1):
            names = rng.sample("pqrstu", rng.randint(0, 5))
            data.append((key, r, 1, rng.random(), rng.choice(["malicious", "benign"]),
                         [(f, 1.0, float(rng.randint(-2, 2))) for f in names]))
    report = {r["key"]: r for r in C.consistency_report(records(spark, data)).collect()}
    for key in ("a", "b", "c"):
        mine = [d for d in data if d[0] == key]
        labels = [d[4] for d in mine]
        assert math.isclose(report[key]["label_flip_rate"],
                            sum(a != b for a, b in zip(labels, labels[1:])) / (n_rounds - 1))
        assert report[key]["label_set"] == sorted(set(labels))
        assert math.isclose(report[key]["score_std"], statistics.stdev(d[3] for d in mine))
        base = {t[0]: t[2] for t in mine[0][5]}
        jac, rho = [], []
        for d in mine[1:]:
            cur = {t[0]: t[2] for t in d[5]}
            both, either = set(base) & set(cur), set(base) | set(cur)
            jac.append(len(both) / len(either) if either else 1.0)
            shared = sorted(both)
            value = brute_spearman([base[f] for f in shared], [cur[f] for f in shared])
            if value is not None:
                rho.append(value)
        assert math.isclose(report[key]["topfeat_jaccard_mean_vs_r1"], statistics.mean(jac))
        got = report[key]["impact_spearman_mean_vs_r1"]
        assert (got is None) if not rho else math.isclose(got, statistics.mean(rho), abs_tol=1e-12)


def test_one_round_is_stable(spark):
    report = C.consistency_report(records(spark, [("a", 1, 1, 0.5, "benign", [])])).first()
    assert (report["label_flip_rate"], report["score_std"],
            report["topfeat_jaccard_mean_vs_r1"]) == (0.0, 0.0, 1.0)


def test_first_record_is_the_base_whatever_its_round(spark):
    data = [
        ("late", 2, 1, 0.5, "benign", [("p", 1.0, 1.0), ("q", 1.0, 2.0)]),
        ("late", 3, 1, 0.6, "malicious", [("p", 1.0, 2.0)]),
        ("twice", 1, 1, 0.5, "benign", [("p", 1.0, 1.0), ("q", 1.0, 2.0), ("r", 1.0, 3.0)]),
        ("twice", 1, 2, 0.5, "benign", [("p", 1.0, 1.0), ("q", 1.0, 2.0)]),
        ("twice", 2, 1, 0.5, "benign", [("p", 1.0, 1.0), ("q", 1.0, 2.0)]),
        ("twice", 2, 2, 0.5, "benign", [("p", 1.0, 1.0), ("q", 1.0, 2.0)]),
        ("same", 1, 1, 0.5, "benign", [("p", 1.0, 9.0), ("q", 1.0, 2.0), ("p", 1.0, 1.0)]),
        ("same", 2, 1, 0.5, "benign", [("p", 1.0, 1.0), ("q", 1.0, 2.0), ("q", 1.0, 0.0)]),
        ("same", 600, 1, 0.5, "benign", [("p", 1.0, 1.0), ("q", 1.0, 2.0)]),
    ]
    report = {r["key"]: r for r in C.consistency_report(records(spark, data)).collect()}
    assert report["late"]["topfeat_jaccard_mean_vs_r1"] == 0.5
    assert report["late"]["label_flip_rate"] == 1.0
    assert math.isclose(report["twice"]["topfeat_jaccard_mean_vs_r1"], 2 / 3)
    assert report["same"]["topfeat_jaccard_mean_vs_r1"] == 1.0
    assert report["same"]["impact_spearman_mean_vs_r1"] == 0.0  # -1 and +1
    assert report["same"]["rounds"] == 600


def test_buckets_stay_even_on_long_tails_and_infinity(spark):
    from alertloom.functions.ordering import in_ranges
    rng = random.Random(11)
    tail = [10 ** rng.uniform(-6, 6) for _ in range(20000)]
    for values in (tail, tail + [float("inf"), float("-inf")]):
        df = spark.createDataFrame([(v,) for v in values], "x DOUBLE").distinct()
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        sizes = in_ranges(df, "x").groupBy("_b").agg({"x": "count", "*": "count"}).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert max(r["count(1)"] for r in sizes) < 0.05 * len(values)
        got = middle(df)
        assert got == sorted(values)[len(values) // 2]


def middle(df):
    from alertloom.functions.ordering import order_statistics
    return order_statistics(df, "x", {"mid": "n div 2"}).first()["mid"]


def test_a_busy_address_is_counted_in_linear_time(spark):
    import time
    df = spark.range(200_000).selectExpr(
        "'10.0.0.1' AS src_ip", "1L AS auth_result_neg", "id",
        "timestamp_micros(1704067200000000 + id * 17000) AS event_ts")
    start = time.time()
    top = rolling.rolling_counters(df).agg({"auth_fail_5m": "max", "auth_fail_1h": "max"}).first()
    assert sorted(top) == [300_000_000 // 17000 + 1, 200_000] and time.time() - start < 60


def test_rolling_against_brute_force(spark):
    rng, t0 = random.Random(8), datetime(2024, 1, 1, 5, 59, 0, tzinfo=timezone.utc)
    rows = [(n, rng.choice(["10.0.0.1"] * 4 + ["10.0.0.2", "", None]),
             t0 + timedelta(seconds=rng.randint(0, 9000)), rng.randint(0, 1)) for n in range(600)]
    rows[7] = (7, "10.0.0.1", None, 1)
    df = spark.createDataFrame(
        rows, "id BIGINT, src_ip STRING, event_ts TIMESTAMP, auth_result_neg BIGINT")
    got = {r["id"]: (r["auth_fail_5m"], r["auth_fail_1h"], r["conn_count_5m"])
           for r in rolling.rolling_counters(df).collect()}
    assert len(got) == len(rows)
    for n, ip, ts, _ in rows:
        if not ip or ts is None:
            assert got[n] == (0, 0, 0)
            continue
        near = {m: [r for r in rows if r[1] == ip and r[2] is not None
                    and timedelta(0) <= ts - r[2] <= timedelta(minutes=m)] for m in (5, 60)}
        assert got[n] == (sum(r[3] for r in near[5]), sum(r[3] for r in near[60]), len(near[5]))


def test_average_precision_and_report(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score DOUBLE, label BIGINT")
    total, recall, ap = sum(y for _, y in rows), 0.0, 0.0
    for cut in sorted({s for s, _ in rows}, reverse=True):
        kept = [y for s, y in rows if s >= cut]
        ap += (sum(kept) / total - recall) * sum(kept) / len(kept)
        recall = sum(kept) / total
    assert math.isclose(average_precision(df).first()["average_precision"], ap)
    none = classification_report(df.withColumn("predicted", F.lit(0))).collect()
    by_name = {r["name"]: r for r in none}
    assert by_name["1"]["precision"] == 0.0 and by_name["1"]["f1"] == 0.0
    assert by_name["0"]["recall"] == 1.0 and by_name["macro avg"]["support"] == 300


def test_templates_merge_one_varying_token(spark):
    texts = ["Failed password for root from 10.0.0.1 port 22", "user alice logged in",
             "user bob logged in", "user carol logged in", "disk full", "link 0x1f up", None]
    df = spark.createDataFrame([(t,) for t in texts], "message STRING")
    got = {r["template"]: (r["n"], r["variants"]) for r in templates.log_templates(df).collect()}
    assert got == {"Failed password for root from <IP> port <NUM>": (1, 1),
                   "user <*> logged in": (3, 3), "disk full": (1, 1), "link <HEX> up": (1, 1)}
    labelled = templates.label_messages(df).where("message LIKE 'user%'").select("template")
    assert {r[0] for r in labelled.collect()} == {"user <*> logged in"}
