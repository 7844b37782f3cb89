import json
from datetime import datetime, timedelta, timezone

import pytest

from alertloom.operators.canonical import canonicalize
from alertloom.operators.latency import successful
from alertloom.sources import files, scans
from alertloom.sources.payload import normalize_payload
from alertloom.streaming import sinks


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def ids(df):
    return sorted(r["doc_id"] for r in files.usable(df).collect())


A, B = {"id": "1", "rule": {"level": 3}}, {"id": "2"}


@pytest.mark.parametrize("text,expected", [
    (json.dumps([A, B]), ["1", "2"]),
    (json.dumps([A, 5, "x", None, B], indent=2), ["1", "2"]),
    (json.dumps(A), ["1"]),
    (json.dumps(A, indent=1), ["1"]),
    (json.dumps(A) + "\n\n{broken\n" + json.dumps(B) + "\n", ["1", "2"]),
    ("{broken\n" + json.dumps(B), ["2"]),
    (json.dumps({"alerts": [A, B]}), ["1", "2"]),
    (json.dumps({"items": [B]}, indent=2), ["2"]),
    (json.dumps({"data": [A]}), ["1"]),
    (json.dumps({"id": "9", "data": {"srcip": "1.1.1.1"}}), ["9"]),
    (json.dumps({"hits": {"hits": [{"_source": A}, {"_source": B}, {}]}}), ["1", "2"]),
    ("", []),
    ("  \n [" + json.dumps(A) + "]", ["1"]),
])
def test_file_shapes(spark, tmp_path, text, expected):
    path = write(tmp_path, "part.json", text)
    assert ids(files.read_alerts(spark, path)) == expected


def test_many_files_and_quarantine(spark, tmp_path):
    write(tmp_path, "a.json", json.dumps([A]))
    write(tmp_path, "b.json", json.dumps(B) + "\n[1, 2]\nnot json\n")
    parsed = files.read_alerts(spark, str(tmp_path / "*.json"))
    assert ids(parsed) == ["1", "2"]
    assert sorted(r["raw"] for r in files.quarantine(parsed).collect()) == ["[1, 2]", "not json"]
    with pytest.raises(ValueError):
        files.require_alerts(files.usable(parsed).limit(0))


def test_times_and_missing_id(make_alerts):
    stamps = ["2026-03-20T13:25:19.819+0100", "2026-03-20T12:25:19+00:00", "2026-03-20T12:25:19Z",
              "2026-03-20T12:25:19.819Z", "soon"]
    rows = make_alerts(*[{"id": str(n), "timestamp": t} for n, t in enumerate(stamps)]).selectExpr(
        "doc_id", "unix_seconds(event_ts) AS s").orderBy("doc_id").collect()
    base = int(datetime(2026, 3, 20, 12, 25, 19, tzinfo=timezone.utc).timestamp())
    assert [r["s"] for r in rows] == [base] * 4 + [None]
    twice = make_alerts({"full_log": "x"}, {"full_log": "x"}).select("doc_id").distinct().collect()
    assert len(twice) == 1 and len(twice[0][0]) == 64


def test_payload_nested_and_flat(spark):
    nested = {"id": "5", "rule": {"level": "7", "groups": ["a", "b"]}, "decoder": {"name": "sshd"}}
    flat = {"rule.level": 7, "rule.groups": "a, b", "agent.name": "h", "rule": {},
            "@timestamp": "2026-03-20T12:25:19Z", "data.srcip": "10.0.0.1"}
    hits = spark.createDataFrame([("i1", "d1", json.dumps(nested)), ("i1", "d2", json.dumps(flat))],
                                 "index STRING, doc_id STRING, source STRING")
    rows = {r["_os_doc_id"]: r for r in normalize_payload(hits).collect()}
    assert rows["d1"]["doc_id"] == "5" and rows["d1"]["rule"]["groups"] == ["a", "b"]
    assert rows["d2"]["doc_id"] == "d2" and rows["d2"]["rule"]["groups"] == ["a", "b"]
    assert rows["d2"]["rule"]["level"] == "7" and rows["d2"]["data"]["srcip"] == "10.0.0.1"
    assert rows["d2"]["agent"]["name"] == "h" and rows["d2"]["event_ts"] is not None
    assert "decoder" not in json.loads(rows["d2"]["raw"])
    assert canonicalize(normalize_payload(hits)).count() == 2


def test_batch_and_log_files(spark, tmp_path):
    batch = write(tmp_path, "batch.jsonl", "\n".join([
        json.dumps({"_batch_meta": True, "window_start": "s", "window_end": "e", "alert_count": 2}),
        json.dumps(A), "", "{bad", json.dumps(B)]))
    meta, alerts = files.read_batch(spark, batch)
    assert meta.first()["alert_count"] == 2 and ids(alerts) == ["1", "2"]
    log = write(tmp_path, "latency.jsonl", '{"latency_ms": 5}\n{"latency_ms": "7"}\nx\n'
                                           '{"latency_ms": 1.5, "status_code": 500, "ok": false}\n')
    assert sorted(r["latency_ms"] for r in files.read_latency(spark, log).collect()) == [1.5, 5.0]
    texts = ['{"latency_ms": 1, "status_code": "500"}', '{"latency_ms": 2, "ok": "false"}',
             '{"latency_ms": 3, "status_code": "200"}', '{"latency_ms": 4, "ok": true, "status_code": 200}',
             '{"latency_ms": 5, "ok": null, "status_code": null}', '{"latency_ms": 6, "status_code": [1]}']
    lines = files.parse_latency(spark.createDataFrame([(t,) for t in texts], "value STRING"))
    assert sorted(r["latency_ms"] for r in successful(lines).collect()) == [4.0, 5.0]
    texts = ['{"trust_score": 3.7}', '{"trust_score": null}', '{"trust_score": " 4 "}',
             '{"trust_score": "3.7"}', '{"trust_score": true}', '{"trust_score": {}}']
    rows = files.parse_feedback(spark.createDataFrame([(t,) for t in texts], "value STRING")).collect()
    assert [(r["trust_score"], r["bad"]) for r in rows] == [
        (3, False), (3, True), (4, False), (3, True), (1, False), (3, True)]
    log = write(tmp_path, "feedback.jsonl", '{"alert_id": "1", "trust_score": 4, "overridden": true}\n'
                                            'oops\n{"alert_id": "2"}\n')
    rows = files.read_feedback(spark, log).collect()
    assert sorted((r["trust_score"], r["overridden"], r["bad"]) for r in rows) == [
        (3, False, False), (3, False, True), (4, True, False)]


def test_responses(spark):
    top = [{"feature": "a", "value": "text", "impact": 0.5}, {"value": 2}, "junk", 3, None]
    cases = [
        {"predicted_score": 0.7, "predicted_label": "malicious", "top_features": top, "reason": "r"},
        {"ok": True, "explanation": {"predicted_score": "0.7", "predicted_label": "malicious",
                                     "top_features": top, "reason": "r"}},
        {"model": {"score": 0.7, "label": "malicious"}, "explanation": None, "top_features": top,
         "reason": "r"},
    ]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases], "value STRING")
    for r in files.read_responses(df).collect():
        assert (r["score"], r["label"], r["reason"]) == (0.7, "malicious", "r")
        assert [tuple(t) for t in r["top_features"]] == [("a", "text", 0.5)]


def test_windows_and_lookback():
    now = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
    assert scans.window_bounds(now) == (now - timedelta(minutes=10), now)
    assert scans.window_bounds(now, now - timedelta(minutes=25))[0] == now - timedelta(minutes=25)
    day = now - timedelta(days=1)
    assert scans.window_bounds(now, day) == (day, now)
    limit = now - timedelta(minutes=40)
    assert scans.capped_window(now, day) == (limit, now, (day, limit))
    assert scans.capped_window(now, limit) == (limit, now, None)
    assert scans.parse_since("2h", now) == now - timedelta(hours=2)
    with pytest.raises(ValueError):
        scans.parse_since("2w", now)


def test_boundary_belongs_to_one_window(make_alerts):
    a = make_alerts({"id": "1", "timestamp": "2026-01-01T00:10:00Z", "rule": {"level": 3}})
    t = [datetime(2026, 1, 1, 0, m, tzinfo=timezone.utc) for m in (0, 10, 20)]
    assert scans.time_window(a, t[0], t[1]).count() == 0
    assert scans.time_window(a, t[1], t[2]).count() == 1
    assert scans.time_window(a, t[0], t[1], closed=True).count() == 1


def test_sinks_round_trip(spark, make_alerts, tmp_path):
    alerts = make_alerts(*[{"id": str(n), "timestamp": f"2026-01-01T00:{n:02d}:00Z"}
                           for n in range(25)])
    sinks.write_windows(alerts, str(tmp_path / "w"))
    counts = spark.read.parquet(str(tmp_path / "w/windows")).select("alert_count").collect()
    assert sorted(r[0] for r in counts) == [5, 10, 10]
    assert spark.read.parquet(str(tmp_path / "w/alerts")).count() == 25
    sinks.write_shards(alerts.coalesce(1), str(tmp_path / "s"), records=10)
    assert len(list((tmp_path / "s").glob("part*"))) == 3
    assert len(ids(files.read_alerts(spark, str(tmp_path / "s"), "lines"))) == 25
    feedback = spark.createDataFrame([("1", 9, True, 5)], "alert_id STRING, trust_score BIGINT, "
                                     "overridden BOOLEAN, decision_ms BIGINT")
    sinks.append_feedback(feedback, str(tmp_path / "f"))
    stored = spark.read.json(str(tmp_path / "f")).first()
    assert stored["trust_score"] == 5 and stored["@ingested_at"].endswith("Z")


def test_one_broken_line_stays_one_bad_row(spark, tmp_path):
    good = '{"id": "1", "rule": {"level": 3}}'
    write(tmp_path, "head.json", "cut off {\n" + f"{good}\n" * 3)
    write(tmp_path, "tail.json", f"{good}\n" * 2 + '{"id": "2", "ru')
    write(tmp_path, "pretty.json", '[\n  {\n    "id": "3",\n    "rule": {"level": 3}\n  }\n]\n')
    found = files.read_alerts(spark, str(tmp_path)).groupBy("bad").count().collect()
    assert {r["bad"]: r["count"] for r in found} == {False: 6, True: 2}


def test_the_next_place_is_read_when_one_is_missing_or_empty(spark, tmp_path):
    write(tmp_path, "there.json", '{"id": "1"}\n')
    write(tmp_path, "empty.json", "")
    places = [str(tmp_path / n) for n in ("missing.json", "empty.json", "there.json")]
    found, place = files.first_available(places, lambda p: files.read_alerts(spark, p, "lines"))
    assert place == places[2] and ids(found) == ["1"]
    with pytest.raises(ValueError, match="missing.json.*empty.json: empty"):
        files.first_available(places[:2], lambda p: files.read_alerts(spark, p, "lines"))
