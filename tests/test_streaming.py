import json

from pyspark.sql import functions as F

from alertloom.operators.canonical import canonicalize
from alertloom.plans.catalogue import _stand_in_documents
from alertloom.sources import fixtures
from alertloom.sources.files import parse_alerts, usable
from alertloom.streaming import ingest


def test_stream_equals_batch_and_quarantines(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    raw = fixtures.alerts(spark, sf).select(F.col("raw").alias("value"))
    raw.repartition(3).write.text(source)
    (tmp_path / "in" / "bad.txt").write_text("not json\n[1]\n")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        query = ingest.score_stream(ingest.alert_stream(spark, source, max_files=2),
                                    _stand_in_documents, out, checkpoint, min_level=0)
        query.awaitTermination()
        return query

    query = run()
    counters = ingest.run_counters(spark, out).first()
    assert counters["batches"] >= 2 and counters["total"] == 1002
    assert (counters["written"], counters["bad"], counters["late"], counters["repeated"]) == (1000, 2, 0, 0)
    columns = ["doc_id", "predicted_score", "tag", "reason"]
    batch = _stand_in_documents(usable(parse_alerts(raw))).select(columns)

    def stored():
        return spark.read.parquet(f"{out}/explanations").select(columns)

    assert stored().count() == 1000 and batch.exceptAll(stored()).count() == 0
    assert spark.read.parquet(f"{out}/quarantine").count() == 2
    assert ingest.retry_quarantine(spark, out).where("bad").count() == 2
    run()  # nothing new: the checkpoint keeps its place
    assert stored().count() == 1000


def test_a_batch_keeps_no_rows_in_memory(spark, tmp_path):
    source, out, held = tmp_path / "in", str(tmp_path / "out"), []
    source.mkdir()
    lines(source, "1.json", *[{"id": str(n % 40), "timestamp": f"2026-01-01T00:00:{n:02d}Z"} for n in range(50)])
    known = {r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()}

    def explain(rows):
        assert rows.count() == 40
        held.extend(r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo() if r.id() not in known)
        return rows.select("doc_id")

    ingest.score_stream(ingest.alert_stream(spark, str(source)), explain, out, str(tmp_path / "checkpoint"),
                        min_level=0).awaitTermination()
    counters = ingest.run_counters(spark, out).first()
    assert (counters["total"], counters["written"], counters["repeated"]) == (50, 40, 10)
    assert not held and not list((tmp_path / "out" / "work").glob("*"))


def drain(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def lines(path, name, *alerts):
    (path / name).write_text("\n".join(json.dumps(a) for a in alerts) + "\n")


def test_repeats_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    a = {"id": "1", "timestamp": "2026-01-01T00:00:00Z"}
    lines(source, "1.json", a, a)
    lines(source, "2.json", a, {"id": "2", "timestamp": "2026-01-01T00:05:00Z"})
    stream = ingest.deduplicated(ingest.alert_stream(spark, str(source), max_files=1))
    assert sorted(r["doc_id"] for r in drain(spark, stream, "dedup").collect()) == ["1", "2"]


def test_stream_windows_and_templates(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines(source, "1.json", *[
        {"id": str(n), "timestamp": f"2026-01-01T00:{n:02d}:00Z", "decoder": {"name": "sshd"},
         "full_log": f"sshd: Failed password for root from 10.0.0.1 port {n}"} for n in range(30)])
    alerts = ingest.alert_stream(spark, str(source)).drop("bad")
    volumes = drain(spark, ingest.volume_stream(alerts), "volumes", "complete").collect()
    assert sorted(r["n"] for r in volumes) == [10, 10, 10]
    messages = alerts.select(F.col("full_log").alias("message"))
    found = drain(spark, ingest.template_stream(messages), "templates", "complete").collect()
    assert [(r["template"], r["n"]) for r in found] == [
        ("sshd: Failed password for root from <IP> port <NUM>", 30)]
    counts = ingest.sliding_counts(canonicalize(alerts, ("doc_id", "event_ts")))
    peak = drain(spark, counts, "sliding", "complete").agg(F.max("auth_fail_5m")).first()[0]
    assert peak == 5
