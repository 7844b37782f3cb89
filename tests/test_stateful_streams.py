"""Custom state on streams: exact rolling counters and templates by similarity."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pandas as pd

from alertloom.operators.canonical import canonicalize
from alertloom.operators.rolling import NAMES, rolling_counters
from alertloom.sources.files import parse_alerts, usable
from alertloom.streaming import ingest, stateful

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def lines(path, name, rows):
    """A file of JSON lines; files count as written minutes apart, so that streams read them in order."""
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    os.utime(path / name, (1e9 + 60 * int(name[0]),) * 2)


def alert(n, seconds, address, failed):
    at = (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    result = "Failed" if failed else "Accepted"
    return {"id": str(n), "timestamp": at, "decoder": {"name": "sshd"}, "rule": {"groups": ["authentication_failed" if failed else "sshd"]},
            "data": {"srcip": address} if address else {}, "full_log": f"sshd: {result} password for root"}


def drain(spark, df, name, tmp_path):
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)


def test_counters_of_a_list_equal_brute_force():
    rng = random.Random(1)
    rows = sorted((rng.randrange(0, 9000) * 1_000_000, rng.randrange(2)) for _ in range(400))
    five, hour = stateful.FIVE, stateful.HOUR
    want = [(sum(f for u, f in rows if us - five <= u <= us), sum(f for u, f in rows if us - hour <= u <= us),
             sum(1 for u, _ in rows if us - five <= u <= us)) for us, _ in rows]
    recent, got = [], []
    for end in range(0, 9000 * 1_000_000 + 1, stateful.SLICE):
        got += stateful.counters_at([r for r in rows if end <= r[0] < end + stateful.SLICE], recent)
        recent = [r for r in recent if r[0] >= end + stateful.SLICE - hour]
    assert got == want


def test_stream_counters_equal_batch_counters_over_several_batches(spark, tmp_path):
    rng, source = random.Random(2), tmp_path / "in"
    source.mkdir()
    rows = [alert(n, s, rng.choice(["10.0.0.1", "10.0.0.2", "8.8.8.8", None]), rng.random() < 0.5)
            for n, s in enumerate(sorted(rng.uniform(0, 3 * 3600) for _ in range(300)))]
    closing = alert(1000, 5 * 3600, "10.9.9.9", False)
    for k in range(3):  # neighbours of a file's edge come up to a minute late, within the watermark
        lines(source, f"{k}.json", rows[100 * k:100 * k + 100][::-1] + ([closing] if k == 2 else []))
    stream = ingest.alert_stream(spark, str(source), max_files=1).drop("bad")
    got = drain(spark, stateful.rolling_stream(canonicalize(stream, ("doc_id", "event_ts"))), "rolling", tmp_path)
    batch = usable(parse_alerts(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")))
    want = rolling_counters(canonicalize(batch, ("doc_id", "event_ts"))).where("src_ip <> ''")
    key = lambda df: sorted((r["doc_id"], *[r[n] for n in NAMES]) for r in df.collect())
    assert key(got) == key(want) != []


def test_template_state_merges_and_forgets(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    texts = ["user ann logged in from alpha", "user bob logged in from beta", "disk is full", "", None]
    for k, minute in enumerate((0, 10, 600)):
        at = [(START + timedelta(minutes=minute + i)).isoformat() for i in range(len(texts))]
        lines(source, f"{k}.json", [{"doc_id": f"{k}-{i}", "event_ts": a, "message": t} for i, (a, t) in enumerate(zip(at, texts))])
    stream = (spark.readStream.schema("doc_id string, event_ts timestamp, message string")
              .option("maxFilesPerTrigger", 1).json(str(source)))
    got = {r["doc_id"]: r for r in drain(
        spark, stateful.similar_template_stream(stream, retention_minutes=60), "templates2", tmp_path).collect()}
    assert len(got) == 12 and not any(d.endswith("-4") for d in got)
    assert got["0-0"]["template"] == texts[0] and got["0-1"]["template"] == "user <*> logged in from <*>"
    assert got["0-0"]["template_id"] == got["1-1"]["template_id"] and got["1-1"]["n"] == 4
    # Ten hours later the template has been forgotten, except that the same first message gives its id.
    assert got["2-0"]["template"] == texts[0] and got["2-0"]["n"] == 1
    assert got["1-2"]["n"] == 2 and got["2-2"]["n"] == 1


def test_place_takes_the_most_similar_cluster():
    clusters = [["a", "x y z w".split(), 1, 0], ["b", "x y q w".split(), 1, 0]]
    assert stateful.place("x y q v".split(), clusters) == 1
    assert stateful.place("k l m n".split(), clusters) is None
    assert stateful.place("x y t w".split(), clusters) == 0


def test_rolling_state_is_bounded_by_an_hour():
    recent = []
    for minute in range(600):
        stateful.counters_at([(minute * stateful.SLICE, 1)], recent)
        recent = [r for r in recent if r[0] >= (minute + 1) * stateful.SLICE - stateful.HOUR]
        assert len(recent) <= 60


class _Values(list):
    """A list state without a store."""

    def exists(self):
        return bool(self)

    def get(self):
        return iter(list(self))

    def put(self, rows):
        self[:] = rows

    appendList = list.extend


class _Instant:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def test_one_timer_settles_all_minutes_that_the_watermark_has_passed():
    timers = []
    rolling = stateful._Rolling()
    rolling.handle = type("Handle", (), {"registerTimer": lambda self, ms: timers.append(ms)})()
    rolling.waiting, rolling.recent = _Values(), _Values()
    minutes = list(range(100))
    rows = pd.DataFrame({"us": [m * stateful.SLICE for m in minutes], "fail": 1, "doc_id": [str(m) for m in minutes]})
    assert not list(rolling.handleInputRows(("a",), iter([rows[::-1]]), None))
    assert timers == [60_000]
    first = list(rolling.handleExpiredTimer(("a",), _Instant(80 * 60_000 + 1), _Instant(60_000)))
    assert sum(map(len, first)) == 80 and timers[1:] == [81 * 60_000, 140 * 60_000]
    assert not list(rolling.handleExpiredTimer(("a",), _Instant(80 * 60_000 + 1), _Instant(120_000)))
    rest = list(rolling.handleExpiredTimer(("a",), _Instant(200 * 60_000), _Instant(81 * 60_000)))
    told = pd.concat([*first, *rest])
    assert told.doc_id.tolist() == [str(m) for m in minutes] and not rolling.waiting
    assert told.auth_fail_1h.tolist() == [min(m + 1, 61) for m in minutes]
