"""Stateful operators on streams: exact rolling counters and templates by similarity.

Both keep custom state per key and act on event-time timers. Rows wait until the watermark has passed
their minute; then no earlier row can come any more and their counters are final, equal to the batch
counters of ``operators.rolling``. State is bounded by event time: an address keeps one hour of counts,
a template is forgotten when no message met it for ``RETENTION_MINUTES``.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from alertloom.operators.rolling import NAMES
from alertloom.operators.template_tree import SIMILARITY
from alertloom.operators.templates import WILDCARD, mask_sql, template_id_sql
from alertloom.streaming.ingest import WATERMARK

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SECOND = 1_000_000
SLICE, FIVE, HOUR = 60 * _SECOND, 300 * _SECOND, 3600 * _SECOND
RETENTION_MINUTES = 24 * 60


def stateful_session(df: DataFrame) -> DataFrame:
    """Custom state needs the RocksDB store; it must be chosen before a query starts."""
    df.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return df


def counters_at(due: list[tuple[int, int]], recent: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(failures 5 min, failures 1 h, connections 5 min) of rows (instant, fail) sorted by instant.

    ``recent`` holds (instant, failures, connections) of the hour before and gets the new instants.
    """
    for us, fail in due:
        if recent and recent[-1][0] == us:
            recent[-1] = (us, recent[-1][1] + fail, recent[-1][2] + 1)
        else:
            recent.append((us, fail, 1))
    out, five, hour, end = [], 0, 0, 0
    fails5 = fails60 = conns5 = 0
    for us, _ in due:
        while end < len(recent) and recent[end][0] <= us:
            fails5, fails60, conns5 = fails5 + recent[end][1], fails60 + recent[end][1], conns5 + recent[end][2]
            end += 1
        while recent[five][0] < us - FIVE:
            fails5, conns5 = fails5 - recent[five][1], conns5 - recent[five][2]
            five += 1
        while recent[hour][0] < us - HOUR:
            fails60 -= recent[hour][1]
            hour += 1
        out.append((fails5, fails60, conns5))
    return out


class _Rolling(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, fail bigint, doc_id string")
        self.recent = handle.getListState("recent", "us bigint, fails bigint, conns bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendList(list(zip(part["us"].tolist(), part["fail"].tolist(), part["doc_id"].tolist())))
            if len(part):
                least = int(part["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, us: int) -> None:
        """A timer for the end of the minute of an instant."""
        self.handle.registerTimer((us // SLICE * SLICE + SLICE) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All minutes that the watermark has passed are settled at once, whichever of their timers comes first.
        limit = max(expiredTimerInfo.getExpiryTimeInMs() * 1000,
                    timerValues.getCurrentWatermarkInMs() * 1000 // SLICE * SLICE)
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        due = sorted((w for w in waiting if w[0] < limit), key=lambda w: w[0])
        if due:
            left = [w for w in waiting if w[0] >= limit]
            _put(self.waiting, left)
            if left:
                self._wake(min(w[0] for w in left))
            found = counters_at([w[:2] for w in due], recent)
            # The last instant of a minute leaves the state an hour after that minute.
            self.handle.registerTimer((limit + HOUR) // 1000)
            yield pd.DataFrame([(key[0], us, doc, *c) for (us, _, doc), c in zip(due, found)],
                               columns=["address", "us", "doc_id", *NAMES])
        _put(self.recent, [r for r in recent if r[0] >= limit - HOUR])


def _put(state, rows: list) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def rolling_stream(canon: DataFrame, address: str = "src_ip", ts: str = "event_ts",
                   delay: str = WATERMARK) -> DataFrame:
    """(address, us, doc_id, counters) of a stream, each row once, when the watermark has passed it.

    Rows without an address or time have no counters and are left out; rows later than the watermark are
    late and left out. The state of one address is kept by one task.
    """
    rows = (
        stateful_session(canon).withWatermark(ts, delay)
        .where((F.coalesce(F.col(address), F.lit("")) != "") & F.col(ts).isNotNull())
        .select(F.col(address).alias("address"), F.col(ts), F.unix_micros(ts).alias("us"),
                F.col("auth_result_neg").cast("long").alias("fail"), F.col("doc_id").cast("string").alias("doc_id")))
    return rows.groupBy("address").transformWithStateInPandas(
        statefulProcessor=_Rolling(), outputMode="Append", timeMode="EventTime",
        outputStructType="address string, us bigint, doc_id string, " + ", ".join(f"{n} bigint" for n in NAMES))


def place(words: list[str], clusters: list[list]) -> int | None:
    """The cluster (id, words, n, seen) most similar to a message, the oldest of equals, if similar enough."""
    best, found = -1, None
    for k, (_, known, _, _) in enumerate(clusters):
        same = sum(a == b for a, b in zip(words, known))
        if 100 * same >= SIMILARITY * len(words) and same > best:
            best, found = same, k
    return found


class _Templates(StatefulProcessor):
    def __init__(self, retention: int):
        self.retention = retention

    def init(self, handle) -> None:
        self.handle = handle
        self.clusters = handle.getListState("clusters", "id string, template string, n bigint, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [[i, t.split(" "), n, seen] for i, t, n, seen in (self.clusters.get() if self.clusters.exists() else ())]
        for part in rows:
            out = []
            for ms, doc, masked, own in sorted(zip(part["ms"], part["doc_id"], part["masked"], part["id"])):
                words = masked.split(" ")
                # Timers clear the state of idle leaves; a message itself never meets what is too old for it.
                known = [c for c in known if c[3] + self.retention > ms]
                at = place(words, known)
                if at is None:
                    known.append([own, words, 0, ms])
                    at = len(known) - 1
                cluster = known[at]
                cluster[1] = [a if a == b else WILDCARD for a, b in zip(cluster[1], words)]
                cluster[2], cluster[3] = cluster[2] + 1, max(cluster[3], ms)
                self.handle.registerTimer(int(ms) + self.retention)
                out.append((doc, cluster[0], " ".join(cluster[1]), cluster[2]))
            yield pd.DataFrame(out, columns=["doc_id", "template_id", "template", "n"])
        _put(self.clusters, [(i, " ".join(w), int(n), int(seen)) for i, w, n, seen in known])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = expiredTimerInfo.getExpiryTimeInMs() - self.retention
        _put(self.clusters, [tuple(c) for c in (self.clusters.get() if self.clusters.exists() else ()) if c[3] > old])
        return iter(())


def similar_template_stream(messages: DataFrame, message: str = "message", ts: str = "event_ts",
                            retention_minutes: int = RETENTION_MINUTES, delay: str = WATERMARK) -> DataFrame:
    """(doc_id, template_id, template, n) of every message of a stream as it arrives.

    The leaf of the prefix tree (length and leading token) is the key of the state. A template keeps
    the id it was first given while its text grows more general; ``n`` counts its messages so far.
    """
    masked = mask_sql(message)
    rows = (
        stateful_session(messages).withWatermark(ts, delay)
        .where(F.col(message).isNotNull() & F.col(ts).isNotNull())
        .select(F.col(ts), F.unix_millis(ts).alias("ms"), F.col("doc_id").cast("string").alias("doc_id"),
                F.expr(masked).alias("masked"))
        .withColumn("id", F.expr(template_id_sql("masked")))
        .withColumn("leaf", F.concat_ws(" ", F.size(F.split("masked", " ")), F.substring_index("masked", " ", 1))))
    return rows.groupBy("leaf").transformWithStateInPandas(
        statefulProcessor=_Templates(retention_minutes * 60_000), outputMode="Append", timeMode="EventTime",
        outputStructType="doc_id string, template_id string, template string, n bigint")
