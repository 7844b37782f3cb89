"""Alerts and report records derived from the ``events`` table.

The test tables hold no alerts, so every event becomes one alert by fixed formulas. The flat form
is one SQL text that Spark and DuckDB both run; the nested form is what a parsed alert looks like.
"""

import os
import re

from pyspark.sql import DataFrame, SparkSession

from alertloom.schema import DATA, WIN_EVENT
from alertloom.session import shared_dir, spread, tune

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC, one alert per second from there

_NUMBERED = """
SELECT event_id AS i, user_id AS u, event_type AS t, value AS v,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_id % 13 AS f
FROM {events}
"""

_ADDRESSED = f"""
SELECT i, u, t, v, k, f,
  CAST(i AS VARCHAR(20)) AS id,
  {EPOCH} + i AS ts_s,
  CASE t WHEN 'error' THEN 12 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 6
         WHEN 'click' THEN 4 ELSE 1 END + k % 4 AS rule_level,
  CASE WHEN k < 50 THEN '10.0.' || CAST(u % 4 AS VARCHAR(9)) || '.'
       WHEN k < 80 THEN '185.220.101.' ELSE '203.0.113.' END
    || CAST(u % 250 + 1 AS VARCHAR(9)) AS ip,
  CASE WHEN i % 2 = 0 THEN '192.168.1.' ELSE '8.8.8.' END || CAST(k + 1 AS VARCHAR(9)) AS dstip,
  CASE WHEN f NOT IN (0, 1, 12) THEN 0
       WHEN k % 8 = 0 THEN 22 WHEN k % 8 = 1 THEN 443 WHEN k % 8 = 2 THEN 80
       WHEN k % 8 = 3 THEN 161 WHEN k % 8 = 4 THEN 3389 WHEN k % 8 = 5 THEN 445
       WHEN k % 8 = 6 THEN 53 ELSE 51000 END AS dstport,
  CASE WHEN f = 0 THEN CAST(round(v * 100) AS BIGINT) * 100 ELSE 0 END AS sentbyte,
  CASE WHEN f = 0 THEN k * 100 ELSE 0 END AS duration,
  CASE WHEN f <> 1 THEN NULL WHEN k % 4 = 0 THEN 'low' WHEN k % 4 = 1 THEN 'medium'
       WHEN k % 4 = 2 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN f NOT IN (0, 1, 12) THEN NULL WHEN k % 3 = 0 THEN 'allowed'
       WHEN k % 3 = 1 THEN 'dropped' ELSE 'blocked' END AS action,
  CASE WHEN f = 1 THEN 'ips' WHEN f = 0 THEN 'forward' END AS subtype,
  CASE WHEN f = 1 AND k % 3 = 0 THEN 'CVE-2021-44228' END AS attack,
  CASE WHEN f NOT IN (0, 1, 12) THEN NULL WHEN k % 4 = 0 THEN '6' WHEN k % 4 = 1 THEN '17'
       WHEN k % 4 = 2 THEN '1' ELSE 'tcp' END AS proto,
  CASE WHEN f = 10 THEN CASE WHEN k % 2 = 0 THEN '4624' ELSE '4625' END END AS win_code,
  CASE WHEN f = 10 THEN CASE WHEN k % 4 < 2 THEN '10' ELSE '3' END END AS logon_type,
  CASE WHEN f = 11 THEN CASE WHEN k % 3 = 0 THEN 'success' WHEN k % 3 = 1 THEN 'failure'
       ELSE 'other' END END AS outcome,
  'db-host' AS agent,
  CASE WHEN f IN (0, 1) THEN 'fortigate-firewall-v5' WHEN f IN (2, 3) THEN 'sshd'
       WHEN f = 4 THEN 'sudo' WHEN f = 5 THEN 'pam' WHEN f = 6 THEN 'kernel'
       WHEN f = 7 THEN 'nginx' WHEN f = 8 THEN 'dpkg' WHEN f = 9 THEN 'systemd'
       WHEN f = 10 THEN 'windows_eventchannel' WHEN f = 11 THEN 'openstack-keystone'
       ELSE 'json' END AS decoder,
  CASE WHEN f = 0 THEN 'fortigate,traffic' WHEN f = 1 THEN 'fortigate,ids'
       WHEN f = 2 THEN 'syslog,sshd,authentication_failed'
       WHEN f = 3 THEN 'syslog,sshd,authentication_success' WHEN f = 4 THEN 'syslog,sudo'
       WHEN f = 5 THEN 'pam,syslog'
       WHEN f = 6 THEN CASE WHEN k % 5 = 0 THEN 'firewall_drop' ELSE 'ufw' END
       WHEN f = 7 THEN CASE WHEN k % 10 = 0 THEN 'web,web_attack' ELSE 'web,accesslog' END
       WHEN f = 8 THEN 'dpkg,config_change' WHEN f = 9 THEN 'systemd'
       WHEN f = 10 THEN 'windows' WHEN f = 11 THEN 'openstack' ELSE 'json' END AS rule_groups,
  CASE WHEN f IN (2, 3, 4, 5, 7, 8, 9) THEN 'journald' ELSE '/var/log/app.log' END AS location
FROM numbered
"""

_LOGGED = """
SELECT addressed.*,
  CASE WHEN f IN (2, 3, 5, 6, 7) THEN NULL ELSE ip END AS srcip,
  CASE
    WHEN f = 2 THEN 'sshd: Failed password for root from ' || ip || ' port '
      || CAST(50000 + k AS VARCHAR(9)) || ' ssh2'
    WHEN f = 3 THEN 'sshd: Accepted publickey for dev from ' || ip || ' port 22 ssh2'
    WHEN f = 4 AND k % 2 = 0 THEN 'sudo: bob : command not allowed ; COMMAND=/bin/bash'
    WHEN f = 4 THEN 'sudo: bob : USER=root ; COMMAND=/usr/bin/passwd'
    WHEN f = 5 AND k % 2 = 0 THEN 'pam_unix(login:auth): authentication failure; rhost=' || ip
    WHEN f = 5 THEN 'pam_unix(login:session): session opened for user dev'
    WHEN f = 6 THEN '[UFW BLOCK] SRC=' || ip || ' DST=192.168.1.1 PROTO='
      || CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END || ' DPT=' || CAST(k * 11 AS VARCHAR(9))
    WHEN f = 7 THEN ip || ' - - "GET /index.php HTTP/1.1" '
      || CASE WHEN k % 3 = 0 THEN '200' WHEN k % 3 = 1 THEN '404' ELSE '500' END
      || ' 162 "-" "curl"'
    WHEN f = 8 THEN 'dpkg: status installed '
      || CASE WHEN k % 2 = 0 THEN 'nmap:amd64 7.93' ELSE 'jq:amd64 1.6' END
    WHEN f = 9 THEN CASE WHEN k % 2 = 0 THEN 'systemd: Failed to start unit'
      ELSE 'systemd: Started unit' END
    ELSE '' END AS full_log
FROM addressed
"""

# The JSON text of the alert, as the keyword filter and the file parser see it.
_RAW = """
SELECT logged.*,
  '{{"id": "' || id || '", "rule": {{"level": ' || CAST(rule_level AS VARCHAR(9))
  || ', "groups": ["' || replace(rule_groups, ',', '", "') || '"]}}, "agent": {{"name": "' || agent
  || '"}}, "decoder": {{"name": "' || decoder || '"}}, "location": "' || location
  || '", "full_log": "' || replace(full_log, '"', chr(92) || '"') || '", "data": {{"dstip": "'
  || dstip || '"'
  || CASE WHEN srcip IS NULL THEN '' ELSE ', "srcip": "' || srcip || '"' END
  || CASE WHEN f IN (0, 1, 12) THEN ', "dstport": ' || CAST(dstport AS VARCHAR(9))
     || ', "proto": "' || proto || '", "action": "' || action || '"' ELSE '' END
  || CASE WHEN f = 0 THEN ', "sentbyte": "' || CAST(sentbyte AS VARCHAR(20))
     || '", "duration": "' || CAST(duration AS VARCHAR(9)) || '"' ELSE '' END
  || CASE WHEN severity IS NULL THEN '' ELSE ', "severity": "' || severity || '"' END
  || CASE WHEN subtype IS NULL THEN '' ELSE ', "subtype": "' || subtype || '"' END
  || CASE WHEN attack IS NULL THEN '' ELSE ', "attack": "' || attack || '"' END
  || CASE WHEN outcome IS NULL THEN '' ELSE ', "outcome": "' || outcome || '"' END
  || '}}'
  || CASE WHEN win_code IS NULL THEN '' ELSE ', "win": {{"event": {{"code": "' || win_code
     || '", "LogonType": "' || logon_type || '"}}}}' END
  || '}}' AS raw
FROM logged
"""


def flat_ctes(events: str = "events") -> str:
    """The shared text: CTEs ending in ``alerts``, one flat row per event."""
    return (f"numbered AS ({_NUMBERED.format(events=events)}),\n"
            f"addressed AS ({_ADDRESSED}),\nlogged AS ({_LOGGED}),\n"
            f"alerts AS ({_RAW.format()})")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(tune(spark).read.parquet(f"{sf_dir}/events.parquet")
                  .select("event_id", "user_id", "event_type", "value", "props"))


def flat_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = "alertloom_events"
    events_table(spark, sf_dir).createOrReplaceTempView(view)
    flat = spark.sql(f"WITH {flat_ctes(view)} SELECT * FROM alerts")
    spark.catalog.dropTempView(view)
    return flat


def nested_alerts(flat: DataFrame) -> DataFrame:
    """Flat fixture rows as typed alerts (see ``schema.ALERT_COLUMNS``)."""
    given = {"srcip", "dstip", "dstport", "proto", "sentbyte", "duration", "severity", "action",
             "subtype", "attack", "outcome"}
    event = {"code": "win_code", "LogonType": "logon_type"}

    def struct(schema, value) -> str:
        return "named_struct(" + ", ".join(
            f"'{f.name}', cast({value(f.name)} AS STRING)" for f in schema) + ")"

    return flat.selectExpr(
        "id AS doc_id", "id",
        "date_format(to_utc_timestamp(timestamp_seconds(ts_s), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'\") AS timestamp",
        "timestamp_seconds(ts_s) AS event_ts",
        "named_struct('level', cast(rule_level AS STRING), 'id', cast(NULL AS STRING), "
        "'description', cast(NULL AS STRING), 'groups', split(rule_groups, ',')) AS rule",
        "named_struct('id', cast(NULL AS STRING), 'name', agent) AS agent",
        "named_struct('name', decoder) AS decoder",
        "location", "full_log",
        struct(DATA, lambda n: n if n in given else "NULL") + " AS data",
        f"named_struct('event', {struct(WIN_EVENT, lambda n: event.get(n, 'NULL'))}) AS win",
        "win_code IS NOT NULL AS has_win_event",
        "raw",
    )


def alerts_path(spark: SparkSession, sf_dir: str) -> str:
    name = re.sub(r"[^A-Za-z0-9]+", "-", os.path.abspath(sf_dir))
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/alerts{name}"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed alert table, written once per application and read from there.

    Alerts are a stored table in real use. Deriving them anew in every plan would also put the
    derivation formulas into every filter that Spark pushes down.
    """
    tune(spark)
    path = alerts_path(spark, sf_dir)
    if path not in _WRITTEN:
        nested_alerts(flat_alerts(spark, sf_dir)).write.mode("overwrite").parquet(path)
        _WRITTEN.add(path)
    return spark.read.parquet(path)


_WRITTEN: set[str] = set()

# Report records, also as shared SQL over ``numbered`` events.
FEEDBACK_SQL = """
SELECT CAST(i AS VARCHAR(20)) AS alert_id, CAST(k % 7 AS BIGINT) AS trust_score,
       k % 7 = 0 AS overridden, CAST(1000 + k * 500 AS BIGINT) AS decision_ms
FROM numbered
"""
LATENCY_SQL = """
SELECT CAST(i AS VARCHAR(20)) AS doc_id, v AS latency_ms,
       CAST(CASE WHEN k % 20 = 0 THEN 500 WHEN k % 3 = 0 THEN NULL ELSE 200 END AS INT)
         AS status_code,
       CASE WHEN k % 4 = 0 THEN NULL ELSE k % 20 <> 0 END AS ok
FROM numbered
"""
ROUNDS, ROUND_FEATURES = 10, 12


def _records(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    view = "alertloom_events"
    events_table(spark, sf_dir).createOrReplaceTempView(view)
    out = spark.sql(f"WITH numbered AS ({_NUMBERED.format(events=view)}) {text}")
    spark.catalog.dropTempView(view)
    return out


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, FEEDBACK_SQL)


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, LATENCY_SQL)


def rounds(scored: DataFrame, n_rounds: int = ROUNDS, n_features: int = ROUND_FEATURES) -> DataFrame:
    """Repeated scoring of every alert: rows of ``scored`` carry doc_id, weak_points, threshold."""
    number = "cast(doc_id AS BIGINT)"
    impact = (f"cast(({number} * 31 + j * 17 + round) % 201 - 100 AS DOUBLE) / 1000.0D")
    return (
        scored.selectExpr("doc_id", "weak_points", "threshold",
                          f"explode(sequence(1L, {n_rounds}L)) AS round")
        .selectExpr(
            "round", f"{number} AS i", "doc_id AS key", "200L AS http_status",
            f"(weak_points + if(({number} + 7 * round) % 11 = 0, 1, 0)) / 100.0D AS score",
            "threshold",
            f"transform(filter(sequence(0L, {n_features - 1}L), j -> ({number} + j * round) % 5 <> 0)"
            f", j -> named_struct('feature', concat('f', j), 'value', 1.0D, 'impact', {impact})) "
            "AS top_features")
        .selectExpr("round", "i", "key", "http_status", "score",
                    "if(score >= threshold, 'malicious', 'benign') AS label", "top_features",
                    "cast(NULL AS STRING) AS reason")
    )


def stand_in_attributions(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``phi``: a fixed formula in place of a model's attribution, one value per feature."""
    items = ", ".join(
        f"cast((cast(doc_id AS BIGINT) * 31 + {j * 17}) % 201 - 100 AS DOUBLE) / 1000.0D"
        for j in range(len(names)))
    return df.selectExpr("*", f"array({items}) AS phi")
