"""Struct types of the records that move through the engine."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RULE = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("groups", T.ArrayType(T.StringType())),
])
AGENT = _strings("id", "name")
DECODER = _strings("name")
DATA = _strings(
    "srcip", "src", "src_ip", "dstip", "dst", "srcport", "dstport", "dst_port",
    "proto", "proto_name", "sentbyte", "rcvdbyte", "duration", "severity", "apprisk",
    "action", "subtype", "attack", "service", "devid", "devname", "srcuser", "user",
    "outcome", "status", "remote_address", "bytes_sent", "bytes_received", "username",
)
WIN_EVENT = _strings(
    "code", "LogonType", "logon_type", "IpAddress", "IpPort", "TargetUserName", "AccountName",
)

# What a raw JSON alert is read with. Numbers are taken as text, so that 6 and "6" behave alike
# and 6.0 is not an integer. ``groups`` may be a list or a comma string, ``win.event`` may be an
# empty object: both are kept as text here and settled by ``sources.files.parse_alerts``.
RAW_ALERT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("@timestamp", T.StringType()),
    T.StructField("rule", _strings("level", "id", "description", "groups")),
    T.StructField("agent", AGENT),
    T.StructField("decoder", DECODER),
    T.StructField("location", T.StringType()),
    T.StructField("full_log", T.StringType()),
    T.StructField("data", DATA),
    T.StructField("win", _strings("event")),
    T.StructField("_os_index", T.StringType()),
    T.StructField("_os_doc_id", T.StringType()),
])

ALERT_COLUMNS = [
    "doc_id", "id", "timestamp", "event_ts", "rule", "agent", "decoder", "location", "full_log",
    "data", "win", "has_win_event", "raw",
]

TOP_FEATURE = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("impact", T.DoubleType()),
])

FEEDBACK = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("trust_score", T.LongType()),
    T.StructField("overridden", T.BooleanType()),
    T.StructField("decision_ms", T.LongType()),
])

CONSISTENCY = T.StructType([
    T.StructField("round", T.LongType()),
    T.StructField("i", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("http_status", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("top_features", T.ArrayType(TOP_FEATURE)),
    T.StructField("reason", T.StringType()),
])

# Canonical fields in the order they are produced.
CANONICAL_FIELDS = [
    "src_ip", "dst_ip", "src_port", "dst_port", "proto", "bytes_sent", "bytes_recv",
    "duration_sec", "rule_level", "severity_ord", "action", "threat_family", "service_label",
    "user", "host", "platform_source", "auth_result", "logon_type", "pf_win", "pf_lin", "pf_nw",
    "pf_osks", "bytes_total", "dst_svc_sensitive", "dst_svc_admin", "hour",
]
DERIVED_FIELDS = [
    "port_bucket_low", "port_bucket_mid", "port_bucket_high", "proto_tcp", "proto_udp",
    "proto_icmp", "service_snmp", "service_ssh", "service_rdp", "service_winrm", "service_smtp",
    "service_http", "service_https", "auth_result_pos", "auth_result_neg", "action_allowed",
    "action_blocked", "action_dropped", "src_is_private", "dst_is_private", "same_subnet_24",
    "dir_ingress", "dir_egress", "dir_internal",
]
