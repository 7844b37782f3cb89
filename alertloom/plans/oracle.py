"""The registered queries once more, as DuckDB SQL over the same tables.

Written from the rules, not from the Spark plans: addresses are compared as numbers, ranks come
from window functions over exploded rows, running sums from plain range windows.
"""

from alertloom import constants as K
from alertloom.sources import fixtures
from alertloom.sources.config import default_feature_map, default_policy
from alertloom.operators.features import feature_names
from alertloom.operators.dashboard import RAW_LINES, SUMMARY
from alertloom.operators.template_tree import PLACES, SIMILARITY

NAMES = feature_names(default_feature_map())
POLICY = default_policy()


def _words(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _among(column: str, words) -> str:
    return f"{column} IN (" + ", ".join(f"'{w}'" if isinstance(w, str) else str(w)
                                        for w in words) + ")"


def _overlap(words) -> str:
    return "list_has_any(grp, [" + ", ".join(f"'{w}'" for w in words) + "])"


def _b(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS BIGINT)"


_SIG = """
SELECT *, lower(decoder) AS dec, lower(agent) AS ag, lower(location) AS loc, lower(full_log) AS msg,
  string_split(lower(rule_groups), ',') AS grp,
  lower(decoder) || ' ' || replace(lower(rule_groups), ',', ' ') || ' ' || lower(agent) AS tags,
  strftime(make_timestamp(CAST(ts_s * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000+0000') AS ts_text
FROM alerts
"""

_DET = f"""
SELECT *,
  CASE
    WHEN {_words("tags || ' ' || loc", K.NETWORK_WORDS)} THEN
      CASE WHEN contains(tags || ' ' || loc, 'fortigate') THEN 'fortigate'
           WHEN {_words("tags || ' ' || loc", ("cisco", "asa"))} THEN 'cisco' ELSE 'unifi' END
    WHEN subtype = 'ips' THEN 'fortigate'
    WHEN contains(tags || ' ' || loc, 'windows') OR contains(dec, 'win') OR contains(ag, 'win')
      OR win_code IS NOT NULL THEN 'windows'
    WHEN {_words("tags || ' ' || loc", K.OPENSTACK_WORDS)} THEN 'openstack'
    WHEN {_among("dec", K.LINUX_DECODERS)} OR loc = 'journald'
      OR {_words("dec", K.LINUX_DECODER_WORDS)} OR {_words("tags || ' ' || loc", K.LINUX_WORDS)}
      OR contains(tags || ' ' || loc, 'linux') THEN 'linux'
    ELSE 'generic' END AS source,
  CASE
    WHEN {_words("tags", K.NETWORK_WORDS)} THEN 'network'
    WHEN contains(tags, 'windows') OR contains(dec, 'win') OR contains(ag, 'win')
      OR win_code IS NOT NULL THEN 'endpoint'
    WHEN contains(tags, 'linux') THEN 'endpoint'
    WHEN {_words("tags", K.OPENSTACK_WORDS)} THEN 'server'
    WHEN subtype = 'ips' THEN 'network'
    ELSE 'server' END AS policy_source
FROM sig
"""

_READ = f"""
SELECT *,
  CASE WHEN source IN ('fortigate', 'cisco', 'unifi') THEN 'network' ELSE source END AS platform,
  CASE WHEN {_words("msg", K.AUTH_OK_PHRASES)} THEN 1 WHEN {_words("msg", K.AUTH_FAIL_PHRASES)} THEN 0
       ELSE -1 END AS lauth,
  CASE WHEN contains(msg, 'sshd') OR dec = 'sshd' THEN 'ssh'
       WHEN contains(msg, 'sudo') OR dec = 'sudo' THEN 'sudo'
       WHEN contains(msg, 'pam_unix') OR starts_with(dec, 'pam') THEN 'pam'
       WHEN contains(msg, 'ufw') OR contains(msg, 'iptables')
         OR (contains(dec, 'kernel') AND contains(msg, 'block')) THEN 'fw'
       WHEN contains(msg, 'nginx') OR contains(msg, 'apache') OR dec IN ('nginx', 'apache') THEN 'web'
       WHEN contains(msg, 'dpkg') OR dec = 'dpkg' THEN 'pkg'
       WHEN contains(msg, 'systemd') OR dec = 'systemd' THEN 'svc' ELSE 'none' END AS cat,
  CASE WHEN severity = 'critical' THEN 3 WHEN severity = 'high' THEN 2 WHEN severity = 'medium' THEN 1
       WHEN severity IS NOT NULL THEN 0 WHEN rule_level >= 12 THEN 3 WHEN rule_level >= 9 THEN 2
       WHEN rule_level >= 6 THEN 1 ELSE 0 END AS rated,
  CASE WHEN rule_level >= 12 OR {_overlap(K.SYSLOG_CRITICAL_GROUPS)} THEN 3
       WHEN rule_level >= 8 OR {_overlap(K.SYSLOG_HIGH_GROUPS)} THEN 2
       WHEN rule_level >= 6 OR {_overlap(K.SYSLOG_MEDIUM_GROUPS)} THEN 1 ELSE 0 END AS lsev,
  CASE WHEN regexp_extract(full_log, '" ([0-9]{{3}}) ', 1) = '' THEN NULL
       ELSE CAST(regexp_extract(full_log, '" ([0-9]{{3}}) ', 1) AS INT) END AS http,
  CASE WHEN regexp_extract(msg, 'dpt[=:]([0-9]+)', 1) = '' THEN CAST(dstport AS BIGINT)
       ELSE CAST(regexp_extract(msg, 'dpt[=:]([0-9]+)', 1) AS BIGINT) END AS fwport
FROM det
"""


def _service(port: str) -> str:
    return (f"CASE {port} WHEN 22 THEN 'SSH' WHEN 3389 THEN 'RDP' WHEN 5985 THEN 'WINRM' "
            f"WHEN 5986 THEN 'WINRM' WHEN 161 THEN 'SNMP' WHEN 80 THEN 'HTTP' "
            f"WHEN 443 THEN 'HTTPS' WHEN 53 THEN 'DNS' WHEN 25 THEN 'SMTP' ELSE 'NA' END")


def _by(network: str, windows: str, linux: str, openstack: str, generic: str) -> str:
    return (f"CASE platform WHEN 'network' THEN {network} WHEN 'windows' THEN {windows} "
            f"WHEN 'linux' THEN {linux} WHEN 'openstack' THEN {openstack} ELSE {generic} END")


_ALLOW_BLOCK = "CASE lauth WHEN 1 THEN 'allowed' WHEN 0 THEN 'blocked' ELSE 'na' END"
_LACTION = (
    f"CASE cat WHEN 'ssh' THEN {_ALLOW_BLOCK} WHEN 'pam' THEN {_ALLOW_BLOCK} "
    "WHEN 'sudo' THEN CASE WHEN contains(msg, 'command not allowed') "
    "OR contains(msg, 'not in sudoers') THEN 'blocked' ELSE 'allowed' END "
    "WHEN 'fw' THEN CASE WHEN contains(msg, 'block') OR contains(msg, 'drop') THEN 'blocked' "
    "ELSE 'allowed' END "
    "WHEN 'web' THEN CASE WHEN http IS NULL THEN 'na' WHEN http >= 400 THEN 'blocked' "
    "ELSE 'allowed' END WHEN 'pkg' THEN 'allowed' "
    f"WHEN 'svc' THEN CASE WHEN {_words('msg', K.SYSTEMD_FAIL_WORDS)} THEN 'blocked' "
    "ELSE 'allowed' END ELSE 'na' END"
)
_LPORT = ("CASE cat WHEN 'ssh' THEN CASE WHEN dstport = 0 THEN 22 ELSE dstport END "
          "WHEN 'web' THEN CASE WHEN dstport = 0 THEN 80 ELSE dstport END "
          "WHEN 'fw' THEN fwport ELSE dstport END")
_RDP = "coalesce(logon_type, '') IN ('10', '7')"

_CANON = f"""
SELECT id, i, ts_s, ts_text, agent, decoder, location, rule_groups, full_log, source, policy_source,
  platform AS platform_source, rule_level AS raw_level, severity, action AS raw_action,
  srcip AS raw_src, dstip AS raw_dst, dstport AS raw_port, subtype, proto AS raw_proto,
  {_by("srcip", "''",
       "CASE WHEN coalesce(srcip, '') <> '' THEN srcip ELSE regexp_extract(msg, 'from +([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)', 1) END",
       "''", "coalesce(srcip, '')")} AS src_ip,
  {_by("dstip", "''", "dstip", "''", "dstip")} AS dst_ip,
  CAST(0 AS BIGINT) AS src_port,
  CAST({_by("dstport", f"CASE WHEN {_RDP} THEN 3389 ELSE 0 END", _LPORT, "0", "dstport")} AS BIGINT)
    AS dst_port,
  {_by("coalesce(proto, 'na')", "'tcp'",
       "CASE WHEN cat = 'fw' AND contains(msg, 'udp') THEN 'udp' ELSE 'tcp' END", "'tcp'",
       "coalesce(proto, 'na')")} AS proto,
  CAST({_by("sentbyte", "0", "0", "0", "sentbyte")} AS BIGINT) AS bytes_sent,
  CAST(0 AS BIGINT) AS bytes_recv,
  CAST({_by("duration", "0", "0", "duration", "duration")} AS BIGINT) AS duration_sec,
  CAST(rule_level AS BIGINT) AS rule_level,
  CAST({_by("rated", "0", "lsev", "0", "rated")} AS BIGINT) AS severity_ord,
  {_by("coalesce(action, '')", "'na'", _LACTION, "'na'", "coalesce(action, 'na')")} AS action,
  {_by("coalesce(subtype, 'na')", "'auth'",
       "CASE cat WHEN 'ssh' THEN 'auth' WHEN 'pam' THEN 'auth' WHEN 'sudo' THEN 'privilege_escalation' "
       "WHEN 'fw' THEN 'firewall' WHEN 'web' THEN 'web' WHEN 'pkg' THEN 'package_install' "
       "WHEN 'svc' THEN 'service_event' ELSE 'na' END",
       "CASE WHEN outcome IN ('success', 'failure') THEN 'auth' ELSE 'na' END",
       "coalesce(subtype, 'na')")} AS threat_family,
  {_by(_service("dstport"), f"CASE WHEN {_RDP} THEN 'RDP' ELSE 'NA' END",
       f"CASE cat WHEN 'ssh' THEN 'SSH' WHEN 'web' THEN 'HTTP' WHEN 'fw' THEN {_service('fwport')} "
       "ELSE 'NA' END", "'API'", _service("dstport"))} AS service_label,
  '' AS "user",
  {_by("agent", "agent", "agent", "'openstack'", "agent")} AS host,
  CAST({_by("-1", "CASE win_code WHEN '4624' THEN 1 WHEN '4625' THEN 0 ELSE -1 END", "lauth",
            "CASE outcome WHEN 'success' THEN 1 WHEN 'failure' THEN 0 ELSE -1 END", "-1")} AS BIGINT)
    AS auth_result,
  {_by("'na'", "coalesce(logon_type, 'na')", "'na'", "'api'", "'na'")} AS logon_type
FROM reading
"""


def _private(ip: str) -> str:
    a, b, c, d = (f"TRY_CAST(split_part({ip}, '.', {n}) AS INT)" for n in (1, 2, 3, 4))
    return (
        f"(regexp_full_match({ip}, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AND ("
        f"{a} IN (0, 10, 127) OR {a} >= 240 OR ({a} = 169 AND {b} = 254) "
        f"OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) "
        f"OR ({a} = 192 AND {b} = 0 AND {c} = 2) "
        f"OR ({a} = 192 AND {b} = 0 AND {c} = 0 AND {d} NOT IN (9, 10)) "
        f"OR ({a} = 198 AND {b} IN (18, 19)) OR ({a} = 198 AND {b} = 51 AND {c} = 100) "
        f"OR ({a} = 203 AND {b} = 0 AND {c} = 113)))")


def _first_three(ip: str) -> str:
    return f"regexp_extract({ip}, '^([^.]*[.][^.]*[.][^.]*)[.][^.]*$', 1)"


_FLAGS = {
    "pf_win": "source = 'windows'", "pf_lin": "source = 'linux'",
    "pf_nw": "platform_source = 'network'", "pf_osks": "source = 'openstack'",
    "dst_svc_sensitive": _among("dst_port", K.SENSITIVE_PORTS),
    "dst_svc_admin": _among("service_label", K.ADMIN_SERVICES),
    "port_bucket_low": "dst_port BETWEEN 1 AND 1024",
    "port_bucket_mid": "dst_port BETWEEN 1025 AND 49151", "port_bucket_high": "dst_port >= 49152",
    "proto_tcp": "proto IN ('6', 'tcp')", "proto_udp": "proto IN ('17', 'udp')",
    "proto_icmp": "proto IN ('1', 'icmp')",
    **{f"service_{s.lower()}": f"service_label = '{s}'"
       for s in ("SNMP", "SSH", "RDP", "WINRM", "SMTP", "HTTP", "HTTPS")},
    "auth_result_pos": "auth_result = 1", "auth_result_neg": "auth_result = 0",
    "action_allowed": _among("action", K.ALLOWED_ACTIONS),
    "action_blocked": _among("action", K.BLOCKED_ACTIONS),
    "action_dropped": _among("action", K.DROPPED_ACTIONS),
    "src_is_private": _private("src_ip"), "dst_is_private": _private("dst_ip"),
    "same_subnet_24": f"{_first_three('src_ip')} <> '' "
                      f"AND {_first_three('src_ip')} = {_first_three('dst_ip')}",
}
_DERIVED = f"""
SELECT *, {", ".join(f"{_b(cond)} AS {name}" for name, cond in _FLAGS.items())},
  bytes_sent + bytes_recv AS bytes_total, CAST(0 AS BIGINT) AS hour FROM canon
"""
_FLOW = f"{_among('action', K.FLOW_ACTIONS)} AND pf_nw = 1"
_DIRECTED = f"""
SELECT *, {_b(f"{_FLOW} AND dst_is_private = 1")} AS dir_ingress,
  {_b(f"{_FLOW} AND src_is_private = 1 AND dst_is_private = 0")} AS dir_egress,
  {_b("src_is_private = 1 AND dst_is_private = 1")} AS dir_internal FROM derived
"""

_TEXTS = "msg"
_GROUP_HITS = "least(len(list_intersect(list_distinct(grp), [{0}])), 2)"


def _hits(words) -> str:
    return _GROUP_HITS.format(", ".join(f"'{w}'" for w in words))


_WEAK = f"""
SELECT id, i, t, policy_source, ts_text, CAST(least(100,
    CASE WHEN rule_level >= 15 THEN 60 WHEN rule_level >= 12 THEN 45 WHEN rule_level >= 10 THEN 30
         WHEN rule_level >= 8 THEN 20 WHEN rule_level >= 6 THEN 10 WHEN rule_level >= 4 THEN 4
         ELSE 0 END
  + 30 * {_hits(K.RISK_CRITICAL_GROUPS)} + 10 * {_hits(K.RISK_MEDIUM_GROUPS)}
  + CASE WHEN {_words(_TEXTS, K.RISK_CRITICAL_WORDS)} THEN 20 ELSE 0 END
  + CASE WHEN {_words(_TEXTS, K.RISK_MEDIUM_WORDS)} THEN 8 ELSE 0 END
  + CASE severity WHEN 'critical' THEN 35 WHEN 'high' THEN 25 WHEN 'medium' THEN 10 ELSE 0 END
  + CASE WHEN {_words(_TEXTS, K.RISK_TOOL_WORDS)}
      OR {_words("lower(coalesce(attack, ''))", K.RISK_TOOL_WORDS)} THEN 25 ELSE 0 END
  + CASE WHEN {_among("dstport", K.RISK_PORTS)} THEN 12 ELSE 0 END
  + CASE WHEN {_among("dstport", K.RISK_PORTS)}
      AND NOT {_among("coalesce(action, '')", K.RISK_STOPPED_ACTIONS)} THEN 10 ELSE 0 END
  + CASE WHEN sentbyte > 5000000 THEN 25 WHEN sentbyte > 1000000 THEN 10 ELSE 0 END
  + CASE WHEN duration > 7200 THEN 20 WHEN duration > 1800 THEN 10 ELSE 0 END
  + CASE WHEN subtype = 'malware' THEN 30 WHEN subtype IN ('ips', 'ids') THEN 10 ELSE 0 END
  ) AS BIGINT) AS points
FROM reading
"""

_THRESHOLD = ("CAST(CASE policy_source WHEN 'network' THEN 0.65 WHEN 'endpoint' THEN 0.6 "
              "WHEN 'server' THEN 0.7 ELSE 0.5 END AS DOUBLE)")


def _band(field: str, default: str) -> str:
    whens = []
    for source, spec in POLICY["sources"].items():
        for band in sorted(spec["bands"], key=lambda b: -b["min"]):
            whens.append(f"WHEN policy_source = '{source}' AND points >= {round(band['min'] * 100)} "
                         f"THEN '{band[field]}'")
    return f"CASE {' '.join(whens)} ELSE '{default}' END"


_POL = f"""
SELECT w.id, w.i, w.t, w.ts_text, w.policy_source, w.points, CAST(w.points AS DOUBLE) / 100 AS score,
  {_THRESHOLD.replace("policy_source", "w.policy_source")} AS threshold,
  {_band("tag", "LOW").replace("policy_source", "w.policy_source")} AS band_tag,
  {_band("action", "Queue").replace("policy_source", "w.policy_source")} AS policy_action,
  {_band("recommend", "Monitor traffic").replace("policy_source", "w.policy_source")}
    AS recommendation,
  d.* EXCLUDE (id, i, ts_text, policy_source)
FROM weak w JOIN directed d ON w.id = d.id
"""
_TAGGED = """
SELECT *,
  CASE WHEN service_snmp = 1 AND action = 'dropped' AND severity_ord <= 1 THEN 'LOW'
       WHEN pf_osks = 1 AND severity_ord >= 2 THEN 'HIGH'
       WHEN dst_svc_sensitive = 1 AND action = 'allowed' THEN 'HIGH' ELSE band_tag END AS tag,
  CASE WHEN pf_osks = 1 AND severity_ord > 2 THEN 'HIGH' ELSE band_tag END AS tag_observed,
  CASE WHEN score >= threshold THEN 'malicious' ELSE 'benign' END AS label
FROM pol
"""

_CONSTANT = {"service_dns", "logon_type_rdp", "src_private", "dst_private", "geo_src_risk",
             "geo_dst_risk", "geo_distance_km", "asn_rep_src", "asn_rep_dst", "tls_version_ord",
             "tls_cipher_weak", "ssh_kex_weak", "ipsec_encr_weak", "ipsec_auth_weak", "hour",
             "auth_fail_5m", "auth_fail_1h", "conn_count_5m"}


def _value(name: str) -> str:
    return "CAST(0 AS DOUBLE)" if name in _CONSTANT else f"CAST({name} AS DOUBLE)"


_ATTR = f"""
SELECT id, e.feature AS feature, e.value AS value,
  CAST((i * 31 + e.j * 17) % 201 - 100 AS DOUBLE) / 1000 AS impact
FROM (SELECT id, i, unnest([{", ".join(
    f"{{'feature': '{n}', 'j': {j}, 'value': {_value(n)}}}" for j, n in enumerate(NAMES))}]) AS e
  FROM directed)
WHERE e.value <> 0
"""
_TOP = """
SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(impact) DESC, feature) AS rn FROM attr
"""
_DOCS = """
SELECT x.id AS doc_id, any_value(n.n) AS n_features,
  string_agg(feature, ', ' ORDER BY rn) FILTER (WHERE rn <= 12) AS names,
  string_agg(feature || '=' || printf('%.3f', impact), ';' ORDER BY rn) FILTER (WHERE rn <= 12) AS top
FROM topf x JOIN (SELECT id, count(*) AS n FROM attr GROUP BY id) n ON x.id = n.id GROUP BY x.id
"""
_FULLDOC = """
SELECT t.*, d.n_features, d.top, coalesce('Top impact: ' || d.names, 'Model score only') AS reason
FROM tagged t LEFT JOIN docs d ON t.id = d.doc_id
"""

_ROUNDS = """
SELECT p.id AS key, p.i, r.round, (p.points + CASE WHEN (p.i + 7 * r.round) % 11 = 0 THEN 1 ELSE 0 END)
  / CAST(100 AS DOUBLE) AS score, p.threshold
FROM pol p CROSS JOIN (SELECT unnest(range(1, 11)) AS round) r
"""
_LABELLED = """
SELECT *, CASE WHEN score >= threshold THEN 'malicious' ELSE 'benign' END AS label FROM rounds
"""
_RF = """
SELECT key, round, j, CAST((i * 31 + j * 17 + round) % 201 - 100 AS DOUBLE) / 1000 AS impact
FROM rounds CROSS JOIN (SELECT unnest(range(0, 12)) AS j) f WHERE (i + j * round) % 5 <> 0
"""
_FLIPS = """
SELECT key, string_agg(DISTINCT label, ',' ORDER BY label) AS label_set,
  count(*) FILTER (WHERE prev IS NOT NULL AND prev <> label) / CAST(count(*) - 1 AS DOUBLE)
    AS label_flip_rate
FROM (SELECT *, lag(label) OVER (PARTITION BY key ORDER BY round) AS prev FROM labelled) GROUP BY key
"""
_SPREAD = """
SELECT key, stddev_samp(score) AS score_std, max(score) - min(score) AS score_max_delta
FROM labelled GROUP BY key
"""
_JAC = """
SELECT key, avg(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0
                ELSE both_n / CAST(a + b - both_n AS DOUBLE) END) AS jaccard
FROM (SELECT r.key, r.round,
        (SELECT 1) AS one,
        coalesce(any_value(c1.n), 0) AS a, coalesce(any_value(c.n), 0) AS b,
        coalesce(any_value(s.n), 0) AS both_n
      FROM (SELECT DISTINCT key, round FROM rounds WHERE round > 1) r
      LEFT JOIN (SELECT key, count(*) AS n FROM rf WHERE round = 1 GROUP BY key) c1 ON c1.key = r.key
      LEFT JOIN (SELECT key, round, count(*) AS n FROM rf GROUP BY key, round) c
        ON c.key = r.key AND c.round = r.round
      LEFT JOIN (SELECT x.key, x.round, count(*) AS n FROM rf x
                 JOIN rf y ON x.key = y.key AND x.j = y.j AND y.round = 1 GROUP BY x.key, x.round) s
        ON s.key = r.key AND s.round = r.round
      GROUP BY r.key, r.round)
GROUP BY key
"""
_GAPS = """
, gap AS (SELECT * FROM labelled WHERE NOT (i % 3 = 0 AND round = 1)),
many AS (SELECT key, round, i, score, label, i AS seq FROM gap
  UNION ALL SELECT key, round, i, score, label, i + 1000000000 FROM gap WHERE i % 5 = 0),
placed AS (SELECT *, row_number() OVER w AS pos, lag(label) OVER w AS prev,
    list_filter(range(0, 12), lambda j: (i + j * round) % 5 <> 0) AS fs
  FROM many WINDOW w AS (PARTITION BY key ORDER BY round, seq)),
firsts AS (SELECT key, fs AS f1 FROM placed WHERE pos = 1)
SELECT key, max(round) AS rounds, array_to_string(list_sort(list(DISTINCT label)), ',') AS label_set,
  count(*) FILTER (WHERE pos > 1 AND label <> prev) / CAST(count(*) - 1 AS DOUBLE) AS label_flip_rate,
  round(stddev_samp(score), 9) AS score_std, round(max(score) - min(score), 9) AS score_max_delta,
  round(avg(CASE WHEN pos > 1 THEN CASE WHEN len(fs) = 0 AND len(f1) = 0 THEN 1.0
    ELSE len(list_intersect(fs, f1))
         / CAST(len(list_distinct(list_concat(fs, f1))) AS DOUBLE) END END), 9)
    AS topfeat_jaccard_mean_vs_r1
FROM placed JOIN firsts USING (key) GROUP BY key
"""
_SHARED = """
SELECT x.key, x.round, x.impact AS b, y.impact AS a,
  rank() OVER (PARTITION BY x.key, x.round ORDER BY x.impact)
    + (count(*) OVER (PARTITION BY x.key, x.round, x.impact) - 1) / CAST(2 AS DOUBLE) AS rb,
  rank() OVER (PARTITION BY x.key, x.round ORDER BY y.impact)
    + (count(*) OVER (PARTITION BY x.key, x.round, y.impact) - 1) / CAST(2 AS DOUBLE) AS ra
FROM rf x JOIN rf y ON x.key = y.key AND x.j = y.j AND y.round = 1 WHERE x.round > 1
"""
_RHO = """
SELECT key, avg(rho) AS rho FROM (
  SELECT key, round, corr(ra, rb) AS rho FROM shared GROUP BY key, round
  HAVING count(*) >= 2 AND count(DISTINCT ra) > 1 AND count(DISTINCT rb) > 1) GROUP BY key
"""

_CTES = {
    "sig": _SIG, "det": _DET, "reading": _READ, "canon": _CANON, "derived": _DERIVED,
    "directed": _DIRECTED, "weak": _WEAK, "pol": _POL, "tagged": _TAGGED, "attr": _ATTR,
    "topf": _TOP, "docs": _DOCS, "fulldoc": _FULLDOC, "rounds": _ROUNDS, "labelled": _LABELLED,
    "rf": _RF, "flips": _FLIPS, "spread": _SPREAD, "jac": _JAC, "shared": _SHARED, "rho": _RHO,
    "feedback": fixtures.FEEDBACK_SQL, "latency": fixtures.LATENCY_SQL,
}


def _sql(select: str, upto: str) -> str:
    """The fixture CTEs, the chain up to ``upto`` and the final select."""
    names = list(_CTES)
    if upto in ("feedback", "latency"):
        chain = [upto]
    else:
        chain = names[:names.index(upto) + 1] if upto else []
    parts = [fixtures.flat_ctes("events")] + [f"{n} AS ({_CTES[n]})" for n in chain]
    return "WITH " + ",\n".join(parts) + "\n" + select


def _mapped(platform: str) -> str:
    return _sql(
        "SELECT id AS doc_id, src_ip, dst_ip, src_port, dst_port, proto, bytes_sent, bytes_recv, "
        "duration_sec, rule_level, severity_ord, action, threat_family, service_label, \"user\", "
        f"host, auth_result, logon_type FROM canon WHERE platform_source = '{platform}'", "canon")


_NEWEST = "SELECT * FROM fulldoc ORDER BY ts_text DESC, id LIMIT 200"
_ONE = "SELECT * FROM fulldoc ORDER BY ts_text DESC, id LIMIT 1"

# Display fields of the fixture alerts; everything else the views ask for is empty there.
_SHOWN = {
    "alert.rule.description": "NULL", "alert.agent.name": "agent", "alert.decoder.name": "decoder",
    "alert.location": "location", "alert.rule.id": "NULL",
    "alert.rule.level": "CAST(raw_level AS VARCHAR)", "alert.data.srcip": "raw_src",
    "alert.data.dstip": "raw_dst", "alert.data.service": "NULL",
    "alert.data.dstport": "CAST(raw_port AS VARCHAR)", "alert.data.action": "raw_action",
    "alert.data.severity": "severity", "alert.agent.id": "NULL", "alert.data.subtype": "subtype",
    "alert.data.proto": "raw_proto", "doc_id": "id", "timestamp": "ts_text", "reason": "reason",
    "recommendation": "recommendation",
}


def _list_rows(items: list[str], fields: str) -> str:
    return (f"SELECT id AS doc_id, CAST(row_number() OVER (ORDER BY e.p) AS BIGINT) AS {fields} "
            f"FROM (SELECT id, unnest([{', '.join(items)}]) AS e FROM ({_ONE}))")


def _summary() -> str:
    items = [f"{{'p': {p}, 'label': '{label}', 'val': {_SHOWN[field]}}}"
             for p, (label, field) in enumerate(SUMMARY)]
    return _list_rows(items, "rownum, e.label AS label, e.val AS val") + (
        " WHERE e.val IS NOT NULL AND e.val <> '' AND e.val <> '—'")


def _raw() -> str:
    lines = []
    for label, field in RAW_LINES:
        if field is None:
            lines.append(f"'{label}'")
        elif field.startswith("format_string"):
            lines.append(f"'{label}' || printf('%.4f', score)")
        elif field.startswith("coalesce"):
            lines.append(f"'{label}' || label")
        else:
            lines.append(f"'{label}' || coalesce({_SHOWN[field]}, '—')")
    lines += [f"substr(full_log, {72 * n + 1}, 72)" for n in range(4)]
    items = [f"{{'p': {p}, 'line': {line}}}" for p, line in enumerate(lines)]
    return _list_rows(items, "row, e.line AS line") + " WHERE e.line <> ''"


def _quantile(fraction: float, column: str) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {fraction})"


_MASKED = """
messages AS (SELECT full_log AS message FROM alerts UNION ALL SELECT text FROM conversations),
masked AS (
  SELECT template, count(*) AS n FROM (
    SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
      '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+', '<IP>', 'g'), '0x[0-9a-fA-F]+', '<HEX>', 'g'),
      '[0-9]+', '<NUM>', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS template
    FROM messages WHERE message IS NOT NULL) GROUP BY template),
templates AS (
  SELECT template, n, string_split(template, ' ') AS toks, len(string_split(template, ' ')) AS tokens,
         substr(md5(template), 1, 16) AS template_id FROM masked)
"""
_MERGED = """
, keyed AS (
  SELECT template_id, tokens, pos,
    array_to_string(toks[1:pos], chr(1)) || chr(2) || array_to_string(toks[pos + 2:], chr(1)) AS k
  FROM (SELECT *, unnest(range(0, tokens)) AS pos FROM templates)),
families AS (SELECT tokens, pos, k, count(*) AS members FROM keyed GROUP BY ALL HAVING count(*) > 1),
best AS (
  SELECT template_id, pos FROM (
    SELECT y.template_id, y.pos, row_number() OVER (PARTITION BY y.template_id
      ORDER BY f.members DESC, y.pos) AS rn
    FROM keyed y JOIN families f ON y.tokens = f.tokens AND y.pos = f.pos AND y.k = f.k) WHERE rn = 1),
merged AS (
  SELECT t.n, CASE WHEN b.pos IS NULL OR t.tokens < 2 THEN t.template
    ELSE array_to_string(list_concat(list_concat(t.toks[1:b.pos], ['<*>']), t.toks[b.pos + 2:]), ' ')
    END AS template
  FROM templates t LEFT JOIN best b ON t.template_id = b.template_id)
"""


def _mined(select: str) -> str:
    """Templates merged round by round: r<k> holds (template, n), c<k> what round k changes."""
    parts = [_MASKED.replace(
        "messages AS (SELECT full_log AS message FROM alerts UNION ALL SELECT text FROM conversations)",
        "messages AS (SELECT 'alert' AS origin, id AS key, full_log AS message FROM alerts UNION ALL "
        "SELECT 'conversation', conv_id || ':' || turn, text FROM conversations UNION ALL "
        "SELECT 'document', CAST(doc_id AS VARCHAR), text FROM documents)").strip(),
        "r0 AS (SELECT template, n FROM masked)",
        "l0 AS (SELECT template AS first, template AS now FROM masked)"]
    for k, places in enumerate(PLACES):
        a, b = (f"w[{p + 1 if p >= 0 else p}]" for p in places)
        parts.append(f"""
e{k} AS (SELECT *, {a} AS a, {b} AS b, len(w) AS l FROM (
  SELECT template, n, string_split(template, ' ') AS w FROM r{k}) WHERE len(w) > 1),
h{k} AS (SELECT l, a, b, template AS head, w AS hw FROM e{k} QUALIFY
  row_number() OVER (PARTITION BY l, a, b ORDER BY n DESC, template) = 1
  AND count(*) OVER (PARTITION BY l, a, b) > 1),
d{k} AS (SELECT * FROM (
  SELECT e.template, h.head, h.hw, e.l,
         list_filter(range(e.l), lambda i: e.w[i + 1] <> h.hw[i + 1]) AS odd
  FROM e{k} e JOIN h{k} h USING (l, a, b)) WHERE 100 * (l - len(odd)) >= {SIMILARITY} * l),
v{k} AS (SELECT head, list(DISTINCT i) AS v FROM (SELECT head, unnest(odd) AS i FROM d{k}) GROUP BY head),
c{k} AS (SELECT template, array_to_string(list_transform(range(l),
    lambda i: CASE WHEN list_contains(v, i) THEN '<*>' ELSE hw[i + 1] END), ' ') AS merged
  FROM d{k} JOIN v{k} USING (head)),
r{k + 1} AS (SELECT coalesce(merged, template) AS template, sum(n) AS n
  FROM r{k} LEFT JOIN c{k} USING (template) GROUP BY 1),
l{k + 1} AS (SELECT first, coalesce(merged, now) AS now FROM l{k} LEFT JOIN c{k} ON now = c{k}.template)""")
    return _sql(", " + ",\n".join(parts) + "\n" + select.format(last=f"l{len(PLACES)}"), "")


def oracle() -> dict[str, str]:
    at = fixtures.EPOCH
    out = {
        "source_detect": _sql("SELECT source, decoder, count(*) AS n FROM det GROUP BY ALL", "det"),
        "policy_source": _sql("SELECT policy_source, decoder, count(*) AS n FROM det GROUP BY ALL",
                              "det"),
        **{f"canonical_{p}": _mapped(p)
           for p in ("network", "windows", "linux", "openstack", "generic")},
        "canonical_summary": _sql(
            "SELECT source, platform_source, count(*) AS n, avg(severity_ord) AS severity_mean, "
            + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in (
                "pf_win", "pf_lin", "pf_nw", "pf_osks", "bytes_total", "dst_svc_sensitive",
                "dst_svc_admin", "hour")) + " FROM directed GROUP BY ALL", "directed"),
        "derived_flags": _sql(
            "SELECT id AS doc_id, " + ", ".join(
                [n for n in _FLAGS if n not in ("pf_win", "pf_lin", "pf_nw", "pf_osks",
                                                "dst_svc_sensitive", "dst_svc_admin")]
                + ["dir_ingress", "dir_egress", "dir_internal"]) + " FROM directed", "directed"),
        "service_norm": _sql("SELECT dst_port, service_label, count(*) AS n FROM canon GROUP BY ALL",
                             "canon"),
        "severity_ord": _sql("SELECT platform_source, rule_level, severity_ord, count(*) AS n "
                             "FROM canon GROUP BY ALL", "canon"),
        "feature_vector": _sql("SELECT id AS doc_id, " + ", ".join(
            f"{_value(n)} AS {n}" for n in NAMES) + " FROM directed", "directed"),
        "compact_vector": _sql("SELECT id AS doc_id, " + ", ".join(
            f"CAST({n} AS DOUBLE) AS {n}" for n in K.COMPACT_FEATURES) + " FROM directed",
            "directed"),
        "nonzero_features": _sql("SELECT id AS doc_id, feature, value FROM attr", "attr"),
        "min_level_keyword": _sql(
            "SELECT id AS doc_id, CAST(rule_level AS BIGINT) AS rule_level FROM alerts "
            "WHERE rule_level >= 6 AND contains(lower(raw), 'failed')", ""),
        "time_window_scan": _sql(
            f"SELECT id AS doc_id FROM alerts WHERE ts_s >= {at + 600} AND ts_s < {at + 86400} "
            "AND rule_level >= 6", ""),
        "scan_counters": _sql(
            f"SELECT count(*) AS total, count(*) FILTER (WHERE ts_s >= {at + 600} AND ts_s < "
            f"{at + 86400} AND rule_level >= 6) AS matched, count(*) FILTER (WHERE ts_s IS NULL) "
            f"AS skipped_ts, count(*) FILTER (WHERE ts_s >= {at + 600} AND ts_s < {at + 86400} "
            "AND rule_level < 6) AS skipped_level FROM alerts", ""),
        "incremental_page": _sql(
            f"SELECT id AS doc_id FROM alerts WHERE ts_s > {at + 1234} AND rule_level >= 4 "
            "ORDER BY ts_s, id LIMIT 100", ""),
        "cursor_pages": _sql(
            "SELECT id AS doc_id, (row_number() OVER own - 1) // 100 AS page, (row_number() OVER own - 1) % 100 "
            f"AS place FROM alerts WHERE ts_s >= {at + 1234} AND rule_level >= 4 "
            "WINDOW own AS (ORDER BY ts_s, id)", ""),
        "backfill_last_n": _sql(
            "SELECT id AS doc_id FROM (SELECT * FROM alerts ORDER BY ts_s DESC, id DESC LIMIT 500) "
            "WHERE rule_level >= 6", ""),
        "weak_score": _sql("SELECT id AS doc_id, points AS weak_points, CAST(points AS DOUBLE) / 100 "
                           "AS weak_score FROM weak", "weak"),
        "weak_label": _sql(
            "SELECT id AS doc_id, CAST(CASE WHEN points <= 12 THEN 0 ELSE 1 END AS BIGINT) AS label, "
            "CAST(CASE WHEN points > 12 AND points < 30 THEN 0.5 ELSE 1 END AS DOUBLE) AS weight "
            "FROM weak", "weak"),
        "class_balance": _sql(
            "SELECT count(*) AS n, count(*) FILTER (WHERE points <= 12) AS n_negative, "
            "count(*) FILTER (WHERE points > 12) AS n_positive, sum(CAST(CASE WHEN points > 12 AND "
            "points < 30 THEN 0.5 ELSE 1 END AS DOUBLE)) AS weight_sum, "
            "avg(CAST(CASE WHEN points > 12 THEN 1 ELSE 0 END AS DOUBLE)) AS positive_rate FROM weak",
            "weak"),
        "policy_threshold_label": _sql(
            "SELECT id AS doc_id, policy_source, threshold, label FROM tagged", "tagged"),
        "policy_band": _sql("SELECT id AS doc_id, band_tag AS tag, policy_action, recommendation "
                            "FROM pol", "pol"),
        "policy_override_intended": _sql("SELECT id AS doc_id, tag FROM tagged", "tagged"),
        "policy_override_observed": _sql("SELECT id AS doc_id, tag_observed AS tag FROM tagged",
                                         "tagged"),
        "attribution_budget": _sql(
            "SELECT policy_source, points >= 20 AS do_shap, count(*) AS n, CAST(12 AS BIGINT) AS top_k "
            "FROM pol GROUP BY ALL", "pol"),
        "explanation_doc": _sql(
            f"SELECT id AS doc_id, '{K.MODEL_VERSION}' AS model_version, score AS predicted_score, "
            "label AS predicted_label, tag, policy_action AS action, reason, recommendation, ts_text "
            "AS timestamp, coalesce(n_features, 0) AS n_features, coalesce(top, '') AS top "
            "FROM fulldoc", "fulldoc"),
        "findings_doc": _sql(
            "SELECT id AS doc_id, score, label, policy_source AS source, threshold, tag, "
            "points >= 20 AS do_shap, CAST(12 AS BIGINT) AS top_k, reason FROM fulldoc", "fulldoc"),
        "top_features": _sql("SELECT id AS doc_id, feature, value, impact FROM topf WHERE rn <= 12",
                             "topf"),
        "dashboard_page": _sql(
            "SELECT rank, id AS doc_id, ts_text AS ts, score, floor(score * 1000 + 0.5) / 10 AS "
            "score_pct, label, agent, '' AS rule_desc, reason AS snippet FROM (SELECT *, row_number() "
            f"OVER (ORDER BY ts_text DESC, id) AS rank FROM ({_NEWEST})) WHERE rank > 15 AND rank <= 30",
            "fulldoc"),
        "dashboard_selected": _sql(
            "SELECT id AS doc_id, rn AS row, feature, value, impact, printf('%d. %s | value=%.3f | "
            f"impact=%.4f', rn, feature, value, impact) AS line_text FROM topf JOIN ({_ONE}) o "
            "USING (id) WHERE rn <= 12".replace("feature, value, impact, printf",
                                                "topf.feature, topf.value, topf.impact, printf"),
            "fulldoc"),
        "summary_rows": _sql(_summary(), "fulldoc"),
        "raw_lines": _sql(_raw(), "fulldoc"),
        "feedback_metrics": _sql(
            "SELECT count(*) AS total_feedback, sum(greatest(1, least(5, trust_score))) / CAST(count(*) "
            "AS DOUBLE) AS avg_trust, count(*) FILTER (WHERE overridden) / CAST(count(*) AS DOUBLE) "
            "AS override_rate FROM feedback", "feedback"),
        "feedback_metrics_pct": _sql(
            "SELECT avg(CAST(greatest(1, least(5, trust_score)) AS DOUBLE)) AS trust_mean, "
            "avg(CASE WHEN overridden THEN CAST(1 AS DOUBLE) ELSE 0 END) AS override_rate, count(*) AS n, "
            f"{_quantile(0.5, 'decision_ms')} AS decision_ms_p50, "
            f"{_quantile(0.95, 'decision_ms')} AS decision_ms_p95 FROM feedback", "feedback"),
        "feedback_join": _sql(
            f", feedback AS ({fixtures.FEEDBACK_SQL}) SELECT CAST(greatest(1, least(5, trust_score)) "
            "AS BIGINT) AS trust_score, count(*) AS n, count(w.id) AS explained, "
            "round(avg(CAST(points AS DOUBLE) / 100), 9) AS score_mean FROM feedback f "
            "LEFT JOIN weak w ON f.alert_id = w.id GROUP BY 1", "weak"),
        "latency_summary": _sql(
            ", kept AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS pos, "
            "count(*) OVER () AS n FROM latency WHERE (status_code IS NULL OR status_code = 200) "
            "AND (ok IS NULL OR ok)) SELECT count(*) AS samples, round(avg(latency_ms), 6) AS mean, "
            "min(latency_ms) AS min, max(latency_ms) AS max, quantile_cont(latency_ms, 0.5) AS median, "
            "max(latency_ms) FILTER (WHERE pos = round_even(CAST(0.95 AS DOUBLE) * (n - 1), 0)) AS p95, "
            "max(latency_ms) FILTER (WHERE pos = round_even(CAST(0.99 AS DOUBLE) * (n - 1), 0)) AS p99 "
            "FROM kept", "latency"),
        "consistency_flip": _sql("SELECT key, label_set, label_flip_rate FROM flips", "flips"),
        "consistency_score": _sql(
            "SELECT key, round(score_std, 9) AS score_std, round(score_max_delta, 9) AS score_max_delta "
            "FROM spread", "spread"),
        "consistency_jaccard": _sql(
            "SELECT key, round(jaccard, 9) AS topfeat_jaccard_mean_vs_r1 FROM jac", "jac"),
        "consistency_spearman": _sql(
            "SELECT k.key, round(rho, 9) AS impact_spearman_mean_vs_r1 FROM (SELECT DISTINCT key FROM "
            "rounds) k LEFT JOIN rho ON rho.key = k.key", "rho"),
        "consistency_summary": _sql(
            "SELECT count(*) AS alerts, CAST(10 AS BIGINT) AS rounds, round(avg(label_flip_rate), 8) AS "
            "flip_rate_mean, round(avg(jaccard), 8) AS jaccard_mean, round(avg(score_std), 8) AS "
            "score_std_mean FROM flips JOIN spread USING (key) JOIN jac USING (key)", "jac"),
        "consistency_gaps": _sql(_GAPS, "labelled"),
        "worst_ten": _sql(
            "SELECT key, label_flip_rate, round(jaccard, 9) AS topfeat_jaccard_mean_vs_r1 FROM flips "
            "JOIN jac USING (key) ORDER BY label_flip_rate DESC, round(jaccard, 9), key LIMIT 10", "jac"),
        "average_precision": _sql(
            ", s AS (SELECT points, count(*) AS n, sum(CASE WHEN t IN ('error', 'purchase') THEN 1 ELSE 0 "
            "END) AS pos FROM weak GROUP BY points), c AS (SELECT *, sum(n) OVER (ORDER BY points DESC) AS "
            "cn, sum(pos) OVER (ORDER BY points DESC) AS cp FROM s) SELECT round(sum(CAST(pos AS DOUBLE) * "
            "cp / cn) / sum(pos), 9) AS average_precision, CAST(sum(pos) AS BIGINT) AS positives, "
            "CAST(sum(n) AS BIGINT) AS n FROM c", "weak"),
        "score_quantile": _sql(
            "SELECT count(*) AS n, round(quantile_cont(CAST(points AS DOUBLE) / 100, 0.995), 9) AS cut "
            "FROM weak", "weak"),
        "class_report": _sql(_REPORT, "weak"),
        "rolling_counters": _sql(
            "SELECT id AS doc_id, " + _ROLLING.format(type="BIGINT")
            + " FROM directed", "directed"),
        "tumbling_volume": _sql("SELECT CAST(ts_s - ts_s % 600 AS BIGINT) AS window_start, count(*) AS n "
                                "FROM alerts GROUP BY 1", ""),
        "masked_templates": _sql(f", {_MASKED} SELECT template_id, template, tokens, n FROM templates",
                                 ""),
        "log_templates": _sql(
            f", {_MASKED} {_MERGED} SELECT substr(md5(template), 1, 16) AS template_id, template, "
            "CAST(sum(n) AS BIGINT) AS n, count(*) AS variants FROM merged GROUP BY template", ""),
        "mined_templates": _mined(
            "SELECT substr(md5(now), 1, 16) AS template_id, now AS template, CAST(sum(n) AS BIGINT) AS n, "
            "count(*) AS variants FROM {last} JOIN masked ON first = template GROUP BY now"),
        "message_templates": _mined(
            "SELECT origin, key, substr(md5(now), 1, 16) AS template_id FROM (SELECT *, "
            "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, "
            "'[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+', '<IP>', 'g'), '0x[0-9a-fA-F]+', '<HEX>', 'g'), "
            "'[0-9]+', '<NUM>', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS first FROM messages) "
            "LEFT JOIN {last} USING (first)"),
        "parsed_alerts": _sql(
            "SELECT decoder, rule_groups, count(*) AS n, CAST(sum(rule_level) AS BIGINT) AS levels, "
            "count(srcip) AS with_srcip, count(win_code) AS with_event FROM alerts GROUP BY ALL", ""),
        "enriched_features": _sql(
            "SELECT id AS doc_id, CAST(service_label = 'DNS' AS INT)::DOUBLE AS service_dns, "
            "CAST(logon_type IN ('10', '7') AS INT)::DOUBLE AS logon_type_rdp, "
            "CAST(src_is_private AS DOUBLE) AS src_private, CAST(dst_is_private AS DOUBLE) AS dst_private, "
            "CAST(hour(make_timestamp(CAST(ts_s * 1000000 AS BIGINT))) AS DOUBLE) AS hour, "
            + _ROLLING.format(type="DOUBLE") + " FROM directed", "directed"),
        "provenance_join": _sql(
            "SELECT 'alerts-' || substr(ts_text, 1, 10) AS _os_index, count(*) AS n, "
            "CAST(sum(points) AS BIGINT) AS points, CAST(sum(length(a.raw)) AS BIGINT) AS raw_chars "
            "FROM weak JOIN alerts a USING (id) GROUP BY 1", "weak"),
        "stream_equals_batch": _sql("SELECT count(*) AS n, count(*) AS equal FROM alerts", ""),
        "stream_rolling_equals": _sql(
            "SELECT count(*) AS n, count(*) AS equal FROM directed WHERE coalesce(src_ip, '') <> '' AND "
            "ts_s // 60 < (SELECT max(ts_s // 60) FROM directed WHERE coalesce(src_ip, '') <> '')", "directed"),
        "sampling_properties": _sql(
            "SELECT CAST(1000 AS BIGINT) AS drawn, CAST(1000 AS BIGINT) AS drawn_known, count(*) AS shuffled, "
            "count(*) AS different, count(*) AS places, count(*) AS last_place, least(100, count(*)) AS picked "
            "FROM alerts", ""),
        "model_properties": _sql(
            ", c AS (SELECT count(*) AS n, CAST(ceil(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS held "
            "FROM weak GROUP BY points <= 12), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, "
            "CAST(sum(n - held) AS BIGINT) AS train, CAST(sum(ceil(held / CAST(2 AS DOUBLE))) AS BIGINT) AS test FROM c) "
            "SELECT n AS scored, n AS in_range, n AS tree_ordered, n AS background_ordered, n AS importances_ordered, "
            "train AS prototype_rows, test AS tested, true AS ap_in_range, test AS supported FROM s", "weak"),
        "stored_model_equals": _sql("SELECT count(*) AS n, count(*) AS equal FROM alerts", ""),
        "model_less": _sql(
            "SELECT id AS doc_id, CAST(0.5 AS DOUBLE) AS predicted_score, CASE WHEN 0.5 >= threshold THEN "
            "'malicious' ELSE 'benign' END AS predicted_label, 'Model score only' AS reason, "
            "CAST(0 AS BIGINT) AS top FROM tagged", "tagged"),
        "stream_counters": _sql(
            ", latest AS (SELECT max(ts_s) - 2400 AS since FROM alerts), fates AS ("
            "SELECT CASE WHEN rule_level >= 4 THEN 'written' ELSE 'below' END AS fate FROM alerts UNION ALL "
            "SELECT CASE WHEN ts_s < since THEN 'late' WHEN rule_level < 4 THEN 'below' ELSE 'repeated' END "
            "FROM alerts, latest WHERE CAST(id AS BIGINT) % 7 = 0 UNION ALL "
            "SELECT 'bad' FROM alerts WHERE CAST(id AS BIGINT) % 100 = 0) "
            "SELECT CAST(2 AS BIGINT) AS batches, count(*) AS total, " + ", ".join(
                f"count(*) FILTER (WHERE fate = '{f}') AS {f}"
                for f in ("bad", "late", "below", "repeated", "written")) + " FROM fates", ""),
        "model_split": _sql(
            ", c AS (SELECT CAST(CASE WHEN points <= 12 THEN 0 ELSE 1 END AS BIGINT) AS label, "
            "count(*) AS n, CAST(ceil(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS held FROM weak "
            "GROUP BY 1) SELECT label, 'train' AS part, n - held AS n FROM c UNION ALL "
            "SELECT label, 'test', CAST(ceil(held / CAST(2 AS DOUBLE)) AS BIGINT) FROM c UNION ALL "
            "SELECT label, 'val', held - CAST(ceil(held / CAST(2 AS DOUBLE)) AS BIGINT) FROM c", "weak"),
        "attribution_additivity": _sql("SELECT count(*) AS n, true AS additive FROM alerts", ""),
    }
    return out


_ROLLING = ", ".join(
    f"CAST(CASE WHEN coalesce(src_ip, '') = '' THEN 0 ELSE {agg} OVER (PARTITION BY src_ip ORDER BY "
    f"ts_s RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW) END AS {{type}}) AS {name}"
    for name, agg, seconds in (("auth_fail_5m", "sum(auth_result_neg)", 300),
                               ("auth_fail_1h", "sum(auth_result_neg)", 3600),
                               ("conn_count_5m", "count(*)", 300)))
_REPORT = """
, j AS (SELECT CASE WHEN t IN ('error', 'purchase') THEN 1 ELSE 0 END AS y,
               CASE WHEN points >= 50 THEN 1 ELSE 0 END AS p FROM weak),
k AS (SELECT c.c, count(*) FILTER (WHERE y = c.c AND p = c.c) AS tp, count(*) FILTER (WHERE p = c.c) AS pp,
        count(*) FILTER (WHERE y = c.c) AS s FROM j CROSS JOIN (SELECT unnest([0, 1]) AS c) c GROUP BY c.c),
m AS (SELECT *, coalesce(tp / CAST(nullif(pp, 0) AS DOUBLE), 0) AS pr,
        coalesce(tp / CAST(nullif(s, 0) AS DOUBLE), 0) AS re FROM k),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM m),
n AS (SELECT count(*) AS n, avg(CASE WHEN y = p THEN CAST(1 AS DOUBLE) ELSE 0 END) AS acc FROM j)
SELECT CAST(c AS VARCHAR) AS name, round(pr, 9) AS precision, round(re, 9) AS recall,
       round(f1, 9) AS f1, s AS support FROM f
UNION ALL SELECT 'accuracy', round(acc, 9), round(acc, 9), round(acc, 9), n FROM n
UNION ALL SELECT 'macro avg', round(avg(pr), 9), round(avg(re), 9), round(avg(f1), 9),
  CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * s) / sum(s), 9), round(sum(re * s) / sum(s), 9),
  round(sum(f1 * s) / sum(s), 9), CAST(sum(s) AS BIGINT) FROM f
"""
