"""One canonical record per alert.

Each canonical field is a single CASE over the detected source, so the alerts are scanned once
instead of once per mapper. ``linux_signals`` holds what has to be read out of syslog text.
"""

from pyspark.sql import Column, DataFrame

from alertloom import constants as K
from alertloom.functions.coerce import (
    add, any_word, array_of, case, first_given, flag, lower_text, quoted_list,
    severity_to_ordinal, text, to_int,
)
from alertloom.functions.net import is_private, same_subnet_24, service_name
from alertloom.operators.detect import detect_source, policy_source, with_signals
from alertloom.schema import CANONICAL_FIELDS, DERIVED_FIELDS

_NETWORK = f"source IN ({quoted_list(K.NETWORK_SOURCES)})"


def linux_signals(df: DataFrame) -> DataFrame:
    """Adds the syslog reading: authentication result, category and the port in the text."""
    auth = case((any_word("_msg", K.AUTH_OK_PHRASES), "1L"),
                (any_word("_msg", K.AUTH_FAIL_PHRASES), "0L"), otherwise="-1L")
    category = case(
        ("contains(_msg, 'sshd') OR _dec = 'sshd'", "'ssh'"),
        ("contains(_msg, 'sudo') OR _dec = 'sudo'", "'sudo'"),
        ("contains(_msg, 'pam_unix') OR startswith(_dec, 'pam')", "'pam'"),
        ("contains(_msg, 'ufw') OR contains(_msg, 'iptables') "
         "OR (contains(_dec, 'kernel') AND contains(_msg, 'block'))", "'firewall'"),
        ("contains(_msg, 'nginx') OR contains(_msg, 'apache') OR _dec IN ('nginx', 'apache')",
         "'web'"),
        ("contains(_msg, 'dpkg') OR _dec = 'dpkg'", "'package'"),
        ("contains(_msg, 'systemd') OR _dec = 'systemd'", "'service'"),
        otherwise="'other'",
    )
    read = add(
        df,
        _level=to_int("rule.level"),
        _auth=case(("source = 'linux'", auth), otherwise="-1L"),
        _cat=case(("source = 'linux'", category), otherwise="'other'"),
        _given_port=to_int(first_given("data.dstport", "data.dst_port")),
    )
    return add(read, _lport=case(
        ("_cat = 'ssh' AND _given_port = 0", "22L"),
        ("_cat = 'web' AND _given_port = 0", "80L"),
        ("_cat = 'firewall'",
         r"coalesce(try_cast(regexp_extract(_msg, 'dpt[=:](\\d+)', 1) AS BIGINT), _given_port)"),
        otherwise="_given_port",
    ))


def _linux_action() -> str:
    by_auth = case(("_auth = 1", "'allowed'"), ("_auth = 0", "'blocked'"), otherwise="'na'")
    status = "try_cast(regexp_extract(_msg, '\" (\\\\d{3}) ', 1) AS INT)"

    def blocked_if(condition: str) -> str:
        return case((condition, "'blocked'"), otherwise="'allowed'")

    return (
        f"CASE _cat WHEN 'ssh' THEN {by_auth} WHEN 'pam' THEN {by_auth} "
        f"WHEN 'sudo' THEN {blocked_if(any_word('_msg', ('command not allowed', 'not in sudoers')))} "
        f"WHEN 'firewall' THEN {blocked_if(any_word('_msg', ('block', 'drop')))} "
        f"WHEN 'web' THEN coalesce(if({status} >= 400, 'blocked', if({status} < 400, 'allowed', "
        "NULL)), 'na') "
        "WHEN 'package' THEN 'allowed' "
        f"WHEN 'service' THEN {blocked_if(any_word('_msg', K.SYSTEMD_FAIL_WORDS))} ELSE 'na' END"
    )


def _linux_severity() -> str:
    def among(names) -> str:
        return f"arrays_overlap(_groups, {array_of(names)})"

    return case(
        (f"_level >= 12 OR {among(K.SYSLOG_CRITICAL_GROUPS)}", "3L"),
        (f"_level >= 8 OR {among(K.SYSLOG_HIGH_GROUPS)}", "2L"),
        (f"_level >= 6 OR {among(K.SYSLOG_MEDIUM_GROUPS)}", "1L"),
        otherwise="0L",
    )


_LINUX_FAMILY = (
    "CASE _cat WHEN 'ssh' THEN 'auth' WHEN 'pam' THEN 'auth' "
    "WHEN 'sudo' THEN 'privilege_escalation' WHEN 'firewall' THEN 'firewall' "
    "WHEN 'web' THEN 'web' WHEN 'package' THEN 'package_install' "
    "WHEN 'service' THEN 'service_event' ELSE 'na' END"
)
_LINUX_ADDRESS = (
    "coalesce(nullif(data.srcip, ''), nullif(data.src_ip, ''), "
    r"regexp_extract(_msg, 'from\\s+(\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})', 1))"
)


def canonical_fields(df: DataFrame) -> DataFrame:
    """Adds the canonical columns to a frame that has passed ``linux_signals``."""

    def by_source(network: str, windows: str, linux: str, openstack: str, generic: str) -> str:
        return case((_NETWORK, network), ("source = 'windows'", windows),
                    ("source = 'linux'", linux), ("source = 'openstack'", openstack),
                    otherwise=generic)

    none, na, zero, unknown = "''", "'na'", "0L", "-1L"
    event = "win.event"
    agent = text("agent.name")
    rdp = f"coalesce(nullif({event}.LogonType, ''), {event}.logon_type) IN ('10', '7')"
    rated = (f"CASE WHEN data.severity IS NOT NULL THEN {severity_to_ordinal('data.severity')} "
             f"ELSE {severity_to_ordinal('rule.level')} END")
    family = f"lower({first_given('data.subtype', na)})"
    sport, dport = to_int("data.srcport"), to_int("data.dstport")
    sent, received, lasted = (to_int(f"data.{n}") for n in ("sentbyte", "rcvdbyte", "duration"))

    settled = add(df, _outcome=f"lower({first_given('data.outcome', 'data.status', none)})",
                  _rdp=flag(rdp))
    base = add(
        settled,
        src_ip=by_source(first_given("data.srcip", "data.src"), text(f"{event}.IpAddress"),
                         _LINUX_ADDRESS, text("data.remote_address"), text("data.srcip")),
        dst_ip=by_source(first_given("data.dstip", "data.dst"), none, text("data.dstip"), none,
                         text("data.dstip")),
        src_port=by_source(sport, to_int(f"{event}.IpPort"), sport, zero, sport),
        dst_port=by_source(dport, case(("_rdp = 1", "3389L"), otherwise=zero), "_lport", zero,
                           dport),
        proto=by_source(
            first_given("data.proto", "data.proto_name", na), "'tcp'",
            case(("_cat = 'firewall' AND contains(_msg, 'udp')", "'udp'"), otherwise="'tcp'"),
            "'tcp'", first_given("data.proto", na)),
        bytes_sent=by_source(sent, zero, zero, to_int("data.bytes_sent"), sent),
        bytes_recv=by_source(received, zero, zero, to_int("data.bytes_received"), received),
        duration_sec=by_source(lasted, zero, zero, lasted, lasted),
        rule_level="_level",
        severity_ord=by_source(rated, zero, _linux_severity(), zero, rated),
        action=by_source(lower_text("data.action"), na, _linux_action(), na,
                         f"lower({first_given('data.action', na)})"),
        threat_family=by_source(
            family, "'auth'", _LINUX_FAMILY,
            case(("_outcome IN ('success', 'failure')", "'auth'"), otherwise=na), family),
        service_label=by_source(
            service_name(dport, "data.service"), case(("_rdp = 1", "'RDP'"), otherwise="'NA'"),
            f"CASE _cat WHEN 'ssh' THEN 'SSH' WHEN 'web' THEN 'HTTP' WHEN 'firewall' THEN "
            f"{service_name('_lport', none)} ELSE 'NA' END",
            "'API'", service_name(dport, "data.service")),
        user=by_source(text("data.srcuser"),
                       text(first_given(f"{event}.TargetUserName", f"{event}.AccountName")),
                       text(first_given("data.user", "data.srcuser")), text("data.username"),
                       text("data.user")),
        host=by_source(first_given("data.devname", agent), agent, agent,
                       first_given("data.service", "'openstack'"), agent),
        platform_source=case((_NETWORK, "'network'"), otherwise="source"),
        auth_result=by_source(
            unknown, f"CASE {event}.code WHEN '4624' THEN 1L WHEN '4625' THEN 0L ELSE -1L END",
            "_auth", "CASE _outcome WHEN 'success' THEN 1L WHEN 'failure' THEN 0L ELSE -1L END",
            unknown),
        logon_type=by_source(
            na, f"coalesce(nullif({event}.LogonType, ''), nullif({event}.logon_type, ''), 'na')",
            na, "'api'", na),
        pf_win=flag("source = 'windows'"),
        pf_lin=flag("source = 'linux'"),
        pf_nw=flag(_NETWORK),
        pf_osks=flag("source = 'openstack'"),
    )
    return add(
        base,
        bytes_total="bytes_sent + bytes_recv",
        dst_svc_sensitive=flag(f"dst_port IN ({quoted_list(K.SENSITIVE_PORTS)})"),
        dst_svc_admin=flag(f"service_label IN ({quoted_list(K.ADMIN_SERVICES)})"),
        hour=zero,
    )


def derived_fields(canon: DataFrame) -> DataFrame:
    """Adds buckets, one-hot flags, address traits and the direction heuristic."""
    staged = add(
        canon,
        _svc="upper(service_label)",
        _act=lower_text("action"),
        _token=f"lower(trim({text('proto')}))",
        src_is_private=is_private("src_ip"),
        dst_is_private=is_private("dst_ip"),
    )
    staged = add(staged, _proto_no="CASE WHEN _token RLIKE '^[0-9]+$' "
                                   "THEN try_cast(_token AS BIGINT) END")
    flow = f"_act IN ({quoted_list(K.FLOW_ACTIONS)}) AND pf_nw = 1"
    return add(
        staged,
        port_bucket_low=flag("dst_port > 0 AND dst_port <= 1024"),
        port_bucket_mid=flag("dst_port BETWEEN 1025 AND 49151"),
        port_bucket_high=flag("dst_port >= 49152"),
        proto_tcp=flag("_proto_no = 6 OR _token = 'tcp'"),
        proto_udp=flag("_proto_no = 17 OR _token = 'udp'"),
        proto_icmp=flag("_proto_no = 1 OR _token = 'icmp'"),
        **{f"service_{s.lower()}": flag(f"_svc = '{s}'")
           for s in ("SNMP", "SSH", "RDP", "WINRM", "SMTP", "HTTP", "HTTPS")},
        auth_result_pos=flag("auth_result = 1"),
        auth_result_neg=flag("auth_result = 0"),
        action_allowed=flag(f"_act IN ({quoted_list(K.ALLOWED_ACTIONS)})"),
        action_blocked=flag(f"_act IN ({quoted_list(K.BLOCKED_ACTIONS)})"),
        action_dropped=flag(f"_act IN ({quoted_list(K.DROPPED_ACTIONS)})"),
        same_subnet_24=same_subnet_24("src_ip", "dst_ip"),
        dir_ingress=flag(f"{flow} AND dst_is_private = 1"),
        dir_egress=flag(f"{flow} AND src_is_private = 1 AND dst_is_private = 0"),
        dir_internal=flag("src_is_private = 1 AND dst_is_private = 1"),
    )


def canonicalize(alerts: DataFrame, keep: tuple[str, ...] = ("doc_id",),
                 extra_columns: dict[str, Column] | None = None) -> DataFrame:
    """Alerts to canonical rows: ``keep`` columns, both sources, canonical and derived fields.

    ``extra_columns`` adds further canonical fields (name to Column over the alert and canonical
    columns); a feature map can then refer to them.
    """
    staged = linux_signals(policy_source(detect_source(with_signals(alerts))))
    out = derived_fields(canonical_fields(staged))
    extra = extra_columns or {}
    if extra:
        out = out.withColumns(extra)
    return out.select(*keep, "source", "policy_source", *CANONICAL_FIELDS, *DERIVED_FIELDS, *extra)
