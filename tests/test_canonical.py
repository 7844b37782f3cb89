"""Mapper branches with hand-computed expectations."""

import pytest

from alertloom.operators.canonical import canonicalize
from alertloom.operators.detect import detect_source, policy_source, with_signals


def alert(decoder="", groups=(), level=3, log="", data=None, agent="host1", location="", **more):
    return {"id": more.pop("id", "1"), "rule": {"level": level, "groups": list(groups)},
            "agent": {"name": agent}, "decoder": {"name": decoder}, "location": location,
            "full_log": log, "data": data or {}, **more}


def one(make_alerts, a):
    return canonicalize(make_alerts(a)).first().asDict()


LINUX = [
    # decoder, log, level, groups -> action, family, service, port, auth, severity, src
    ("sshd", "Failed password for root from 203.0.113.42 port 51234 ssh2", 5, [],
     ("blocked", "auth", "SSH", 22, 0, 0, "203.0.113.42")),
    ("sshd", "Accepted publickey for devops from 192.168.1.15 port 22 ssh2", 3,
     ["authentication_success"], ("allowed", "auth", "SSH", 22, 1, 1, "192.168.1.15")),
    ("sshd", "Disconnected from authenticating user root 203.0.113.42 port 51237 [preauth]", 8, [],
     ("blocked", "auth", "SSH", 22, 0, 2, "")),
    ("sudo", "alice : TTY=pts/1 ; USER=root ; COMMAND=/usr/bin/passwd", 3, [],
     ("allowed", "privilege_escalation", "NA", 0, -1, 0, "")),
    ("sudo", "www-data : command not allowed ; USER=root", 12, [],
     ("blocked", "privilege_escalation", "NA", 0, 0, 3, "")),
    ("pam", "pam_unix(login:session): session opened for user devops by (uid=0)", 3, [],
     ("allowed", "auth", "NA", 0, 1, 0, "")),
    ("kernel", "[UFW BLOCK] IN=eth0 SRC=10.0.0.9 PROTO=UDP DPT=161", 6, [],
     ("blocked", "firewall", "SNMP", 161, -1, 1, "")),
    ("kernel", "iptables accepted dpt:443", 3, [], ("allowed", "firewall", "HTTPS", 443, -1, 0, "")),
    ("nginx", '10.0.0.1 - - "GET / HTTP/1.1" 404 12 "-"', 3, ["web_attack"],
     ("blocked", "web", "HTTP", 80, -1, 3, "")),
    ("nginx", "worker exited", 3, [], ("na", "web", "HTTP", 80, -1, 0, "")),
    ("dpkg", "status installed jq:amd64", 3, ["config_change"],
     ("allowed", "package_install", "NA", 0, -1, 1, "")),
    ("systemd", "Failed to start unit", 3, [], ("blocked", "service_event", "NA", 0, -1, 0, "")),
]


@pytest.mark.parametrize("decoder,log,level,groups,expected", LINUX)
def test_linux_branches(make_alerts, decoder, log, level, groups, expected):
    row = one(make_alerts, alert(decoder, groups, level, log, location="journald"))
    got = tuple(row[c] for c in ("action", "threat_family", "service_label", "dst_port",
                                 "auth_result", "severity_ord", "src_ip"))
    assert row["source"] == "linux" and got == expected


def test_network_mapper(make_alerts):
    row = one(make_alerts, alert("fortigate-firewall-v5", level=9, data={
        "src": "10.0.0.1", "dstip": "8.8.8.8", "srcport": "1", "dstport": 443, "proto": 6,
        "sentbyte": "100", "rcvdbyte": 50, "duration": "7", "action": "Accept", "subtype": "IPS",
        "devname": "fw1", "srcuser": "bob"}))
    expected = {"source": "fortigate", "platform_source": "network", "src_ip": "10.0.0.1",
                "dst_port": 443, "service_label": "HTTPS", "bytes_total": 150, "severity_ord": 2,
                "action": "accept", "threat_family": "ips", "host": "fw1", "user": "bob",
                "proto_tcp": 1, "dir_egress": 1, "dir_ingress": 0, "src_is_private": 1,
                "dst_is_private": 0, "pf_nw": 1, "auth_result": -1}
    assert {k: row[k] for k in expected} == expected


def test_windows_mapper(make_alerts):
    row = one(make_alerts, alert(win={"event": {"code": 4625, "LogonType": "10", "IpPort": "x",
                                                "AccountName": "eve"}}, agent="pc"))
    expected = {"source": "windows", "dst_port": 3389, "service_label": "RDP", "auth_result": 0,
                "src_port": 0, "user": "eve", "severity_ord": 0, "dst_svc_admin": 1,
                "dst_svc_sensitive": 1, "logon_type": "10"}
    assert {k: row[k] for k in expected} == expected


def test_openstack_and_generic(make_alerts):
    row = one(make_alerts, alert("openstack-nova", data={"status": "Success", "service": "nova",
                                                         "bytes_sent": "5", "username": "u"}))
    assert (row["source"], row["auth_result"], row["host"], row["service_label"],
            row["bytes_total"], row["threat_family"]) == ("openstack", 1, "nova", "API", 5, "auth")
    row = one(make_alerts, alert("json", level=12, data={"dstport": "25", "service": "x"}))
    assert (row["source"], row["action"], row["service_label"], row["severity_ord"],
            row["proto"]) == ("generic", "na", "SMTP", 3, "na")


SOURCES = [
    (alert("kernel", ["firewall_drop"]), "unifi", "network"),
    (alert("json", agent="switch-7"), "unifi", "network"),
    (alert("json", agent="casa"), "cisco", "network"),
    (alert("json", agent="darwin-1"), "windows", "endpoint"),
    (alert("json", data={"devid": "FG1"}), "fortigate", "network"),
    (alert("json", data={"subtype": "ips"}), "fortigate", "network"),
    (alert("json", win={"event": {}}), "generic", "server"),
    (alert("json", win={"event": {"other": "1"}}), "windows", "endpoint"),
    (alert("sshd"), "linux", "server"),
    (alert("json", ["linux"]), "linux", "endpoint"),
    (alert("json", location="journald"), "linux", "server"),
    (alert("json", ["keystone"]), "openstack", "server"),
    (alert("json", location="router.log"), "unifi", "server"),
]


def test_source_rules(make_alerts):
    rows = [dict(a, id=str(n)) for n, (a, _, _) in enumerate(SOURCES)]
    got = policy_source(detect_source(with_signals(make_alerts(*rows)))).select(
        "doc_id", "source", "policy_source").collect()
    assert {int(r[0]): (r[1], r[2]) for r in got} == {
        n: (s, p) for n, (_, s, p) in enumerate(SOURCES)}


def test_coercion_and_buckets(make_alerts):
    levels = [6, "6", 6.0, True, None, " 7 ", "+5", "x"]
    rows = [alert("json", level=v, id=str(n)) for n, v in enumerate(levels)]
    got = {int(r["doc_id"]): r["rule_level"] for r in canonicalize(make_alerts(*rows)).collect()}
    assert [got[n] for n in range(len(levels))] == [6, 6, 0, 0, 0, 7, 5, 0]
    ports = [0, 1, 1024, 1025, 49151, 49152]
    rows = [alert("json", data={"dstport": p}, id=str(n)) for n, p in enumerate(ports)]
    got = {int(r["doc_id"]): (r["port_bucket_low"], r["port_bucket_mid"], r["port_bucket_high"])
           for r in canonicalize(make_alerts(*rows)).collect()}
    assert [got[n] for n in range(6)] == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0),
                                          (0, 0, 1)]


def test_severity_forms(make_alerts):
    values = ["critical", " High ", "medium", "low", "12", 9, "6", "5", "", "9.5"]
    rows = [alert("json", level=15, data={"severity": v}, id=str(n)) for n, v in enumerate(values)]
    got = {int(r["doc_id"]): r["severity_ord"] for r in canonicalize(make_alerts(*rows)).collect()}
    assert [got[n] for n in range(len(values))] == [3, 2, 1, 0, 3, 2, 1, 0, 0, 0]


def test_private_addresses(make_alerts):
    cases = {"10.1.2.3": 1, "172.16.0.1": 1, "172.32.0.1": 0, "192.168.0.1": 1, "203.0.113.9": 1,
             "198.51.100.1": 1, "8.8.8.8": 0, "100.64.0.1": 0, "192.0.0.9": 0, "192.0.0.8": 1,
             "255.255.255.255": 1, "010.1.1.1": 0, "10.1.1": 0, "300.1.1.1": 0, "": 0, "::1": 1,
             "fd00::1": 1, "fe80::1": 1, "2606::1": 0, "10.0.0.1 ": 0}
    rows = [alert("json", data={"srcip": a}, id=str(n)) for n, a in enumerate(cases)]
    got = {int(r["doc_id"]): r["src_is_private"] for r in canonicalize(make_alerts(*rows)).collect()}
    assert [got[n] for n in range(len(cases))] == list(cases.values())
