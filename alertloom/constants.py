"""Fixed values.

Everything in this module is data that results depend on: word lists, port sets, cut points
and weights. They are fixed by the alert format and scoring rules being reproduced; change one
and stored scores stop being comparable. Weights are in hundredths so that sums are exact.
"""

# --- source recognition -------------------------------------------------------------------
NETWORK_WORDS = ("fortigate", "cisco", "unifi", "asa", "firewall", "router", "switch")
OPENSTACK_WORDS = ("openstack", "nova", "keystone", "neutron")
LINUX_DECODERS = ("sshd", "syslog", "sudo", "pam", "kernel", "dpkg",
                  "nginx", "apache", "systemd", "journald")
LINUX_DECODER_WORDS = ("sshd", "syslog", "sudo", "pam", "dpkg", "nginx")
LINUX_WORDS = ("sshd", "pam_unix", "sudo", "ufw", "dpkg", "journald")
NETWORK_SOURCES = ("fortigate", "cisco", "unifi")

# --- ports and services -------------------------------------------------------------------
SENSITIVE_PORTS = (22, 445, 3389, 5985, 5986)
ADMIN_SERVICES = ("SSH", "RDP", "WINRM", "WMI")

# --- syslog messages ----------------------------------------------------------------------
AUTH_OK_PHRASES = ("accepted password", "accepted publickey", "session opened")
AUTH_FAIL_PHRASES = ("failed password", "authentication failure", "invalid user",
                     "connection closed", "preauth", "command not allowed")
SYSTEMD_FAIL_WORDS = ("failed", "killed", "error")
SYSLOG_CRITICAL_GROUPS = ("exploit_attempt", "brute_force", "web_attack",
                          "privilege_escalation", "high_severity", "attack")
SYSLOG_HIGH_GROUPS = ("authentication_failed", "recon", "tool_install",
                      "lateral_movement", "c2", "data_exfiltration")
SYSLOG_MEDIUM_GROUPS = ("authentication_success", "ids", "ips", "syscheck",
                        "config_change", "firewall_drop")

# --- actions ------------------------------------------------------------------------------
ALLOWED_ACTIONS = ("allow", "allowed", "accept", "permitted")
BLOCKED_ACTIONS = ("block", "blocked", "deny", "denied")
DROPPED_ACTIONS = ("drop", "dropped")
FLOW_ACTIONS = ("allow", "allowed", "accept")

# --- weak risk score (points in hundredths) -------------------------------------------------
LEVEL_POINTS = ((15, 60), (12, 45), (10, 30), (8, 20), (6, 10), (4, 4))
RISK_CRITICAL_GROUPS = (
    "authentication_failed", "brute_force", "exploit_attempt", "web_attack",
    "privilege_escalation", "lfi", "data_exfiltration", "c2", "tool_install",
    "lateral_movement", "recon", "attack", "intrusion_detection", "high_severity",
)
RISK_MEDIUM_GROUPS = ("authentication_success", "firewall_drop", "ids", "ips",
                      "syscheck", "config_change", "vpn_anomaly")
RISK_CRITICAL_WORDS = (
    "brute force", "exploit", "privilege escalat", "web shell", "path traversal",
    "sql inject", "scanner", "attack", "malware", "rootkit", "ransomware",
    "reverse shell", "c2", "tor", "exfiltrat",
)
RISK_MEDIUM_WORDS = (
    "authentication fail", "login fail", "invalid user", "sudo", "permission denied",
    "blocked", "dropped", "configuration changed", "package install",
)
RISK_TOOL_WORDS = (
    "cve-", "log4shell", "shellshock", "heartbleed", "eternalblue", "mimikatz",
    "meterpreter", "empire", "cobalt", "metasploit", "nmap", "sqlmap", "nikto",
    "hydra", "masscan",
)
RISK_PORTS = (21, 22, 23, 25, 53, 110, 135, 139, 443, 445, 1433, 1521, 3306, 3389,
              4444, 5985, 5986, 6379, 9001, 9030)
RISK_STOPPED_ACTIONS = ("dropped", "denied", "blocked", "reset")
LABEL_LOW, LABEL_HIGH, GREY_WEIGHT = 12, 30, 0.50

# --- explanation ----------------------------------------------------------------------------
MODEL_VERSION = "v0.2"
TOP_K_DEFAULT, TOP_K_FLOOR = 10, 10

# Compact vector used when no feature map is given.
COMPACT_FEATURES = (
    "rule_level", "severity_ord", "bytes_sent", "bytes_recv", "bytes_total", "duration_sec",
    "dst_port", "dst_svc_sensitive", "dst_svc_admin", "pf_win", "pf_lin", "pf_nw", "pf_osks",
    "auth_result_pos", "auth_result_neg", "service_snmp", "service_ssh", "service_rdp",
    "service_winrm", "hour",
)
