"""Thresholds and word lists of the detectors."""

from __future__ import annotations

from copy import deepcopy

# Default thresholds, ports, networks, word lists and names that results are judged by.
DEFAULTS: dict = {
    "beacon": {"min_samples": 12, "max_cov": 0.20, "max_mad_ratio": 0.25, "min_duration_sec": 10.0},
    "credentials": {"enabled": True},
    "lateral": {
        "fanout_threshold": 15,
        "high_risk_ports": [22, 88, 135, 139, 445, 3389, 5985, 5986],
        "internal_subnets": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"],
    },
    "exfil": {"min_exfil_bytes": 5_000_000},
    "entropy": {"entropy_threshold": 3.8, "consonant_cluster_len": 5, "min_subdomain_len": 8},
    "sweep": {"sweep_threshold": 10},
    "tcpstate": {"syn_scan_threshold": 10, "flag_anomalies_enabled": True},
    "file_carver": {"enabled": True},
    "smb_audit": {"enabled": True},
    "dns_tunnel": {"enabled": True, "min_queries": 8, "min_avg_subdomain_len": 20.0},
}
NOISE_PREFIXES = ["_ldap.", "_kerberos.", "_kpasswd.", "_gc.", "_msdcs.", "_sites.", "_tcp.", "_udp.", "_vlmcs.", "_autodiscover.", "_domainkey.", "_sip.", "_turn.", "_stun."]
NOISE_PARTS = ["._msdcs.", "._sites.", "._tcp.", "._udp.", "in-addr.arpa", "ip6.arpa", "wpad.", "isatap."]
NOISE_SUFFIXES = [
    ".microsoft.com", ".msftncsi.com", ".windowsupdate.com", "clients6.google.com", ".googleapis.com", "mshome.net", ".local",
    ".trafficmanager.net", ".azure.com", ".amazonaws.com", ".cloudfront.net", ".akamaihd.net", ".live.com",
]
SCRIPT_AGENTS = ["curl/", "python-requests", "go-http-client", "powershell", "nikto", "sqlmap", "nmap", "wget/", "python-urllib", "libwww-perl"]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PROPFIND", "SEARCH", "TRACE", "CONNECT"]
RISKY_METHODS = ["PUT", "PROPFIND", "DELETE", "SEARCH", "TRACE", "CONNECT"]
WEBSHELLS = [r"c99\.php", r"r57\.php", r"cmd\.php", r"shell\.php", r"\?cmd=", r"\?exec=", r"eval-stdin", r"passthru\(", r"system\("]
HTTP_PORTS, SMB_PORTS, ENCRYPTED_PORTS = [80, 8080, 8000], [445, 139, 135], [443, 8443, 993, 995, 465, 22]
PIPES = [
    ("svcctl", "CRITICAL", "Lateral Movement"), ("samr", "HIGH", "Credential Access"), ("lsarpc", "HIGH", "Credential Access"), ("atsvc", "HIGH", "Execution"),
    ("epmapper", "LOW", "Reconnaissance"), ("wkssvc", "MEDIUM", "Discovery"), ("srvsvc", "MEDIUM", "Discovery"),
]
SHARES = [("admin$", "HIGH", "Lateral Movement"), ("c$", "HIGH", "Lateral Movement"), ("ipc$", "LOW", "Reconnaissance")]
MAGIC = [
    (b"MZ", "Windows executable", "HIGH", "Execution"), (b"\x7fELF", "ELF executable", "HIGH", "Execution"), (b"PK\x03\x04", "ZIP container", "MEDIUM", "Execution"),
    (b"%PDF-", "PDF document", "MEDIUM", "Initial Access"), (b"Rar!\x1a\x07", "RAR archive", "MEDIUM", "Execution"), (b"7z\xbc\xaf\x27\x1c", "7z archive", "MEDIUM", "Execution"),
    (b"\xca\xfe\xba\xbe", "Java class or Mach-O", "HIGH", "Execution"),
]
JA3_INTEL = [
    ("72a589da586844d7f0818ce684948eea", "Cobalt Strike Beacon Default TLS Profile"), ("a0e9f5d64349da131239751b7525677e", "Metasploit Meterpreter Reverse HTTPS"),
    ("51c64c77e60f3980eea0a10352e6097d", "AsyncRAT / QuasarRAT C2 Implant"), ("3b40583800ee314328701d15e8812202", "Sliver C2 Implant Framework"),
    ("b32309a26951912be7dba376398abc3b", "Mythic C2 Agent Profile"), ("67346d8e9252066e66d17135623401e5", "AgentTesla / Formbook Stealer"),
]
STAGES = [
    "Reconnaissance", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery",
    "Lateral Movement", "Command & Control", "Exfiltration",
]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
QTYPES = [(1, "A"), (28, "AAAA"), (5, "CNAME"), (16, "TXT"), (15, "MX"), (12, "PTR"), (33, "SRV"), (255, "ANY")]
FLAG_NAMES = [(0x02, "SYN"), (0x10, "ACK"), (0x01, "FIN"), (0x04, "RST"), (0x08, "PSH"), (0x20, "URG"), (0x40, "ECE"), (0x80, "CWR")]


def configured(rules: dict | None = None) -> dict:
    """Defaults with the sections of rules laid over them."""
    out = deepcopy(DEFAULTS)
    for section, values in (rules or {}).items():
        name = "exfil" if section == "exfiltration" else section
        if isinstance(values, dict):
            out.setdefault(name, {}).update(values)
        elif values is not None:
            out[name] = values
    return out
