"""Findings with texts: line items whose keys pick among sample phrases, so that every rule is met many times.

The same table stands as a frame and as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables
from .twin import pick, picked

VALUES = {
    "title": ("l_partkey", (
        "SQL Injection in search field", "Cross-site scripting (DOM-based)", "Missing HttpOnly flag on session cookie", "Outdated Apache web server", "Server-side request forgery in webhook",
        "Privilege escalation through sudo rule", "TLS certificate expired", "Weak cipher suites on mail gateway", "Open port 23/tcp (telnet)", "Directory listing of backup files", "RSA-2048 key in VPN gateway",
        "SSH host key ECDSA", "Database encryption at rest with 3DES", "Firmware signing with SHA-1", "Default password on printer", "Buffer overflow in archive tool", "DNS zone transfer allowed",
        "Bluetooth pairing without code", "Phishing mails pass without DMARC", "Clickjacking on settings page", "Denial of service by slow requests", "Header banner shows version", "Unremarkable note", None, "",
        "OpenSSL library end of life", "Key vault without rotation", "GraphQL introspection", "Firewall segmentation gap", "Audit trail not monitored", "IDOR in invoice download", "HTTP/2 rapid reset crash",
    )),
    "description": ("l_suppkey", (
        "Attackers may read sensitive data.", "The host answers with a stack trace and its version.", "An attacker could steal the session token via cross-site scripting.", None, "No further details.",
        "Contact admin@example.org for access.", "The configuration has password: hunter22 in it.", "The internet banking portal offers RC4.", "Updates are missing; patch the host.", "An employee portal on the intranet.",
        "Seen in the handshake of mlkem768x25519-sha256@openssh.com only.", "CWE-306: Missing authentication.", "The backup server stores data at rest.", "Requests run into a timeout under load.", "Social security numbers are shown.",
    )),
    "evidence": ("l_orderkey", ("GET / HTTP/1.1", None, "port 443 open", "CWE-79 in response", "Certificate : RSA2048", "", "ike phase 1 proposal", "login banner")),
    "remediation": ("l_partkey + l_suppkey", ("Update to the latest version.", None, "Set the flag.", "Rotate the credential at once.")),
    "target": ("l_suppkey + l_linenumber", (
        "10.0.0.5:443/tcp (www)", "https://shop.test/catalog [Referer HTTP header]", "N/A", None, "Web application endpoint", "host-a, host-b; host-c", "10.0.0.5:443/tcp", "db.internal (cut short", "HTTP://APP.TEST/x", "-", "10.0.0.7",
    )),
    "tool": ("l_linenumber", ("Nessus", "Burp Suite", "VAPT Engine", "", None, "nmap", "PQC-Scan")),
    "plugin": ("l_partkey + l_linenumber", (None, "19506", "burp-issue", "", "104743 ", "generic")),
    "vector": ("l_orderkey + l_partkey", (
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:L/A:N", None, "AV:N/AC:L/Au:N/C:P/I:P/A:P", "CVSS:3.0/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N", "CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N",
        "no vector", "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:C/C:N/I:N/A:N", "AV:L/AC:M/Au:S/C:N/I:N/A:C", "CVSS:3.1/AV:A/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:L", "CVSS:3.1/AV:N/AC:L", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    )),
    "cwe": ("l_partkey", ("CWE-79", None, "cwe 22", "CWE-1104", "99999", "", "CWE-918")),
    "status": ("l_orderkey + l_linenumber", ("Accepted", "compliant", "Non-Compliant", "Rejected", "False Positive", "closed", "PASS", "", None, "Partial Compliant", "confirmed", "open", "out of scope", "Satisfied", "gap")),
    "recorded": ("l_suppkey", ("COMPLIANT", "NON_COMPLIANT", None, "closed", "", "Compliant ")),
    "severity": ("l_quantity::INT", ("Critical", "P1 Critical", "high", "7.5", "P3 Medium", "Low", "INFO", None, "informational", "9.8", "0.3", "medium risk")),
    "exposure": ("l_linenumber", ("EXTERNAL", "internal", "", None, "External ")),
    "quantum": ("l_partkey + l_linenumber", ("VULNERABLE", "WEAK", "SAFE", None, "")),
    "asset": ("l_suppkey", ("Core banking node", "API gateway 2", "HR portal", "staging box", "", None, "unit 7")),
    "likelihood": ("l_linenumber", (None, "HIGH", "low", "severe", "Moderate")),
    "consequence": ("l_partkey", ("MODERATE", None, "high", "", "LOW")),
    "policy_status": ("l_suppkey", ("FOUND", "NOT_FOUND", "found", None)),
    "evidence_status": ("l_orderkey", ("NOT_FOUND", "FOUND", "NOT_FOUND", "", "found")),
    "assessment": ("l_partkey", ("NON_COMPLIANT", "COMPLIANT", None)),
    "day": ("l_orderkey", (
        "2024-01-31", "31-12-2023", "05/02/2024", "12/31/2023", "March 5, 2024", "5 March 2024", "Mar 5, 2024", "5 Mar 2024", "2024/06/07", "07-Jun-2024", "7.6.2024", "April 2026", "Apr 2026", "2026-04", "04/2026", "2023/02", "soon", None, "",
    )),
    "source_text": ("l_partkey", ("Version of 2024, page 5, expires in 04 of 2026.", "no dates", None, "signed 31 December 2023 and 2024-01-31", "The policy was superseded in 2023.")),
    "clause": ("l_suppkey", ("5.15 Access control", "8.17 Clock synchronization", "7.2 Physical entry", None, "A1", " 6.1 Screening")),
    "requirement": ("l_partkey", ("Rules shall be kept.", "The organization shall configure a time server.", "A policy on access shall exist.", None, "System log and audit trail.", "Staff shall document duties.")),
    "quote": ("l_orderkey", ("NTP synchronized: yes and RTC in local TZ: no", "Firewall = enabled", "nothing", None, "cache MFA enforced: on; Logging: active", "Short", "NOT_FOUND", "The same quote in several controls")),
    "seen_text": ("l_suppkey", ("NTP synchronized: no RTC in local TZ: no", "config Firewall: disabled", "MFA enforced: enabled Logging: off", None, "NTP synchronized: yes")),
    "grounding": ("l_linenumber", ("GROUNDED", "NOT_GROUNDED", "PROMPT_LEAK", None)),
    "confidence": ("l_linenumber", ("9", "high", None, "3.5", "10", "")),
    "file": ("l_partkey", ("a.log", "scan.xlsx", "policy.pdf", "screen1.png", "", None, "x.csv")),
    "content": ("l_suppkey", (
        "Employees must follow the policy.", "Last login: Mon from 10.0.0.1", "Nessus result: scan completed", "Approved by the board", "Visitor entry list", "Config parameter enabled", "Summary report of Q1", "", None, "Plain words here",
        "The review shall be held", "Event log exported", "badge access list", "ip: 10.0.0.1 | port: 22", "vulnerability assessment", "reviewed by the auditor",
    )),
}

SQL = (
    "v AS (SELECT l_orderkey AS report_id, l_linenumber AS pos, round(l_discount * 100, 1) AS score, "
    + ", ".join(f"{picked(number, values)} AS {name}" for name, (number, values) in VALUES.items())
    + ", l_shipdate AS seen, list_filter([CASE WHEN l_partkey % 3 = 0 THEN 'CVE-2020-' || (1000 + l_suppkey) END, CASE WHEN l_suppkey % 2 = 0 THEN 'cwe-79' END, CASE WHEN l_linenumber = 2 THEN ' cve-2019-0001' END, CASE WHEN l_partkey % 5 = 0 THEN 'CWE-1104' END], lambda x: x IS NOT NULL) AS ids FROM lineitem)"
)
WITH = f"WITH {SQL} "


def findings(t: Tables) -> DataFrame:
    number = lambda e: F.expr(e.replace("l_quantity::INT", "CAST(l_quantity AS INT)"))
    ids = F.filter(
        F.array(
            F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("CVE-2020-"), (1000 + F.col("l_suppkey")).cast("string"))), F.when(F.col("l_suppkey") % 2 == 0, "cwe-79"),
            F.when(F.col("l_linenumber") == 2, " cve-2019-0001"), F.when(F.col("l_partkey") % 5 == 0, "CWE-1104"),
        ),
        lambda x: x.isNotNull(),
    )
    return t("lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("pos"), F.round(F.col("l_discount") * 100, 1).alias("score"),
        *[pick(number(n), values).alias(name) for name, (n, values) in VALUES.items()], F.col("l_shipdate").alias("seen"), ids.alias("ids"),
    )
