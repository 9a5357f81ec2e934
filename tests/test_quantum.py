"""The scanner for quantum readiness against a plain scan with one loop over rules and one over places."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from attestor.functions import crypto as C
from attestor.operators import scanning
from attestor.plans import quantum
from attestor.session import table

SF = "/root/testdata/sf0.001"


def plain_hits(content: str) -> list[tuple]:
    """(line number, start, rule, text found) of one file."""
    out = []
    for at, line in enumerate(re.split("\r\n?|\n", content), 1):
        if not line.strip() or line.lstrip().lower().startswith(C.COMMENTS):
            continue
        taken: list[tuple[int, int]] = []
        places = [(m.start(), m.end(), t.rule, m.group()) for t in C.TERMS for m in re.finditer(t.pattern, line, re.IGNORECASE | re.ASCII)]
        parts = re.split("[=:]", line, maxsplit=1)
        if len(parts) == 2:
            key, value = parts[0].strip(" \t").lower(), parts[1].lstrip("\"' \t").upper()
            for s in C.SETTINGS:
                fits = not value.strip() if s.empty else value.startswith(s.values) if s.values else bool(value.strip())
                if key in s.keys and fits:
                    places.append((len(line) - len(line.lstrip(" \t")), len(line), s.rule, line))
        for start, end, rule, hit in places:
            if all(end <= x or start >= y for x, y in taken):
                taken.append((start, end))
                out.append((at, start, rule, hit))
    return out


def shown(rule: str, hit: str) -> tuple[str, str]:
    r = next(r for r in (*C.TERMS, *C.SETTINGS) if r.rule == rule)
    numbers = re.findall("[0-9]+", hit)
    name = hit if rule == "pqc-hybrid-kem" else r.shown.replace("#", numbers[-1] if numbers else "")
    return name, r.severity if isinstance(r.severity, str) else r.severity[1] if int(numbers[-1]) <= r.severity[0] else r.severity[2]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["file"]: r["content"] for r in quantum.files(lambda n: table(spark, SF, n)).collect()}


def test_ordered_rules(spark, texts):
    got = Counter((r["file"], r["at"], r["start"], r["rule"], r["name"], r["severity"]) for r in quantum.scanning.by_rules(scanning.lines(quantum.files(lambda n: table(spark, SF, n)))).collect())
    assert got == Counter((f, at, start, rule, *shown(rule, hit)) for f, c in texts.items() for at, start, rule, hit in plain_hits(c))
    assert len({rule for _, _, _, rule, *_ in got}) >= 35


def plain_scan(content: str) -> Counter:
    lines = re.split("\r\n?|\n", content)
    found: dict[tuple, list[int]] = {}
    for at, _, rule, hit in plain_hits(content):
        found.setdefault((rule, *shown(rule, hit), lines[at - 1].strip(" ")), []).append(at)
    out = [(min(a), rule, name, sev, len(a), line) for (rule, name, sev, line), a in found.items()]
    names = [name.upper() for _, _, name, *_ in out]
    seen: dict[tuple, tuple] = {}
    for at, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().lower().startswith(C.COMMENTS):
            continue
        codes = [("oid", o) for o in re.findall(r"(?<![0-9.])[0-9]+(?:\.[0-9]+){3,}(?![0-9])", line)]
        codes += [("suite", re.sub(r"0x|[,\s]", "", m.lower()).upper()) for m in re.findall(r"(?i)0x[0-9a-f]{2}[,\s]+0x[0-9a-f]{2}(?![0-9a-f])|0x[0-9a-f]{4}", line)]
        codes += [("word", w) for w in re.split("[^a-z0-9_-]+", line.lower())]
        for k in codes:
            seen.setdefault(k, (at, line.strip(" ")))
    table_ = {(k, c): rest for k, c, *rest in C.CODES}
    for kind in ("oid", "suite", "word"):
        for (_, code), (at, line) in sorted(((k, v) for k, v in seen.items() if k[0] == kind and k in table_), key=lambda kv: (kv[1][0], kv[0][1])):
            name, status, category, severity = table_[kind, code]
            key = code if kind == "word" else name.removeprefix("TLS_").split("_")[0] if kind == "suite" else name.split(" ")[0]
            if any(key.upper() in n for n in names):
                continue
            names.append(name.upper())
            ready = status == "SAFE" and (kind == "word" or "PQC" in category.upper())
            out.append((at, "pqc-dictionary" if ready else f"dictionary-{kind}", name, severity, 1, line))
    if any(r[1] in C.READY for r in out):
        out = [r for r in out if r[1] not in C.GAPS]
    return Counter(out)


def test_scan(spark, texts):
    got: dict[str, Counter] = {}
    for r in scanning.scan(quantum.files(lambda n: table(spark, SF, n))).collect():
        got.setdefault(r["file"], Counter())[r["at"], r["rule"], r["name"], r["severity"], r["n"], r["evidence"]] += 1
    for f, c in texts.items():
        assert got.get(f, Counter()) == plain_scan(c), f


# Names that must or must not be found in a text, each with the rules that take it.
CASES = {
    "RSA 2048": ["rsa-sized"], "RSA4096": ["rsa-sized"], "RSA": ["rsa-generic"], "ML-DSA-65": ["dilithium"], "SLH-DSA": ["sphincs"], "FN-DSA": ["falcon"], "DSA": ["dsa"], "ECDSA": ["ecdsa"],
    "X25519MLKEM768": ["pqc-hybrid-kem"], "X25519": ["ecc-x25519"], "SecP256r1MLKEM768": ["pqc-hybrid-kem"], "X25519Kyber768Draft00": ["pqc-hybrid-kem"], "ECDHE-RSA-AES256-GCM-SHA384": ["rsa-generic", "ecdhe", "aes256-gcm", "sha384"],
    "TLS_AES_256_GCM_SHA384": ["aes256-gcm"], "TLSv1": ["tls10"], "TLSv1.0": ["tls10"], "TLSv1.1": ["tls11"], "TLSv1.2": [], "TLSv1.3": [], "SHA1withRSA": ["sha1"], "SHA1234": [], "SHA-3": ["sha3"], "SHA-384": ["sha384"],
    "TripleDES": ["3des"], "DES": ["des"], "descriptive": [], "ssl v3": ["sslv3"], "DH Group 2": ["dh-group"], "modp3072": ["ipsec-modp"], "SPHINCS+-SHA2": ["sphincs"], "# RSA": [], "; RSA": [], "ssl_cert = x": ["db-ssl-cert"],
    "ssl_cert =": [], "tls:": ["k8s-ingress-tls"], "tls: yes": [], "min_tls_version: 1.2": ["db-tls12"], "": [], "ssl_key = rsa.pem": ["rsa-generic"],
}


def test_names(spark):
    docs = spark.createDataFrame([(k, k) for k in CASES] + [(None, None), ("none", None)], "file string, content string")
    got: dict[str, set] = {}
    for r in scanning.by_rules(scanning.lines(docs)).collect():
        got.setdefault(r["file"], set()).add(r["rule"])
    assert {k: got.get(k, set()) for k in CASES} == {k: set(v) for k, v in CASES.items()}
    sized = {r["name"]: r["severity"] for r in scanning.by_rules(scanning.lines(docs)).collect()}
    assert (sized["RSA2048"], sized["RSA4096"], sized["Diffie-Hellman Group 2"], sized["DH modp3072"]) == ("CRITICAL", "HIGH", "CRITICAL", "HIGH")


def test_gaps_and_repeats(spark):
    docs = spark.createDataFrame(
        [("a", "ssl_cert = x\nRSA\nRSA\r\nRSA"), ("b", "ssl_cert = x\nuses ML-KEM"), ("c", "ssl_cert = x\nalg 2.16.840.1.101.3.4.4.2"), ("d", "ssl_cert = x\nhqc-128"), ("e", "ssl_cert = x\nAES-256")], "file string, content string"
    )
    got = Counter((r["file"], r["rule"], r["n"]) for r in scanning.scan(docs).collect())
    assert got == Counter([
        ("a", "db-ssl-cert", 1), ("a", "rsa-generic", 3), ("b", "kyber", 1), ("c", "pqc-dictionary", 1), ("d", "pqc-dictionary", 1), ("e", "db-ssl-cert", 1), ("e", "aes256", 1),
    ])
    assert scanning.scan(docs.filter("false")).count() == 0
