"""Names of cryptographic algorithms and settings as they are written in configurations, and where they stand in a line.

Names, their classes and severities are fixed values. They are written plainly: a blank in a name stands for a blank, a hyphen,
an underscore or nothing, # for a number. No letter, digit or underscore may stand beside a name unless its term says so.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


@dataclass(frozen=True)
class Term:
    """A rule: its names in text; `shown` names the finding, # being the number found. A number up to `limit` has the first
    severity of a pair, a greater one the second. `before` and `after` are characters that may not stand beside a name."""

    rule: str
    shown: str
    status: str
    category: str
    severity: str | tuple[int, str, str]
    names: tuple[str, ...]
    before: str = "A-Za-z0-9_"
    after: str = "A-Za-z0-9_"

    @property
    def pattern(self) -> str:
        spelled = "|".join("".join({" ": "[ \t_-]?", "#": "[0-9]+"}.get(c) or re.escape(c) for c in n) for n in self.names)
        return (f"(?<![{self.before}])" if self.before else "") + f"(?:{spelled})" + (f"(?![{self.after}])" if self.after else "")


@dataclass(frozen=True)
class Setting:
    """A rule for "key = value" or "key: value": keys in lower case, and how the value begins in upper case (any value without)."""

    rule: str
    shown: str
    status: str
    category: str
    severity: str
    keys: tuple[str, ...]
    values: tuple[str, ...] = ()
    empty: bool = False


_RSA, _DH, _ECC = "Asymmetric Encryption (RSA)", "Key Exchange (Diffie-Hellman)", "Elliptic Curve Cryptography (ECC)"
_KEM, _SIGN = "PQC Key Encapsulation (NIST-selected)", "PQC Digital Signature (NIST-selected)"
# Rules in their order; a place that one has taken is closed to those after it.
TERMS = (
    Term("rsa-sized", "RSA#", "VULNERABLE", _RSA, (3071, "CRITICAL", "HIGH"), ("RSA #", "default bits = #", "default bits=#")),
    Term("rsa-generic", "RSA (unspecified key size)", "VULNERABLE", _RSA, "CRITICAL", ("RSA",)),
    Term("dsa", "DSA", "VULNERABLE", "Asymmetric Digital Signature (DSA)", "CRITICAL", ("DSA",), before="A-Za-z0-9_-"),
    Term("dh-group", "Diffie-Hellman Group #", "VULNERABLE", _DH, (14, "CRITICAL", "HIGH"), ("DH Group #",)),
    Term("dhe", "DHE (Diffie-Hellman Ephemeral)", "VULNERABLE", _DH, "HIGH", ("DHE",)),
    Term("dh-generic", "Diffie-Hellman", "VULNERABLE", _DH, "HIGH", ("Diffie Hellman",)),
    Term("ecc-p256", "ECC P-256 / secp256r1", "VULNERABLE", _ECC, "HIGH", ("P-256", "secp256r1")),
    Term("ecc-p384", "ECC P-384 / secp384r1", "VULNERABLE", _ECC, "HIGH", ("P-384", "secp384r1")),
    Term("ecc-p521", "ECC P-521 / secp521r1", "VULNERABLE", _ECC, "HIGH", ("P-521", "secp521r1")),
    Term("ecc-secp256k1", "ECC secp256k1", "VULNERABLE", _ECC, "HIGH", ("secp256k1",)),
    Term("ecc-x25519", "Curve25519 / X25519", "VULNERABLE", _ECC, "HIGH", ("Curve25519", "X25519")),
    Term("ecc-ed25519", "Ed25519", "VULNERABLE", _ECC, "HIGH", ("Ed25519",)),
    Term("ecdhe", "ECDHE (Elliptic Curve Diffie-Hellman Ephemeral)", "VULNERABLE", "Key Exchange (Elliptic Curve)", "HIGH", ("ECDHE",)),
    Term("ecdsa", "ECDSA", "VULNERABLE", _ECC, "HIGH", ("ECDSA",)),
    Term("ecdh", "ECDH", "VULNERABLE", _ECC, "HIGH", ("ECDH",)),
    Term("ecc-generic", "ECC (generic elliptic-curve reference)", "VULNERABLE", _ECC, "HIGH", ("ECC",)),
    Term("md5", "MD5", "WEAK", "Hash Function", "HIGH", ("MD5",)),
    Term("sha1", "SHA-1", "WEAK", "Hash Function", "HIGH", ("SHA 1",), after="0-9"),
    Term("3des", "3DES / Triple DES", "WEAK", "Symmetric Cipher", "CRITICAL", ("3DES", "Triple DES")),
    Term("des", "DES", "WEAK", "Symmetric Cipher", "CRITICAL", ("DES",)),
    Term("rc4", "RC4", "WEAK", "Symmetric Cipher", "CRITICAL", ("RC4",)),
    Term("sslv2", "SSLv2", "WEAK", "Protocol Version", "CRITICAL", ("SSLv2", "SSL v2", "SSL 2")),
    Term("sslv3", "SSLv3", "WEAK", "Protocol Version", "CRITICAL", ("SSLv3", "SSL v3", "SSL 3")),
    Term("tls10", "TLS 1.0", "WEAK", "Protocol Version", "CRITICAL", ("TLSv1.0", "TLS v1.0", "TLS 1.0", "TLSv1", "TLS v1", "TLS 1"), after=".0-9"),
    Term("tls11", "TLS 1.1", "WEAK", "Protocol Version", "CRITICAL", ("TLSv1.1", "TLS v1.1", "TLS 1.1")),
    Term("cbc-mode", "CBC-mode cipher (non-AEAD)", "WEAK", "Cipher Mode", "MEDIUM", ("CBC",)),
    Term("aes256-gcm", "AES-256-GCM", "SAFE", "Symmetric Cipher (AEAD)", "INFO", ("AES 256 GCM",), before="A-Za-z0-9", after="A-Za-z0-9"),
    Term("aes256", "AES-256", "SAFE", "Symmetric Cipher", "INFO", ("AES 256",)),
    Term("aes128", "AES-128 (quantum-safe but AES-256 preferred)", "SAFE", "Symmetric Cipher", "INFO", ("AES 128",)),
    Term("sha384", "SHA-384", "SAFE", "Hash Function", "INFO", ("SHA 384",)),
    Term("sha512", "SHA-512", "SAFE", "Hash Function", "INFO", ("SHA 512",)),
    Term("sha256", "SHA-256 (acceptable minimum)", "SAFE", "Hash Function", "INFO", ("SHA 256",)),
    Term("sha3", "SHA-3", "SAFE", "Hash Function", "INFO", ("SHA 3",)),
    Term("pqc-hybrid-kem", "hybrid key exchange", "SAFE", "PQC Hybrid Key Exchange (NIST-selected, hybrid mode)", "INFO", tuple(
        f"{curve} {kem} #{draft}" for curve in ("X25519", "X448", "SecP256r1", "SecP384r1", "P256", "P384") for kem in ("MLKEM", "ML-KEM", "Kyber") for draft in ("", "Draft#"))),
    Term("kyber", "CRYSTALS-Kyber / ML-KEM", "SAFE", _KEM, "INFO", ("CRYSTALS Kyber", "ML KEM")),
    Term("dilithium", "CRYSTALS-Dilithium / ML-DSA", "SAFE", _SIGN, "INFO", ("CRYSTALS Dilithium", "ML DSA")),
    Term("sphincs", "SPHINCS+ / SLH-DSA", "SAFE", _SIGN, "INFO", ("SPHINCS+-SHA#", "SPHINCS-SHA#", "SPHINCS+", "SPHINCS", "SLH DSA"), after="A-Za-z0-9"),
    Term("falcon", "Falcon / FN-DSA", "SAFE", _SIGN, "INFO", ("Falcon", "FN DSA")),
    Term("chacha20", "ChaCha20-Poly1305", "SAFE", "Symmetric Cipher (AEAD)", "INFO", ("ChaCha20 Poly1305",), before="A-Za-z0-9", after="A-Za-z0-9"),
    Term("k8s-tls-secret", "Kubernetes TLS Secret", "VULNERABLE", "Container / Cloud TLS Configuration", "HIGH", ("kubernetes.io/tls",), before="", after=""),
    Term("ipsec-modp", "DH modp#", "VULNERABLE", _DH, (2048, "CRITICAL", "HIGH"), ("modp#",)),
    Term("gnutls-tls12", "TLSv1.2", "VULNERABLE", "Protocol Version", "HIGH", ("VERS-TLS1.2",), before="", after=""),
    Term("gnutls-tls10", "TLSv1.0", "WEAK", "Protocol Version", "CRITICAL", ("VERS-TLS1.0",), before="", after=""),
    Term("haproxy-dh-param", "DH #-bit", "VULNERABLE", _DH, (2048, "CRITICAL", "HIGH"), ("tune.ssl.default-dh-param #",), before="", after=""),
    Term("winreg-schannel-tls10", "TLSv1.0", "WEAK", "Protocol Version", "CRITICAL", ("SCHANNEL\\Protocols\\TLS 1.0",), before="", after=""),
    Term("winreg-schannel-tls12", "TLSv1.2", "VULNERABLE", "Protocol Version", "HIGH", ("SCHANNEL\\Protocols\\TLS 1.2",), before="", after=""),
)
_APP, _DB, _TLS12 = "Application TLS Configuration", "Database TLS Configuration", ("TLSV1.2", "TLS1.2", "1.2")
SETTINGS = (
    Setting("db-ssl-cert", "Database TLS Certificate", "VULNERABLE", _DB, "HIGH", ("ssl_cert", "ssl-cert")),
    Setting("db-ssl-key", "Database TLS Key", "VULNERABLE", _DB, "HIGH", ("ssl_key", "ssl-key")),
    Setting("db-tls12", "TLSv1.2", "VULNERABLE", "Protocol Version", "HIGH", ("tls_version", "tls-version", "tlsversion", "min_version", "min-version", "min_tls_version", "min-tls-version"), _TLS12),
    Setting("db-tls13-no-pqc", "TLSv1.3", "VULNERABLE", "Protocol Version", "MEDIUM", ("tls_version", "tls-version", "tlsversion"), ("TLSV1.3",)),
    Setting("springboot-ssl-enabled", "Spring Boot TLS", "VULNERABLE", _APP, "HIGH", ("server.ssl.enabled",), ("TRUE",)),
    Setting("java-keystore-pkcs12", "Java PKCS12 Keystore", "VULNERABLE", _APP, "HIGH", ("server.ssl.key-store-type", "server.ssl.key_store_type"), ("PKCS12",)),
    Setting("k8s-ingress-tls", "Kubernetes Ingress TLS", "VULNERABLE", "Container / Cloud TLS Configuration", "MEDIUM", ("tls",), (), empty=True),
    Setting("kafka-ssl-keystore", "Kafka Broker TLS", "VULNERABLE", _APP, "HIGH", ("ssl.keystore.location",)),
    Setting("kafka-ssl-keystore-type", "Kafka PKCS12 Keystore", "VULNERABLE", _APP, "HIGH", ("ssl.keystore.type",), ("JKS", "PKCS12")),
    Setting("kafka-ssl-protocol", "Kafka TLS", "VULNERABLE", _APP, "MEDIUM", ("ssl.protocol",), ("TLS",)),
    Setting("kafka-ssl-enabled-protocols", "TLSv1.2", "VULNERABLE", "Protocol Version", "HIGH", ("ssl.enabled.protocols",), _TLS12),
)
#: Rules that only say that nothing post-quantum is configured, and rules that say that something is.
GAPS = (
    "db-ssl-cert", "db-ssl-key", "db-tls13-no-pqc", "springboot-ssl-enabled", "java-keystore-pkcs12", "k8s-tls-secret", "k8s-ingress-tls", "kafka-ssl-keystore",
    "kafka-ssl-keystore-type", "kafka-ssl-protocol",
)
READY = ("kyber", "dilithium", "sphincs", "falcon", "pqc-hybrid-kem", "pqc-dictionary")
COMMENTS = ("#", "//", ";", "--", "!", "rem ", "<!--")
# Fixed values: (kind, code, name, status, category, severity) of public registries; larger ones are given as a table.
CODES = (
    ("oid", "1.2.840.113549.1.1.1", "RSA", "VULNERABLE", _RSA, "CRITICAL"), ("oid", "1.2.840.113549.1.1.11", "SHA256withRSA", "VULNERABLE", _RSA, "HIGH"),
    ("oid", "1.2.840.10040.4.1", "DSA", "VULNERABLE", "Asymmetric Digital Signature (DSA)", "CRITICAL"), ("oid", "1.2.840.10045.2.1", "EC Public Key", "VULNERABLE", _ECC, "HIGH"),
    ("oid", "1.2.840.10045.4.3.2", "ECDSA-with-SHA256", "VULNERABLE", _ECC, "HIGH"), ("oid", "1.3.101.112", "Ed25519", "VULNERABLE", _ECC, "HIGH"),
    ("oid", "2.16.840.1.101.3.4.4.2", "ML-KEM-768", "SAFE", "PQC KEM", "INFO"), ("oid", "2.16.840.1.101.3.4.3.18", "ML-DSA-65", "SAFE", "PQC Signature", "INFO"),
    ("suite", "1301", "TLS_AES_128_GCM_SHA256", "SAFE", "TLS 1.3", "INFO"), ("suite", "1302", "TLS_AES_256_GCM_SHA384", "SAFE", "TLS 1.3", "INFO"),
    ("suite", "002F", "TLS_RSA_WITH_AES_128_CBC_SHA", "VULNERABLE", _RSA, "CRITICAL"), ("suite", "C02F", "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", "VULNERABLE", "Key Exchange (Elliptic Curve)", "HIGH"),
    ("word", "bike-l1", "BIKE-L1", "SAFE", "", "INFO"), ("word", "frodokem-640-aes", "FrodoKEM-640-AES", "SAFE", "", "INFO"), ("word", "hqc-128", "HQC-128", "SAFE", "", "INFO"),
    ("word", "classic-mceliece-348864", "Classic-McEliece-348864", "SAFE", "", "INFO"), ("word", "mayo-1", "MAYO-1", "SAFE", "", "INFO"), ("word", "sidh", "SIDH", "VULNERABLE", "Broken KEM", "HIGH"),
)
_SPAN = "array<struct<rule:int,start:int,end:int,hit:string>>"


def is_comment(line: Column) -> Column:
    """One anchored pattern: a filter would make a lower-cased line again for each of the marks."""
    marks = "|".join(re.escape(c[:-1]) + "[ \t]" if c.endswith(" ") else re.escape(c) for c in COMMENTS)
    return line.rlike(rf"(?i)\A[ \t]*(?:{marks})")


#: Stands for a match while a line is cut.
_MARK = "\0"


def anchors(t: Term) -> list[str]:
    """Lower-case texts one of which stands in every match of a term: the longest plain run of each of its names."""
    return sorted({max(re.split("[ #]", n), key=len).lower() for n in t.names})


def _any_in(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _places(line: Column, rule: int, pattern: str) -> Column:
    """Where a pattern matches: what lies between the matches gives their places. A pattern is compiled once when it replaces,
    but for each line when it splits, so matches are replaced by a mark, at which the line is cut."""
    p = f"(?i){pattern}"
    gaps = F.when(line.contains(_MARK), F.split(line, p, -1)).otherwise(F.split(F.regexp_replace(line, p, _MARK), _MARK, -1))
    both = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(line, F.lit(p), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(F.lit(rule).alias("rule"), begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out")))

    return F.when(line.rlike(p), F.aggregate(both, start, add, lambda s: s["out"])).otherwise(F.array().cast(_SPAN))


def _set(line: Column, rule: int, s: Setting, key: Column, value: Column) -> Column:
    """The whole line, if its key and value are the setting."""
    fits = F.trim(value) == "" if s.empty else F.trim(value) != ""
    if s.values:
        fits = value.startswith(s.values[0])
        for v in s.values[1:]:
            fits = fits | value.startswith(v)
    first = F.length(line) - F.length(F.ltrim(F.translate(line, "\t", " ")))
    span = F.struct(F.lit(rule).alias("rule"), first.cast("int").alias("start"), F.length(line).alias("end"), line.alias("hit"))
    return F.when(key.isin(*s.keys) & fits, F.array(span)).otherwise(F.array().cast(_SPAN))


def _settings(line: Column, nth: int, settings: Sequence[Setting]) -> Column:
    """What settings find: key and value are made once for all, and a value only where the key is one of theirs."""
    none, keys = F.array().cast(_SPAN), sorted({k for s in settings for k in s.keys})

    def of(at: Column) -> Column:
        key = F.lower(F.trim(F.translate(F.left(line, at - 1), "\t", " ")))
        value = F.upper(F.ltrim(F.translate(F.substr(line, at + 1), "\"'\t", "   ")))
        found = lambda k: X.let(value, lambda v: F.concat(*[_set(line, nth + i, s, k, v) for i, s in enumerate(settings)]))
        return X.let(key, lambda k: F.when(k.isin(*keys), found(k)).otherwise(none))

    # the first of the two signs
    at = lambda: F.when(line.contains("=") | line.contains(":"), F.regexp_instr(line, F.lit("[=:]"))).otherwise(0)
    return X.let(at(), lambda n: F.when(n > 0, of(n)).otherwise(none))


def accepted(line: Column, terms: Sequence[Term], settings: Sequence[Setting]) -> Column:
    """The places of a line that rules take, in the order of the rules; a place that overlaps an earlier one is dropped. A
    term's pattern runs only where the lower-cased line holds one of its anchors: most rules find nothing in most lines."""
    none = F.array().cast(_SPAN)

    def found(low: Column) -> list[Column]:
        return [F.when(_any_in(low, anchors(t)), _places(line, i, t.pattern)).otherwise(none) for i, t in enumerate(terms)] + ([_settings(line, len(terms), settings)] if settings else [])

    def take(taken: Column, x: Column) -> Column:
        return F.when(F.exists(taken, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])), taken).otherwise(F.concat(taken, F.array(x)))

    places = X.let(F.lower(line), lambda low: F.concat(none, *found(low)))
    return F.aggregate(places, none, take)
