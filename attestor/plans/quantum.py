"""Queries of the scanner for quantum readiness, over configuration files whose lines the keys of line items pick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crypto as C
from ..operators import scanning
from . import twin as T
from .registry import Tables, query

LINES = (
    "ssl_ciphers ECDHE-RSA-AES256-GCM-SHA384:ECDHE-RSA-AES128-GCM-SHA256;  # legacy", "# ssl_ciphers RC4:3DES", "default_bits = 2048", "RSA 4096 key, RSA-2048 root, plain RSA", "ssl_ecdh_curve X25519MLKEM768:X25519;",
    "signature = ML-DSA-65 / SLH-DSA", "ike=aes256-sha256-modp2048", "tune.ssl.default-dh-param 4096", "ssl_protocols TLSv1 TLSv1.1 TLSv1.2;", "tls_version = 'TLSv1.2'", "tls_version = TLSv1.3", "ssl_cert = /etc/pki/server.pem",
    "server.ssl.enabled: true", "  tls:", "type: kubernetes.io/tls", "priority = NORMAL:-VERS-TLS1.0:+VERS-TLS1.2", "HKLM\\SYSTEM\\SCHANNEL\\Protocols\\TLS 1.0\\Server", "Certificate OID 1.2.840.113549.1.1.11 and 1.3.101.112",
    "cipher 0x13,0x01 offered, then 0xC02F", "kem: FrodoKEM-640-AES and hqc-128", "MD5 SHA1withRSA sha-1 SHA1234", "DH Group 14 and DH Group 19, Diffie-Hellman, DHE", "-- DES in a comment", "nothing of note here",
    "TLS_CHACHA20_POLY1305_SHA256 and TLS_AES_256_GCM_SHA384", "DSA ECDSA ML-DSA fn-dsa Falcon", "ssl.keystore.type = JKS", "ssl.enabled.protocols=TLSv1.2,TLSv1.3", "Triple-DES and DES-CBC, sslv3 SSL v2", "curve secp256r1, P-384 ECC ed25519 Curve25519",
    "alg 2.16.840.1.101.3.4.4.2 in use", "cipher=0x002F",
)
_FILES = f"SELECT 'conf-' || l_orderkey AS file, {T.picked('l_partkey + l_suppkey + l_linenumber', LINES)} AS line, l_linenumber AS n, l_partkey AS k FROM lineitem"


def files(t: Tables) -> DataFrame:
    """(file, content): one configuration file for each order."""
    rows = t("lineitem").select(
        F.concat(F.lit("conf-"), F.col("l_orderkey").cast("string")).alias("file"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), T.pick(F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber"), LINES).alias("line")).alias("x"),
    )
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("content"))


@query("txt12_ordered_rules")
def _(t: Tables) -> DataFrame:
    """Hits of ordered rules that exclude each other by place; tests compare them with a plain scan."""
    return scanning.by_rules(scanning.lines(files(t)))


@query("prs13_quantum_scan")
def _(t: Tables) -> DataFrame:
    """Findings of each file after rules, dictionaries and the gaps that post-quantum cryptography closes."""
    return scanning.scan(files(t))


_CODES = ", ".join(f"({', '.join(T.lit(v) for v in c)})" for c in C.CODES)
_NUMBERED = f'SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY n, k, line) AS "at" FROM ({_FILES})'
_SEEN = r"""SELECT file, "at", trim(line) AS evidence, 'oid' AS kind, unnest(regexp_extract_all(line, '[0-9]+(?:\.[0-9]+){3,}')) AS code FROM n
UNION ALL SELECT file, "at", trim(line), 'suite', upper(regexp_replace(lower(unnest(regexp_extract_all(line, '(?i)0x[0-9a-f]{2}[,\s]+0x[0-9a-f]{2}|0x[0-9a-f]{4}'))), '0x|[,\s]', '', 'g')) FROM n
UNION ALL SELECT file, "at", trim(line), 'word', unnest(string_split_regex(lower(line), '[^a-z0-9_-]+')) FROM n"""


@query("prs15_crypto_dictionaries", f"""WITH n AS (SELECT * FROM ({_NUMBERED}) WHERE trim(line) <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '--')), s AS ({_SEEN}), c(kind, code, name, status, category, severity) AS (VALUES {_CODES}),
j AS (SELECT *, row_number() OVER (PARTITION BY file, kind, code ORDER BY "at") AS nth FROM s JOIN c USING (kind, code)) SELECT file, kind, code, "at", evidence, name, status, category, severity FROM j WHERE nth = 1""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    """Identifiers, suite codes and names of registries, each where a file has it first."""
    f = files(t)
    codes = f.sparkSession.createDataFrame(list(C.CODES), "kind string, code string, name string, status string, category string, severity string")
    return scanning.by_codes(scanning.lines(f), codes)
