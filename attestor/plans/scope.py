"""Queries of scope detection and of reports whose tables list findings twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merging, scoping
from . import twin as T
from .registry import Tables, query

_c = F.col
SIGNALS = (("Access", "mfa"), ("Access", "password"), ("Access", "least privilege"), ("People", "nda"), ("People", "screening"), ("Physical", "visitor"), ("Physical", "cctv"), ("Technology", "malware"), ("Technology", "ntp"), ("Supplier", "vendor"), ("Supplier", "sla"))
CONTROLS = (("Access", "5.15"), ("Access", "5.17"), ("People", "6.1"), ("People", "6.6"), ("Physical", "7.2"), ("Technology", "8.7"), ("Technology", "8.17"), ("Supplier", "5.19"), ("Supplier", "5.20"))
MASTER, EXPANDS = ("security policy", "isms policy"), ("Access", "People", "Technology")
SAID = (None, "Each vendor signs an NDA.", "The agenda of the board", "This Security Policy holds for all.", "Visitors show a badge; CCTV is on", "passwords and MFA", "slam and tntp", "", "anti-malware runs, NTP too", "no word of it")


def _literal(t: Tables, rows, schema: str) -> DataFrame:
    return t("documents").sparkSession.createDataFrame(list(rows), schema)


def _docs(t: Tables) -> DataFrame:
    """Each document after a sentence that may name a kind, with the vector of its number."""
    d = t("documents").select(_c("doc_id").alias("id"), F.concat_ws(" ", T.pick(_c("doc_id"), SAID), "text").alias("text"))
    return d.join(t("embeddings").select(_c("vec_id").alias("id"), _c("embedding").alias("vector")), "id", "left")


def _kinds(t: Tables) -> DataFrame:
    described = t("embeddings").filter("vec_id < 5").select(T.pick(_c("vec_id"), tuple(sorted({k for k, _ in SIGNALS}))).alias("kind"), _c("embedding").cast("array<double>").alias("vector"))
    return scoping.kinds(_docs(t), _literal(t, SIGNALS, "kind string, keyword string"), described, MASTER, EXPANDS)


_KIND = tuple(sorted({k for k, _ in SIGNALS}))
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_LIKE = f"CASE WHEN {_DOT('e.embedding', 'e.embedding')} * {_DOT('k.embedding', 'k.embedding')} > 0 THEN {_DOT('e.embedding', 'k.embedding')} / (sqrt({_DOT('e.embedding', 'e.embedding')}) * sqrt({_DOT('k.embedding', 'k.embedding')})) ELSE 0 END >= {scoping.LIKE}"
_NAMES = " OR ".join(
    f"(kind = {T.lit(k)} AND " + (f"regexp_matches(low, '(?:^|[^a-z0-9_]){w}(?:$|[^a-z0-9_])')" if len(w) <= scoping.SHORT else f"contains(low, {T.lit(w)})") + ")" for k, w in SIGNALS
)
_SCOPE = f"""WITH d AS (SELECT doc_id AS id, lower(concat_ws(' ', {T.picked('doc_id', SAID)}, text)) AS low FROM documents), k AS (SELECT {T.picked('vec_id', _KIND)} AS kind, embedding FROM embeddings WHERE vec_id < 5),
h AS (SELECT id, kind, 1 AS n FROM d, (SELECT DISTINCT kind FROM k) WHERE {_NAMES} UNION ALL SELECT d.id, k.kind, 2 FROM d JOIN embeddings e ON e.vec_id = d.id, k WHERE {_LIKE}
  UNION ALL SELECT id, unnest([{', '.join(map(T.lit, EXPANDS))}]), 3 FROM d WHERE {' OR '.join(f"contains(left(low, {scoping.HEAD}), {T.lit(w)})" for w in MASTER)}),
a AS (SELECT * FROM h UNION ALL SELECT id, kind, 4 FROM d, (SELECT DISTINCT kind FROM k) WHERE id NOT IN (SELECT id FROM h)),
g AS (SELECT id, kind, ['keyword', 'likeness', 'umbrella', 'all'][min(n)] AS why FROM a GROUP BY 1, 2)"""


@query("txt24_scope_kinds", f"{_SCOPE} SELECT * FROM g")
def _(t: Tables) -> DataFrame:
    """Kinds of policy that each document speaks of, and what tells it."""
    return _kinds(t)


@query("txt24_scope_controls", f"{_SCOPE}, m(kind, control) AS (VALUES {', '.join(f'({T.lit(k)}, {T.lit(c)})' for k, c in CONTROLS)}) SELECT DISTINCT id, control FROM g JOIN m USING (kind)")
def _(t: Tables) -> DataFrame:
    """The controls that follow from the kinds of each document."""
    return scoping.controls(_kinds(t), _literal(t, CONTROLS, "kind string, control string"))


_SET = ('{"kind": "Access", "keywords": ["Vault ", " "], "generated": ["kms"]}', '{"kind": " ", "keywords": ["badge"]}', "not json", None, '{"keywords": null, "generated": ["Badge", "cctv"]}')
_CUSTOM = f"x AS (SELECT 'C' || p_partkey AS control, {T.picked('p_partkey', _SET)} AS s FROM part WHERE p_size % 2 = 0), y AS (SELECT control, CASE WHEN json_valid(s) THEN s ELSE '{{}}' END AS s FROM x), z AS (SELECT control, coalesce(nullif(trim(s ->> 'kind'), ''), 'General') AS kind, s FROM y)"


def _custom(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t("part").select(F.concat(F.lit("C"), _c("p_partkey").cast("string")).alias("control"), T.pick(_c("p_partkey"), _SET).alias("settings"), (_c("p_size") % 2 == 0).alias("active"))
    return scoping.custom(p, "control", "settings", "active")


@query("hlp08_custom_signals", f"WITH {_CUSTOM} SELECT DISTINCT kind, lower(trim(w)) AS keyword FROM (SELECT kind, unnest(list_concat(coalesce(TRY_CAST(s -> 'keywords' AS VARCHAR[]), []), coalesce(TRY_CAST(s -> 'generated' AS VARCHAR[]), []))) AS w FROM z) WHERE trim(w) <> ''")
def _(t: Tables) -> DataFrame:
    """Keywords of the controls that auditors have added."""
    return _custom(t)[0]


@query("hlp08_custom_controls", f"WITH {_CUSTOM} SELECT kind, control FROM z")
def _(t: Tables) -> DataFrame:
    """The kinds of the controls that auditors have added."""
    return _custom(t)[1]


TITLES = ("SQL injection in the search field of the shop", "SQL injection in the search form of the portal", "Missing HttpOnly flag on session cookie", "Weak ciphers", "weak  ciphers.", "Outdated web server on the gateway host", None, "")


def report_rows(t: Tables) -> DataFrame:
    """Rows of two tables for each order: the summary names findings in full, the other cuts them short and adds the host."""
    k = _c("l_partkey") + _c("l_suppkey")
    title = T.pick(k, TITLES)
    short = (_c("l_linenumber") > 3) & (_c("l_partkey") % 3 > 0)
    host = T.pick(_c("l_suppkey"), (None, "10.0.0.1", "", "Web-1", "web-1"))
    nth = (_c("l_linenumber") * 100_000_000 + _c("l_partkey") * 10_000 + _c("l_suppkey")).cast("long")
    # rows of one place are told by numbers alone, before their texts are made
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nth.alias("nth")).dropDuplicates(["l_orderkey", "nth"])
    return rows.select(
        _c("l_orderkey").alias("report"), "nth", F.when(_c("l_linenumber") > 3, "more").otherwise("summary").alias("table"), F.when(short, F.left(title, 20 + F.pmod(_c("l_partkey"), F.lit(9)).cast("int"))).otherwise(title).alias("title"),
        T.pick(_c("l_orderkey"), ("HIGH", "MEDIUM")).alias("severity"), F.when(_c("l_suppkey") % 3 == 0, 7.5).when(_c("l_suppkey") % 3 == 1, 5.0).alias("score"), F.when(_c("l_linenumber") > 3, host).alias("target"),
        F.when(_c("l_partkey") % 2 == 0, "Fix it.").alias("remediation"), F.array(F.concat(F.lit("CVE-2024-"), (_c("l_suppkey") % 4).cast("string"))).alias("cves"), F.concat(F.lit("table\n\nrow "), _c("nth").cast("string")).alias("evidence"),
    )


@query("ded06_merged_tables")
def _(t: Tables) -> DataFrame:
    """Findings of reports whose tables are merged; tests compare with the rule over whole reports."""
    return merging.merged(report_rows(t))
