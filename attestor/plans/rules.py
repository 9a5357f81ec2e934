"""Queries of the classification, scoring and verdict rules over sample findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules as C
from ..functions import severity as S
from ..functions import text as X
from ..functions import verdicts as V
from . import twin as T
from .registry import Tables, query
from .samples import WITH, findings

_KEY = ("report_id", "pos")
_c = F.col


def _rule(name: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """A query that adds columns to the keys of each finding; `sql` gives the same columns."""

    @query(name, f"{WITH}SELECT report_id, pos, {sql} FROM v")
    def _(t: Tables) -> DataFrame:
        return findings(t).select(*_KEY, *[c.alias(n) for n, c in columns().items()])


def _low(*parts: str) -> str:
    return "lower(" + " || ' ' || ".join(f"coalesce({p}, '')" for p in parts) + ")"


_w = lambda m, table, e="vv": "CASE regexp_extract(" + e + f", '(?:^|[/(]){m.upper()}:([A-Z])(?:$|[/)])', 1) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"
_S = "regexp_extract(vv, '(?:^|[/(])S:([A-Z])(?:$|[/)])', 1)"
_CVSS = f"""WITH {WITH.removeprefix("WITH ").rstrip()}, u AS (SELECT report_id, pos, upper(trim(coalesce(vector, ''))) AS vv FROM v),
m AS (SELECT *, {_S} AS s, {_w("AV", C.V3["AV"])} AS av, {_w("AC", C.V3["AC"])} AS ac, {_w("UI", C.V3["UI"])} AS ui, {_w("C", C.V3["C"])} AS c, {_w("I", C.V3["I"])} AS i, {_w("A", C.V3["A"])} AS a,
  CASE WHEN {_S} = 'C' THEN {_w("PR", C.V3["PR changed"])} ELSE {_w("PR", C.V3["PR"])} END AS pr, {_w("AV", C.V2["AV"])} AS av2, {_w("AC", C.V2["AC"])} AS ac2, {_w("Au", C.V2["Au"])} AS au2,
  {_w("C", C.V2["C"])} AS c2, {_w("I", C.V2["I"])} AS i2, {_w("A", C.V2["A"])} AS a2 FROM u),
n AS (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss, 10.41::DOUBLE * (1 - (1 - c2) * (1 - i2) * (1 - a2)) AS harm FROM m),
o AS (SELECT *, CASE WHEN s = 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS effect, 8.22::DOUBLE * av * ac * pr * ui AS ease FROM n)
SELECT report_id, pos, coalesce(CASE WHEN vv LIKE 'CVSS:3%' AND s IN ('U', 'C') THEN CASE WHEN effect <= 0 THEN 0 WHEN effect IS NULL OR ease IS NULL THEN NULL
    ELSE ceil(round(least(10, CASE WHEN s = 'C' THEN 1.08::DOUBLE * (effect + ease) ELSE effect + ease END) * 100000) / 10000) / 10 END END,
  CASE WHEN vv NOT LIKE 'CVSS:%' THEN round((0.6::DOUBLE * harm + 0.4::DOUBLE * (20 * av2 * ac2 * au2) - 1.5::DOUBLE) * CASE WHEN harm = 0 THEN 0 ELSE 1.176::DOUBLE END, 1) END,
  CASE WHEN regexp_matches(vv, 'AV:[NALP]') AND regexp_matches(vv, 'AC:[LH]') THEN round(least(10, 10 * coalesce(av, 0.55::DOUBLE) * coalesce(ac, 0.44::DOUBLE)), 1) END) AS base FROM o"""


@query("scl02_cvss", _CVSS)
def _(t: Tables) -> DataFrame:
    return findings(t).select(*_KEY, C.cvss(_c("vector")).alias("base"))


_CLEAN = "list_transform(ids, lambda x: upper(trim(x)))"
_CVES = f"list_sort(list_distinct(list_filter({_CLEAN}, lambda x: starts_with(x, 'CVE-'))))"
_TRIM = lambda c: f"trim(coalesce({c}, ''))"
_rule(
    "scl03_dedup_key",
    f"""substr(CASE WHEN len({_CVES}) > 0 THEN 'CVE:' || array_to_string({_CVES}, ':') WHEN {_TRIM("plugin")} NOT IN ('', 'burp-pdf', 'burp-issue', 'generic')
      THEN coalesce(nullif(lower({_TRIM("tool")}), ''), 'generic') || ':' || {_TRIM("plugin")} ELSE coalesce(nullif(lower({_TRIM("tool")}), ''), 'generic') || ':' || coalesce(nullif(lower({_TRIM("title")}), ''), 'unnamed') END
      || '|target:' || regexp_replace(lower({_TRIM("target")}), '(:[0-9]+/(?:tcp|udp|sctp))\\s*\\([^)]*\\)$', '\\1'), 1, 480) AS key""",
    lambda: dict(key=S.dedup_key(_c("ids"), _c("tool"), _c("plugin"), _c("title"), _c("target"))),
)
_rule(
    "scl04_class_key",
    f"""CASE WHEN len(ids) > 0 THEN 'cve:' || array_to_string(list_sort({_CLEAN}), ',') WHEN {_TRIM("plugin")} <> '' THEN 'plugin:' || {_TRIM("plugin")}
      ELSE 'title:' || lower({_TRIM("title")}) END || '|target:' || lower({_TRIM("target")}) AS key""",
    lambda: dict(key=S.class_key(_c("ids"), _c("plugin"), _c("title"), _c("target"))),
)


def _class(number: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} IN ({', '.join(T.lit(str(x)) for x in n)}) THEN '{k}'" for k, n in C.CWES.items()) + " END"


_CODE = f"coalesce({_class("regexp_replace(coalesce(cwe, ''), '[^0-9]', '', 'g')")}, {T.first(_low('title'), C.OWASP_WORDS, None)}, {T.first(_low('title', 'description'), C.OWASP_WORDS, None)}, 'A05')"
_rule("scl05_owasp", "CASE " + _CODE + " " + " ".join(f"WHEN '{k}' THEN {T.lit(f'{k}:2021 {v}')}" for k, v in C.OWASP.items()) + " END AS owasp", lambda: dict(owasp=C.owasp(_c("cwe"), _c("title"), _c("description"))))
_rule("jon14_weakness_class", f"{_class("regexp_replace(coalesce(cwe, ''), '[^0-9]', '', 'g')")} AS class", lambda: dict(**{"class": C.class_of(_c("cwe"))}))
_TDE = _low("title", "description", "evidence")
_rule("scl06_vapt_control", f"{T.first(_TDE, C.VAPT_WORDS, 'VAPT-3')} AS control", lambda: dict(control=C.vapt_control(_c("title"), _c("description"), _c("evidence"))))
_rule("scl07_pqc_control", f"{T.first(_TDE, C.PQC_WORDS, 'PQC-1')} AS control", lambda: dict(control=C.pqc_control(_c("title"), _c("description"), _c("evidence"))))
_CAT = f"coalesce({_class(f"regexp_extract({_TDE}, 'cwe-([0-9]+)', 1)")}, list_filter(list_transform(list_filter(ids, lambda x: starts_with(upper(x), 'CWE-')), lambda x: {_class("regexp_replace(x, '[^0-9]', '', 'g')")}), lambda c: c IS NOT NULL)[1], {T.first(_low('title'), C.OWASP_WORDS, None)}, {T.first(_low('title', 'description'), C.OWASP_WORDS, None)}, 'A05')"
_rule("scl08_risk_category", "CASE " + _CAT + " " + " ".join(f"WHEN '{k}' THEN {T.lit(v)}" for k, v in C.CATEGORIES.items()) + " END AS category", lambda: dict(category=C.risk_category(_c("title"), _c("description"), _c("evidence"), _c("ids"))))
_METRIC = lambda i: f"CASE upper(regexp_extract(coalesce(vector, ''), '(?i)\\bC:([NLH])/I:([NLH])/A:([NLH])\\b', {i})) WHEN 'N' THEN 'NONE' WHEN 'L' THEN 'LOW' WHEN 'H' THEN 'HIGH' END"
_rule("hlp13_vector_impact", f"{_METRIC(1)} AS c, {_METRIC(2)} AS i, {_METRIC(3)} AS a", lambda: dict(**dict(zip("cia", C.vector_impact(_c("vector")), strict=True))))
_WORDS = lambda k: f"CASE WHEN {T.whole('low', C.IMPACT_WORDS[k, 'HIGH'])} THEN 'HIGH' WHEN " + (T.has("low", C.SLOW) if k == "A" else T.whole("low", C.IMPACT_WORDS[k, "MEDIUM"])) + " THEN 'MEDIUM' ELSE 'NONE' END"
_NAMED = "split_part(w, '@', 1)"
_HOST = "rtrim(split_part(w, '@', 2), '.')"
_ADDRESS = (
    f"len(string_split(w, '@')) = 2 AND regexp_full_match({_NAMED}, '[a-z0-9][a-z0-9_.+-]+') AND regexp_matches({_HOST}, '^[^.].*[.][a-z][a-z]+$')"
    f" AND NOT regexp_matches({_NAMED}, '^(?:{'|'.join(C.SCHEMES)}|[0-9a-f]{{8}})|(?:^|-)sha[0-9]')"
)
_SPACED = r"regexp_replace(lower(txt), '\s+', ' ', 'g')"
_PERSONAL = (
    f"({T.has(_SPACED, C.PERSONAL_WORDS)} OR len(list_filter(string_split_regex(lower(txt), {T.lit(C.APART)}), lambda w: {_ADDRESS})) > 0"
    rf" OR regexp_matches(lower(txt), '(?:{'|'.join(C.CREDENTIALS)})\s*[:=]\s*\S'))"
)
_PRIO = T.first(_low("asset", "target", "title"), C.PRIORITY_WORDS, "")
_IMPACTS = f"""{WITH.rstrip()}, x AS (SELECT report_id, pos, severity, quantum, exposure, {_PRIO} AS prio, coalesce(quantum, '') <> '' AS post, {_METRIC(1)} AS vc, {_METRIC(2)} AS vi, {_METRIC(3)} AS va,
  coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || CASE WHEN coalesce(quantum, '') <> '' THEN coalesce(evidence, '') ELSE '' END || ' ' || coalesce(remediation, '') AS txt FROM v),
y AS (SELECT *, lower(txt) AS low, NOT post AND {_PERSONAL} AS pii FROM x),
z AS (SELECT *, CASE WHEN pii THEN '{C.EXPOSED}' WHEN post THEN 'HIGH' ELSE coalesce(vc, {_WORDS("C")}) END AS c, CASE WHEN post THEN 'HIGH' ELSE coalesce(vi, {_WORDS("I")}) END AS i, coalesce(va, {_WORDS("A")}) AS a FROM y),
w AS (SELECT report_id, pos, quantum, exposure, prio, pii AS is_pii, CASE WHEN vc IS NULL AND c = 'NONE' AND i = 'NONE' AND a = 'NONE' AND coalesce(severity, '') <> '' AND NOT contains(upper(severity), 'INFO') THEN 'Not determined - requires auditor assessment'
  ELSE 'C:' || c || ' | I:' || i || ' | A:' || a END AS cia FROM z)
"""
_CIA = _IMPACTS + "SELECT report_id, pos, is_pii, cia FROM w"


def _impact() -> Column:
    return C.impact(_c("title"), _c("description"), _c("evidence"), _c("remediation"), _c("vector"), _c("severity"), _c("quantum"))


@query("scl09_impact", _CIA)
def _(t: Tables) -> DataFrame:
    return findings(t).select(*_KEY, _impact().alias("x")).select(*_KEY, "x.is_pii", "x.cia")


_LETTER = lambda x: f"CASE WHEN contains(upper(regexp_extract(cia, '(?:^|\\|)\\s*{x}:([^|]*)', 1)), 'HIGH') THEN 5 WHEN contains(upper(regexp_extract(cia, '(?:^|\\|)\\s*{x}:([^|]*)', 1)), 'MEDIUM') THEN 3 ELSE 1 END"


@query("scl12_letter_scores", f"SELECT report_id, pos, {_LETTER('C')} AS c, {_LETTER('I')} AS i, {_LETTER('A')} AS a FROM ({_CIA})")
def _(t: Tables) -> DataFrame:
    x = findings(t).select(*_KEY, _impact()["cia"].alias("cia"))
    return x.select(*_KEY, *[C.letter_score(_c("cia"), k).alias(k.lower()) for k in "CIA"])


_rule("scl16_business_priority", f"{_PRIO} AS priority", lambda: dict(priority=C.priority(F.lit(None).cast("string"), _c("asset"), _c("target"), _c("title"))))
_HARVEST = "CASE " + " ".join(f"WHEN upper(trim(coalesce(exposure, ''))) = '{e}' AND coalesce(quantum, '') = '{q}' THEN {n}" for (e, q), n in C.HARVEST.items()) + " ELSE 1 END"
_QV = "CASE quantum WHEN 'VULNERABLE' THEN 5 WHEN 'WEAK' THEN 3 ELSE 1 END"
_rule("scl14_quantum_scores", f"{_HARVEST} AS harvest, {_QV} AS quantum", lambda: dict(harvest=C.harvest_score(_c("exposure"), _c("quantum")), quantum=C.quantum_score(_c("quantum"))))
_FLOOR = lambda k, x, least: f"CASE prio {' '.join(f'WHEN {T.lit(p)} THEN {s[k]}' for p, s in C.PRIORITY_IMPACT.items())} ELSE greatest({least}, {_LETTER(x)}) END"
_SCORES = _IMPACTS.rstrip() + f", k AS (SELECT report_id, pos, quantum, exposure, {_FLOOR(0, 'C', 2)} AS c, {_FLOOR(1, 'I', 2)} AS i, {_FLOOR(2, 'A', 1)} AS a FROM w) "


def _scored(t: Tables) -> DataFrame:
    x = findings(t).withColumn("cia", _impact()["cia"]).withColumn("prio", C.priority(F.lit(None).cast("string"), _c("asset"), _c("target"), _c("title")))
    return x.withColumns(dict(zip(("c", "i", "a"), C.priority_scores(_c("prio"), _c("cia")), strict=True)))


@query("scl13_priority_scores", _SCORES + "SELECT report_id, pos, c, i, a FROM k")
def _(t: Tables) -> DataFrame:
    return _scored(t).select(*_KEY, "c", "i", "a")


@query("scl17_quantum_risk", _SCORES + f"SELECT report_id, pos, CASE WHEN quantum IN ('VULNERABLE', 'WEAK') AND pos <> 3 THEN 4 * (c + i + a + {_HARVEST} + {_QV}) WHEN pos = 3 THEN 50 END::INT AS risk FROM k")
def _(t: Tables) -> DataFrame:
    known = F.when(_c("pos") == 3, 50)
    return _scored(t).select(*_KEY, C.quantum_risk(_c("prio"), _c("cia"), _c("exposure"), _c("quantum"), known).alias("risk"))


# Verdicts

_IN = lambda c, words: f"{T.status(c)} IN ({', '.join(map(T.lit, words))})"
_VERDICT = f"CASE WHEN {_IN('status', V.ACCEPTING)} THEN 'COMPLIANT' WHEN {_IN('status', V.AFFIRMING + V.WORKFLOW)} THEN coalesce(nullif(upper(trim(recorded)), ''), 'NON_COMPLIANT') WHEN {_IN('status', ('CLOSED',))} THEN 'CLOSED' ELSE 'NON_COMPLIANT' END"
_PASSED = f"CASE WHEN {_IN('status', V.ACCEPTING)} THEN true WHEN {_IN('status', V.FAILING)} THEN false ELSE {T.status('recorded')} = 'COMPLIANT' END"
_rule("scl18_status", f"{T.status('status')} AS status, {_IN('status', V.ACCEPTING + V.AFFIRMING + V.WORKFLOW + V.FAILING)} AS known", lambda: dict(status=S.status(_c("status")), known=V.recognised(_c("status"))))
_rule("scl19_verdict", f"{_VERDICT} AS verdict", lambda: dict(verdict=V.verdict(_c("status"), _c("recorded"))))
_rule("scl20_passed", f"{_PASSED} AS passed", lambda: dict(passed=V.passed(_c("status"), _c("recorded"))))
_CLOSED = f"({_IN('status', ('CLOSED',))} OR ({_IN('status', V.AFFIRMING)} AND {T.status('recorded')} = 'CLOSED'))"
_rule("hlp29_closed", f"{_CLOSED} AS closed", lambda: dict(closed=V.closed(_c("status"), _c("recorded"))))
_UP = lambda c: f"upper(trim(coalesce({c}, '')))"
_FIT = lambda x, y, z: f"{_UP('policy_status')} = '{x}' AND {_UP('evidence_status')} = '{y}'" + (f" AND {_UP('assessment')} = '{z}'" if z else "")
_SIDE = lambda c, k: f"CASE WHEN {_UP(c)} IN ('LOW', 'MODERATE', 'HIGH') THEN {_UP(c)} " + " ".join(f"WHEN {_FIT(*f)} THEN '{pair[k]}'" for f, pair in V.DEFAULTS.items()) + " END"
_NIST = f"""{WITH.rstrip()}, x AS (SELECT report_id, pos, {_SIDE("likelihood", 0)} AS lh, {_SIDE("consequence", 1)} AS im, {_UP("status")} AS s, coalesce(recorded, '') AS f,
  ({" OR ".join(f"({_FIT(*f)})" for f in V.DEFAULTS)} OR ({_UP("likelihood")} IN ('LOW', 'MODERATE', 'HIGH') AND {_UP("consequence")} IN ('LOW', 'MODERATE', 'HIGH'))) AS known FROM v),
y AS (SELECT *, s IN ('COMPLIANT', 'FALSE_POSITIVE') OR f = 'COMPLIANT' AS free, CASE lh || '/' || im {" ".join(f"WHEN '{a}/{b}' THEN '{v}'" for (a, b), v in V.MATRIX.items())} END AS level FROM x)
SELECT report_id, pos, CASE WHEN known AND NOT free THEN lh ELSE 'N/A' END AS likelihood, CASE WHEN known AND NOT free THEN im ELSE 'N/A' END AS impact, CASE WHEN free THEN 'N/A' WHEN known THEN level ELSE 'UNDETERMINED' END AS level,
  CASE WHEN known AND NOT free THEN CASE level {" ".join(f"WHEN '{k}' THEN '{p}'" for k, p in V.PRIORITIES.items())} END ELSE 'N/A' END AS severity FROM y"""


@query("scl21_nist_risk", _NIST)
def _(t: Tables) -> DataFrame:
    risk = V.nist(_c("status"), _c("recorded"), _c("likelihood"), _c("consequence"), _c("policy_status"), _c("evidence_status"), _c("assessment"))
    return findings(t).select(*_KEY, risk.alias("r")).select(*_KEY, "r.*")


_TOKENS = "regexp_extract_all(coalesce(day, ''), '[0-9]+')"
_OK = lambda keep, text: f"(len(list_filter({_TOKENS}, lambda d: {keep})) = 0 OR len(list_filter({_TOKENS}, lambda d: {keep} AND contains({text}, d))) > 0)"
_GROUNDED = lambda text: f"(len({_TOKENS}) > 0 AND {text} <> '' AND {_OK('length(d) = 4', text)} AND {_OK('length(d) <= 2', text)})"
_STALE = lambda c: T.has(f"lower(coalesce({c}, ''))", V.STALE)
_BOTH = "lower(concat_ws(' ', source_text, quote))"
_DAYS = ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y", "%B %d, %Y", "%d %B %Y", "%b %d, %Y", "%d %b %Y", "%Y/%m/%d", "%d-%b-%Y", "%d.%m.%Y")
_MONTHS = ("%B %Y", "%b %Y", "%Y-%m", "%m/%Y", "%m-%Y", "%Y/%m")
_DATE = "coalesce(" + ", ".join(f"try_strptime(trim(day), '{f}')" for f in _DAYS) + ", last_day(coalesce(" + ", ".join(f"try_strptime(trim(day), '{f}')" for f in _MONTHS) + "))::TIMESTAMP + INTERVAL '86399 seconds')"
_rule("scl24_loose_dates", f"strftime({_DATE}, '%Y-%m-%d %H:%M:%S') AS day", lambda: dict(day=F.date_format(V.loose_date(_c("day")), "yyyy-MM-dd HH:mm:ss")))
_rule("scl25_date_grounding", f"{_GROUNDED("lower(coalesce(source_text, ''))")} AS grounded", lambda: dict(grounded=V.date_grounded(_c("day"), _c("source_text"))))
_rule(
    "scl22_freshness", f"CASE WHEN {_GROUNDED(_BOTH)} THEN trim(day) ELSE '' END AS day, CASE WHEN {_STALE('source_text')} THEN 'STALE' ELSE 'UNKNOWN' END AS freshness",
    lambda: dict(day=V.freshness(_c("day"), _c("source_text"), _c("quote"))["date"], freshness=V.freshness(_c("day"), _c("source_text"), _c("quote"))["freshness"]),
)
_AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"
_OTHER = "CASE WHEN pos % 2 = 0 THEN day END"
_VALID = f"{WITH.rstrip()}, x AS (SELECT report_id, pos, source_text, CASE WHEN pos % 2 = 0 AND {_GROUNDED('lower(coalesce(source_text, chr(0)))').replace('chr(0)', repr(''))} THEN {_DATE} END AS ends, CASE WHEN pos % 2 = 1 AND {_GROUNDED("lower(coalesce(source_text, ''))")} THEN {_DATE} END AS due FROM v) SELECT report_id, pos, CASE WHEN {_STALE('source_text')} OR ends < {_AS_OF} THEN 'EXPIRED' WHEN ends IS NOT NULL THEN 'CURRENT' WHEN due < {_AS_OF} THEN 'REVIEW_OVERDUE' WHEN due IS NOT NULL THEN 'CURRENT' ELSE 'UNKNOWN' END AS validity FROM x"


@query("scl23_validity", _VALID)
def _(t: Tables) -> DataFrame:
    f = findings(t)
    even, odd = F.when(_c("pos") % 2 == 0, _c("day")), F.when(_c("pos") % 2 == 1, _c("day"))
    return f.select(*_KEY, V.validity(even, odd, _c("source_text"), F.lit(None).cast("string"), F.expr(_AS_OF)).alias("validity"))


_REQ = "lower(coalesce(requirement, '') || ' ' || coalesce(title, ''))"
_rule(
    "scl31_policy_required", f"CASE WHEN {T.has(_REQ, V.POLICY_WORDS)} THEN true WHEN {T.has(_REQ, V.TECHNICAL_WORDS)} THEN false ELSE regexp_extract(coalesce(clause, ''), '^\\s*([0-9]+)\\.', 1) IN ('5', '6', '7') END AS required",
    lambda: dict(required=V.policy_required(_c("requirement"), _c("clause"), _c("title"))),
)
_rule("hlp37_confidence", "coalesce(try_cast(regexp_extract(trim(coalesce(confidence, '')), '^[+-]?[0-9]+$') AS INT), 10) AS confidence", lambda: dict(confidence=F.coalesce(F.regexp_extract(F.trim(F.coalesce("confidence", F.lit(""))), "^[+-]?[0-9]+$", 0).try_cast("int"), F.lit(10))))
_FLAT = lambda c: rf"string_split_regex(lower(regexp_replace({c}, '\s+', ' ', 'g')), '[:=]')"
_VALUES = "|".join((*X.YES, *X.NO, "n/a"))
#: (label, value) of each colon or equals sign that a known value follows; `p` is the text's parts and `i` the number of one.
_BEFORE = rf"CASE WHEN i > 1 THEN regexp_replace(p[i], '^ *(?:{_VALUES})\b', '') ELSE p[i] END"
_LABEL = rf"regexp_replace(trim(regexp_replace(translate(right(regexp_extract(rtrim({_BEFORE}), '[a-z /_-]*$'), 41), '/_-', '   '), ' +', ' ', 'g')), '^(?:(?:{'|'.join(X.GLUED)}) )+', '')"
_MEANT = f"CASE WHEN v IN ({', '.join(map(T.lit, X.YES))}) THEN 'yes' WHEN v IN ({', '.join(map(T.lit, X.NO))}) THEN 'no' ELSE v END"


def labelled(column: str, of: str = "v") -> str:
    parts = f"SELECT {column} AS txt, {_FLAT(column)} AS p, unnest(range(1, len({_FLAT(column)}))) AS i FROM (SELECT DISTINCT {column} FROM {of})"
    said = rf"SELECT txt, i, {_LABEL} AS label, regexp_extract(ltrim(p[i + 1]), '^({_VALUES})\b', 1) AS v FROM ({parts})"
    return f"SELECT txt, label, arg_min({_MEANT}, i) AS value FROM ({said}) WHERE v <> '' AND length(label) >= 3 GROUP BY 1, 2"


@query("scl28_contradictions", f"""{WITH.rstrip()}, a AS ({labelled("quote")}), b AS ({labelled("seen_text")}), c AS (SELECT a.txt AS q, b.txt AS s, string_agg(label, ',' ORDER BY label) AS fields FROM a JOIN b USING (label) WHERE a.value <> b.value GROUP BY 1, 2)
SELECT report_id, pos, coalesce(fields, '') AS fields FROM v LEFT JOIN c ON v.quote = c.q AND v.seen_text = c.s""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return findings(t).select(*_KEY, F.array_join(F.array_sort(X.contradictions(_c("quote"), _c("seen_text"))), ",").alias("fields"))


@query("val05_consistency", f"{WITH}SELECT report_id, pos, CASE WHEN recorded = 'COMPLIANT' AND coalesce(nullif(quote, ''), 'NOT_FOUND') = 'NOT_FOUND' THEN 'NON_COMPLIANT' ELSE coalesce(recorded, 'NON_COMPLIANT') END AS status FROM v")
def _(t: Tables) -> DataFrame:
    missing = F.coalesce(F.nullif("quote", F.lit("")), F.lit("NOT_FOUND")) == "NOT_FOUND"
    return findings(t).select(*_KEY, F.when((_c("recorded") == "COMPLIANT") & missing, "NON_COMPLIANT").otherwise(F.coalesce("recorded", F.lit("NON_COMPLIANT"))).alias("status"))


# Reports


@query("agg07_quantum_histogram", f"{WITH}SELECT report_id, count(*) FILTER (quantum = 'VULNERABLE') AS vulnerable, count(*) FILTER (quantum = 'WEAK') AS weak, count(*) FILTER (quantum = 'SAFE') AS safe FROM v GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return findings(t).groupBy("report_id").agg(*[F.count_if(_c("quantum") == q).alias(q.lower()) for q in ("VULNERABLE", "WEAK", "SAFE")])


_NAME = f"CASE WHEN upper(coalesce(severity, '')) LIKE '%CRIT%' THEN 'CRITICAL' WHEN upper(coalesce(severity, '')) LIKE '%HIGH%' THEN 'HIGH' WHEN upper(coalesce(severity, '')) LIKE '%MED%' THEN 'MEDIUM' WHEN upper(coalesce(severity, '')) LIKE '%LOW%' THEN 'LOW' ELSE 'INFO' END"
_RANK = f"CASE {_NAME} WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END"


@query("agg10_overall", f"{WITH.rstrip()}, o AS (SELECT report_id, {_NAME} AS sev, {_RANK} AS rank, CASE WHEN score > 0 THEN score END AS score FROM v WHERE NOT {_CLOSED}), r AS (SELECT DISTINCT report_id FROM v), w AS (SELECT *, max(rank) OVER (PARTITION BY report_id) AS top FROM o) SELECT report_id, coalesce(max(sev), '-') AS severity, max(score) AS score FROM r LEFT JOIN (SELECT * FROM w WHERE rank = top) USING (report_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The worst severity of open findings and the highest score among those; "-" where none is open."""
    sev = S.normalised(_c("severity"))
    score = F.when(_c("score") > 0, _c("score"))
    # the greatest (rank, score) holds both; a severity without any score sorts below one with a score
    best = F.max(F.when(~V.closed(_c("status"), _c("recorded")), F.struct(S.rank(sev).alias("rank"), score.alias("score"), sev.alias("sev"))))
    return findings(t).groupBy("report_id").agg(best.alias("b")).select("report_id", F.coalesce("b.sev", F.lit("-")).alias("severity"), F.col("b.score").alias("score"))


_NOTE = r"\s[\[(][^\])]*(?:[\])]|$)"


@query("agg11_scope_targets", f"{WITH}SELECT report_id, array_to_string(list_sort(list_distinct(list(x))), '|') AS targets FROM (SELECT report_id, unnest(string_split_regex(regexp_replace(target, {T.lit(_NOTE)}, ' ', 'g'), '[,;\\s]+')) AS x FROM v) WHERE x <> '' AND lower(x) NOT IN ('n/a', 'none', 'unknown', '—', '-') AND x[1] NOT IN ('[', '(') AND x[-1] NOT IN (']', ')') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = findings(t).select("report_id", F.explode(F.split(S.without_notes(_c("target")), r"[,;\s]+")).alias("x"))
    x = x.filter((_c("x") != "") & ~F.lower("x").isin("n/a", "none", "unknown", "—", "-") & ~F.left("x", F.lit(1)).isin("[", "(") & ~F.right("x", F.lit(1)).isin("]", ")"))
    return x.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_set("x")), "|").alias("targets"))


@query("agg12_tools_in_order", f"{WITH.rstrip()}, g AS (SELECT report_id, trim(tool) AS tool, min(pos) AS p FROM v WHERE lower(trim(coalesce(tool, ''))) NOT IN ('', 'vapt engine', 'vapt', 'unknown', 'none') GROUP BY 1, 2) SELECT report_id, array_to_string(list(tool ORDER BY p, tool), ',') AS tools FROM g GROUP BY 1")
def _(t: Tables) -> DataFrame:
    named = ~F.lower(F.trim(F.coalesce("tool", F.lit("")))).isin("", "vapt engine", "vapt", "unknown", "none")
    firsts = findings(t).filter(named).groupBy("report_id", F.trim("tool").alias("tool")).agg(F.min("pos").alias("p"))
    return firsts.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "tool"))), lambda s: s["tool"]), ",").alias("tools"))


@query("agg19_compliance_score", f"{WITH}SELECT report_id, floor(count(*) FILTER ({_VERDICT} = 'COMPLIANT') / count(*) * 100)::INT AS score FROM v WHERE NOT {_IN('status', V.WORKFLOW)} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """By the verdicts that stand after review; findings that were thrown out don't count."""
    f = findings(t).filter(~V.thrown_out(_c("status")))
    return f.groupBy("report_id").agg(S.percent(F.count_if(V.verdict(_c("status"), _c("recorded")) == "COMPLIANT"), F.count("*")).alias("score"))


@query("agg20_real_accuracy", f"{WITH}SELECT report_id, count(*) AS total, count(*) FILTER (recorded = 'COMPLIANT' AND grounding = 'GROUNDED') AS grounded, count(*) FILTER (recorded = 'NON_COMPLIANT') AS failed, count(*) FILTER (grounding IN ('NOT_GROUNDED', 'PROMPT_LEAK')) AS invented, round(count(*) FILTER (recorded = 'NON_COMPLIANT' OR (recorded = 'COMPLIANT' AND grounding = 'GROUNDED')) / count(*) * 100, 1) AS accuracy FROM v GROUP BY 1")
def _(t: Tables) -> DataFrame:
    good, bad = (_c("recorded") == "COMPLIANT") & (_c("grounding") == "GROUNDED"), _c("recorded") == "NON_COMPLIANT"
    return findings(t).groupBy("report_id").agg(
        F.count("*").alias("total"), F.count_if(good).alias("grounded"), F.count_if(bad).alias("failed"),
        F.count_if(_c("grounding").isin("NOT_GROUNDED", "PROMPT_LEAK")).alias("invented"), F.round(F.count_if(good | bad) / F.count("*") * 100, 1).alias("accuracy"),
    )


@query("agg23_shared_advice", f"{WITH}SELECT report_id, pos, first_value(remediation) OVER w AS advice, first_value(pos) OVER w AS asked FROM v WINDOW w AS (PARTITION BY report_id, lower(trim(coalesce(title, ''))) ORDER BY pos, coalesce(remediation, '') ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(t: Tables) -> DataFrame:
    """One representative of each kind of finding in a report is asked about; all of its kind take over the answer."""
    f = findings(t).withColumn("kind", F.lower(F.trim(F.coalesce("title", F.lit("")))))
    asked = f.groupBy("report_id", "kind").agg(F.min_by(F.struct("pos", "remediation"), F.struct("pos", F.coalesce("remediation", F.lit("")))).alias("a"))
    return f.select("report_id", "kind", "pos").join(asked, ["report_id", "kind"]).select("report_id", "pos", F.col("a.remediation").alias("advice"), F.col("a.pos").alias("asked"))


_ORDER = f"CASE WHEN regexp_matches(upper(coalesce(severity, '')), 'CRITICAL|P1|^9\\.|^10\\.') THEN 1 WHEN regexp_matches(upper(coalesce(severity, '')), 'HIGH|P2|^[78]\\.') THEN 2 WHEN regexp_matches(upper(coalesce(severity, '')), 'MEDIUM|P3|^[456]\\.') THEN 3 WHEN regexp_matches(upper(coalesce(severity, '')), 'LOW|P4|^[0-3]\\.') THEN 4 ELSE 5 END"


@query("srt03_severity_order", f"{WITH}SELECT report_id, pos, row_number() OVER (PARTITION BY report_id ORDER BY {_ORDER}, upper(coalesce(clause, '')), pos) AS place FROM v")
def _(t: Tables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("report_id").orderBy(S.severity_place(_c("severity")), F.upper(F.coalesce("clause", F.lit(""))), "pos"))
    return findings(t).select("report_id", "pos", place.cast("long").alias("place"))


_WEB = "(lower(coalesce(tool, '')) IN ('burp suite', 'burp') OR contains(lower(coalesce(target, '')), 'http'))"


@query("srt04_technical_order", f"{WITH}SELECT report_id, pos, row_number() OVER (PARTITION BY report_id ORDER BY {_RANK} DESC, score DESC, {_WEB} DESC, pos) AS place FROM v")
def _(t: Tables) -> DataFrame:
    web = F.lower(F.coalesce("tool", F.lit(""))).isin("burp suite", "burp") | F.lower(F.coalesce("target", F.lit(""))).contains("http")
    order = [S.rank(S.normalised(_c("severity"))).desc(), F.desc("score"), web.desc(), F.asc("pos")]
    return findings(t).select("report_id", "pos", F.row_number().over(W.partitionBy("report_id").orderBy(*order)).cast("long").alias("place"))


# Suppressions

_TARGET = "CASE WHEN contains(k, '|target:') THEN lower(trim(string_split(k, '|target:')[-1])) ELSE '' END"
_KEYS = f"{WITH.rstrip()}, k AS (SELECT report_id, pos, status, title, seen, 'x:' || coalesce(plugin, '') || '|target:' || coalesce(target, '') AS k FROM v)"
_PLACE = ", ".join(map(T.lit, V.PLACEHOLDERS))


def _keyed(t: Tables) -> DataFrame:
    return findings(t).withColumn("k", F.concat(F.lit("x:"), F.coalesce("plugin", F.lit("")), F.lit("|target:"), F.coalesce("target", F.lit(""))))


@query("flt12_placeholder_target", f"{_KEYS} SELECT report_id, pos FROM k WHERE {_TARGET} NOT IN ({_PLACE})")
def _(t: Tables) -> DataFrame:
    return _keyed(t).filter(V.suppressible(_c("k"))).select("report_id", "pos")


_RECORD = f"SELECT k, min(report_id * 10 + pos) AS first, count(*) AS n FROM k WHERE {_TARGET} NOT IN ({_PLACE}) AND {_IN('status', V.WORKFLOW)} GROUP BY 1"


def decisions(keyed: DataFrame) -> DataFrame:
    """(k, first, n): keys that were thrown out, with the finding where that happened first."""
    out = keyed.filter(V.suppressible(_c("k")) & V.thrown_out(_c("status")))
    return out.groupBy("k").agg(F.min(F.col("report_id") * 10 + F.col("pos")).alias("first"), F.count("*").alias("n"))


@query("sup01_suppressions", f"{_KEYS} {_RECORD}")
def _(t: Tables) -> DataFrame:
    return decisions(_keyed(t))


@query("jon08_suppressions", f"{_KEYS}, s AS ({_RECORD}) SELECT report_id, pos, CASE WHEN s.k IS NOT NULL THEN 'Rejected' ELSE status END AS status, s.k IS NOT NULL AS carried FROM k LEFT JOIN s USING (k)")
def _(t: Tables) -> DataFrame:
    """Decisions are carried onto all findings of their key."""
    k = _keyed(t)
    return k.join(decisions(k).select("k", F.lit(True).alias("hit")), "k", "left").select("report_id", "pos", F.when(_c("hit"), "Rejected").otherwise(_c("status")).alias("status"), F.coalesce("hit", F.lit(False)).alias("carried"))


_QUOTE = "lower(trim(trim(coalesce(nullif(quote, ''), 'NOT_FOUND')), '\"''“”'))"


@query("ded05_duplicate_citations", f"{WITH.rstrip()}, q AS (SELECT report_id, pos, {_QUOTE} AS q FROM v WHERE coalesce(recorded, 'NON_COMPLIANT') NOT IN ('Out of Scope', 'NON_COMPLIANT', 'Non-Compliant')) SELECT report_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY report_id, q) AS n FROM q WHERE q NOT IN ('', 'not_found') AND length(q) >= 15) WHERE n >= 2")
def _(t: Tables) -> DataFrame:
    """Findings of a report that cite the same quote of 15 characters or more; failing ones don't count."""
    quote = F.lower(F.btrim(F.trim(F.coalesce(F.nullif("quote", F.lit("")), F.lit("NOT_FOUND"))), F.lit("\"'“”")))
    passing = ~F.coalesce("recorded", F.lit("NON_COMPLIANT")).isin("Out of Scope", "NON_COMPLIANT", "Non-Compliant")
    q = findings(t).filter(passing).select("report_id", "pos", quote.alias("q")).filter((_c("q") != "not_found") & (F.length("q") >= 15))
    many = q.groupBy("report_id", "q").agg(F.count("*").alias("n")).filter("n >= 2")
    return q.join(many, ["report_id", "q"]).select("report_id", "pos")
