"""Queries of catalogues, checklists, stores and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import labels as L
from ..functions import severity as S
from ..functions import text as X
from ..operators import checklists as K
from ..operators import relational as R
from ..operators import retrieval as V
from ..session import shared_dir
from ..sources import stores
from . import twin as T
from .registry import Tables, query
from .samples import WITH, findings

_c = F.col
_SPELL = lambda e: f"trim(regexp_replace(regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"

# Catalogues


@query("jon11_known_exploited", f"{WITH.rstrip()}, r AS (SELECT report_id, pos, coalesce(title, '') AS t, upper(trim(unnest(ids))) AS id, generate_subscripts(ids, 1) AS nth FROM v), k AS (SELECT 'CVE-2020-' || (1000 + s_suppkey) AS id FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'CVE-2019-0001') SELECT report_id, pos, t AS title, string_agg(id, ',' ORDER BY nth, id) AS known FROM (SELECT report_id, pos, t, id, min(nth) AS nth FROM r JOIN k USING (id) GROUP BY ALL) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Identifiers of a finding that are in the catalogue of exploited ones, in their order."""
    known = t("supplier").filter("s_suppkey % 2 = 1").select(F.concat(F.lit("CVE-2020-"), (1000 + _c("s_suppkey")).cast("string")).alias("id"))
    known = known.unionByName(known.sparkSession.range(1).select(F.lit("CVE-2019-0001").alias("id")))
    f = findings(t).select("report_id", "pos", F.coalesce("title", F.lit("")).alias("title"), "ids")
    refs = f.select("report_id", "pos", "title", F.posexplode("ids").alias("nth", "id")).withColumn("id", F.upper(F.trim("id")))
    hits = refs.join(known, "id").groupBy("report_id", "pos", "title").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("h"))
    return hits.select("report_id", "pos", "title", F.array_join(F.array_distinct(F.transform("h", lambda x: x["id"])), ",").alias("known"))


@query("jon12_control_knowledge", "SELECT s_suppkey, s_name || coalesce(' ' || q, '') AS asked FROM supplier LEFT JOIN (SELECT p_partkey AS k, string_agg(p_type, ' ' ORDER BY p_type) AS q FROM part WHERE p_size > 10 GROUP BY 1) ON k = s_suppkey")
def _(t: Tables) -> DataFrame:
    """Controls with the questions that the knowledge of their code adds."""
    more = t("part").filter("p_size > 10").groupBy(_c("p_partkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("p_type")), " ").alias("q"))
    return t("supplier").join(more, _c("s_suppkey") == _c("k"), "left").select("s_suppkey", F.concat("s_name", F.coalesce(F.concat(F.lit(" "), "q"), F.lit(""))).alias("asked"))


_CATALOG = (("5.15 Access control", "Access rules"), ("8.17", "Clocks"), ("7.2", "Entry"), ("A1", "Availability"))


@query("jon13_catalog_fallback", f"{WITH.rstrip()}, k(id, label) AS (VALUES {', '.join(f'({T.lit(a)}, {T.lit(b)})' for a, b in _CATALOG)}) SELECT report_id, pos, coalesce(a.label, b.label, 'unknown') AS label FROM v LEFT JOIN k a ON a.id = trim(clause) LEFT JOIN k b ON b.id = split_part(trim(clause), ' ', 1)")
def _(t: Tables) -> DataFrame:
    """The catalogue's label by the whole id of a finding, else by its first word."""
    f = findings(t).select("report_id", "pos", F.trim("clause").alias("id"))
    k = F.broadcast(f.sparkSession.createDataFrame(list(_CATALOG), "id string, label string"))  # a catalogue of four
    whole = f.join(k.withColumnRenamed("label", "a"), "id", "left")
    first = whole.withColumn("id", F.split_part(F.coalesce("id", F.lit("")), F.lit(" "), F.lit(1))).join(k.withColumnRenamed("label", "b"), "id", "left")
    return first.select("report_id", "pos", F.coalesce("a", "b", F.lit("unknown")).alias("label"))


_BOTH15 = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"
_PRODUCTS = ("internet banking", "apache web server", "apache", "vpn gateway", "graphql", "ssh")


@query("jon15_product_match", f"{WITH}SELECT report_id, pos, CASE {' '.join(f'WHEN {T.whole(_BOTH15, [p])} THEN {T.lit(p)}' for p in sorted(_PRODUCTS, key=lambda p: (-len(p), p)))} ELSE '' END AS product FROM v")
def _(t: Tables) -> DataFrame:
    """The product that a finding names, longer names first, with no letter or digit beside it."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    names = sorted(_PRODUCTS, key=lambda p: (-len(p), p))
    return findings(t).select("report_id", "pos", S.cases([(text.rlike(f"(?<![a-z0-9]){p}(?![a-z0-9])"), p) for p in names], "").alias("product"))


@query("jon16_chain_dependencies", "WITH n AS (SELECT s_suppkey AS chain, unnest(['Node ' || (s_suppkey % 7), 'nation ' || s_nationkey, 'Edge']) AS node FROM supplier), a AS (SELECT DISTINCT 'host NATION ' || n_nationkey AS asset FROM nation WHERE n_regionkey = 1 UNION SELECT 'node 3') SELECT chain, count(*) AS hits FROM n JOIN a ON contains(lower(node), lower(asset)) OR contains(lower(asset), lower(node)) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Nodes of dependency chains that name an asset or are named by one."""
    chains = t("supplier").select(_c("s_suppkey").alias("chain"), F.explode(F.array(F.concat(F.lit("Node "), (_c("s_suppkey") % 7).cast("string")), F.concat(F.lit("nation "), _c("s_nationkey").cast("string")), F.lit("Edge"))).alias("node"))
    assets = t("nation").filter("n_regionkey = 1").select(F.concat(F.lit("host NATION "), _c("n_nationkey").cast("string")).alias("asset")).distinct()
    assets = assets.unionByName(assets.sparkSession.range(1).select(F.lit("node 3").alias("asset")))
    return K.chained(chains, assets, "chain", "node", "asset").groupBy("chain").agg(F.count("*").alias("hits"))


# Checklists

_REFS = ("policy {} v1 -- p.2; [Published] Access.docx", "Policy {}", "some prose", None, "see Policy {} V1.pdf section 2\nmissing v2.1")


def _references(t: Tables) -> DataFrame:
    text = F.replace(T.pick(_c("c_custkey"), _REFS), F.lit("{}"), (_c("c_custkey") % 200).cast("string"))
    return t("customer").select(_c("c_nationkey").alias("session"), _c("c_custkey").alias("row"), text.alias("cell"))


def _uploads(t: Tables) -> DataFrame:
    return t("supplier").select(_c("s_nationkey").alias("session"), _c("s_suppkey").alias("at"), F.format_string("Policy_%s V1.pdf", "s_suppkey").alias("name"))


_CLEAN = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_RESOLVED = rf"""WITH i AS (SELECT c_nationkey AS session, c_custkey AS row, replace({T.picked("c_custkey", _REFS)}, '{{}}', (c_custkey % 200)::VARCHAR) AS cell FROM customer),
p AS (SELECT session, row, list_filter(list_transform(string_split_regex(coalesce(cell, ''), '\s*;\s*|\n'), lambda x: regexp_replace({_CLEAN}, '^\[[^\]]+\]\s*', '')), lambda x: x <> '') AS xs FROM i),
q AS (SELECT session, row, unnest(CASE WHEN len(xs) > 0 THEN xs ELSE [''] END) AS reference, generate_subscripts(CASE WHEN len(xs) > 0 THEN xs ELSE [''] END, 1) - 1 AS nth FROM p),
u AS (SELECT s_nationkey AS session, s_suppkey AS spot, 'Policy_' || s_suppkey || ' V1.pdf' AS name, {_SPELL("'Policy_' || s_suppkey || ' V1.pdf'")} AS f, {_SPELL("'Policy_' || s_suppkey || ' V1'")} AS s FROM supplier),
h AS (SELECT q.session, row, nth, reference, name, spot, CASE WHEN r = s OR r = f THEN 1000 ELSE greatest(CASE WHEN contains(r, f) THEN length(f) WHEN contains(f, r) THEN length(r) ELSE 0 END, CASE WHEN contains(r, s) THEN length(s) WHEN contains(s, r) THEN length(r) ELSE 0 END) END AS n
  FROM (SELECT *, {_SPELL("reference")} AS r FROM q) q LEFT JOIN u ON u.session = q.session AND r <> ''),
b AS (SELECT session, row, nth, reference, CASE WHEN max(n) > 0 THEN arg_max(name, (n, -spot)) END AS file FROM h GROUP BY ALL),
k AS (SELECT * FROM b WHERE file IS NOT NULL OR regexp_matches(reference, '(?i)\.(?:docx?|pdf|xlsx?|csv|pptx?|txt|png|jpe?g|zip)\b') OR (length(reference) <= 80 AND regexp_matches(reference, '(?i)\bv[0-9]+(?:\.[0-9]+)+\b|\bp{{1,2}}\.\s*[0-9]|\bslides?\s+[0-9]|\bsection\b')))"""


def _resolved(t: Tables) -> DataFrame:
    return K.resolved(_references(t), _uploads(t), "session", "row", "cell", "name", "at")


@query("jon17_cited_files", f"{_RESOLVED} SELECT session, row, nth, reference, file FROM k")
def _(t: Tables) -> DataFrame:
    return _resolved(t)


@query("jon21_locked_files", f"{_RESOLVED}, f AS (SELECT session, row % 5 AS control, coalesce(file, reference) AS f, min((row, nth)) AS spot FROM k GROUP BY ALL) SELECT session, control, string_agg(f, '|' ORDER BY spot) AS files FROM f GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    r = _resolved(t).select("session", (_c("row") % 5).alias("control"), F.struct("row", "nth").alias("at"), F.coalesce("file", "reference").alias("f"))
    return K.locked(r, "session", "control", "at", "f").select("session", "control", F.array_join("files", "|").alias("files"))


_OVERLAP = f"""WITH a AS (SELECT p_partkey, list_distinct(list_filter(string_split({_SPELL("p_type || ' ' || p_brand || ' supplier'")}, ' '), lambda w: length(w) > 2)) AS w FROM part),
b AS (SELECT s_suppkey, list_distinct(list_filter(string_split({_SPELL("s_name || ' brand economy ' || (s_suppkey % 9 + 10)")}, ' '), lambda w: length(w) > 2)) AS x FROM supplier),
c AS (SELECT p_partkey, s_suppkey, len(w) AS k, len(list_intersect(w, x)) AS overlap FROM a, b)
"""


def _controls(t: Tables) -> DataFrame:
    """A catalogue: all suppliers, each with a label."""
    return t("supplier").select(_c("s_suppkey").alias("control"), F.concat("s_name", F.lit(" brand economy "), (_c("s_suppkey") % 9 + 10).cast("string")).alias("label"))


@query("jon18_control_by_name", _OVERLAP + "SELECT p_partkey, s_suppkey AS control, overlap FROM c WHERE overlap >= CASE WHEN k <= 2 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY overlap DESC, s_suppkey) = 1")
def _(t: Tables) -> DataFrame:
    items = t("part").select("p_partkey", F.concat("p_type", F.lit(" "), "p_brand", F.lit(" supplier")).alias("text"))
    return K.overlaps(items, _controls(t).withColumn("at", _c("control")), "p_partkey", "text", "control", "label", "at")


@query("set04_word_overlap", f"SELECT doc_id, len(list_intersect(list_distinct(string_split({_SPELL('text')}, ' ')), ['this', 'that', 'the', 'was'])) AS shared FROM documents")
def _(t: Tables) -> DataFrame:
    words = F.split(X.alphanumeric(_c("text")), " ")
    return t("documents").select("doc_id", F.size(F.array_intersect(words, F.array(*map(F.lit, ("this", "that", "the", "was"))))).cast("long").alias("shared"))


_NAMES = tuple(L.STANDARDS)


@query("flt15_framework", f"WITH p AS (SELECT p_partkey, {T.picked('p_partkey', _NAMES[:5])} AS standard FROM part) SELECT p_partkey, standard FROM p WHERE standard = 'SOC2'")
def _(t: Tables) -> DataFrame:
    return K.narrowed(t("part").select("p_partkey", T.pick(_c("p_partkey"), _NAMES[:5]).alias("standard")), "standard", "the SOC 2 report")


@query("flt15_framework_unknown", f"SELECT p_partkey, {T.picked('p_partkey', _NAMES[:5])} AS standard FROM part")
def _(t: Tables) -> DataFrame:
    """A standard without controls leaves all of them."""
    return K.narrowed(t("part").select("p_partkey", T.pick(_c("p_partkey"), _NAMES[:5]).alias("standard")), "standard", "DPDP")


# Aggregates


@query("agg16_most_cores", "SELECT user_id, max(coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0)) AS cores FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.max(F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))).alias("cores"))


@query("agg25_repeat_occurrences", f"{WITH}SELECT plugin, asset, pos, count(*) AS n, min(report_id) AS first FROM v GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    """How often a rule found an algorithm on a line, and where first."""
    return findings(t).groupBy("plugin", "asset", "pos").agg(F.count("*").alias("n"), F.min("report_id").alias("first"))


_PHRASE = r"\b[a-z]{5,}(?:\s+[a-z]{4,}){1,3}\b"
_LOWT, _LOWD = "lower(coalesce(title, ''))", "lower(coalesce(description, '') || ' ' || coalesce(remediation, '') || ' ' || coalesce(title, ''))"


@query("agg31_scope_score", rf"{WITH}SELECT report_id, pos, 3 * len(list_filter(regexp_extract_all({_LOWT}, '{_PHRASE}'), lambda p: contains({_LOWD}, p))) + len(list_filter(list_distinct(regexp_extract_all({_LOWT}, '\b[a-z]{{7,}}\b')), lambda w: contains({_LOWD}, w))) AS score FROM v")
def _(t: Tables) -> DataFrame:
    """Three for each phrase of a control in the text, one for each long word."""
    low, text = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("description", "remediation", "title")]))
    inside = lambda p: F.size(F.filter(p, lambda x: text.contains(x)))
    phrases = F.regexp_extract_all(low, F.lit(_PHRASE), F.lit(0))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b[a-z]{7,}\b"), F.lit(0)))
    return findings(t).select("report_id", "pos", (3 * inside(phrases) + inside(words)).cast("long").alias("score"))


@query("prj03_wide_row", f"{WITH}SELECT report_id, pos, left(coalesce(target, ''), 20) AS asset, array_to_string(list_transform(ids, lambda x: upper(trim(x))), ', ') AS cves, coalesce(score, 0) AS score, coalesce(recorded, 'NON_COMPLIANT') AS result, 'Open' AS status FROM v")
def _(t: Tables) -> DataFrame:
    """A finding as the row that is stored: caps, joined lists, defaults."""
    return findings(t).select(
        "report_id", "pos", F.left(F.coalesce("target", F.lit("")), F.lit(20)).alias("asset"), F.array_join(F.transform("ids", lambda x: F.upper(F.trim(x))), ", ").alias("cves"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("recorded", F.lit("NON_COMPLIANT")).alias("result"), F.lit("Open").alias("status"),
    )


_KEY04 = "coalesce(plugin, '') || '|' || coalesce(target, '')"
_RANK04 = "CASE WHEN upper(coalesce(severity, '')) LIKE '%CRIT%' THEN 4 WHEN upper(coalesce(severity, '')) LIKE '%HIGH%' THEN 3 WHEN upper(coalesce(severity, '')) LIKE '%MED%' THEN 2 WHEN upper(coalesce(severity, '')) LIKE '%LOW%' THEN 1 ELSE 0 END"


@query("ded04_across_scans", f"{WITH.rstrip()}, f AS (SELECT report_id, pos, {_KEY04} AS k, {_RANK04} AS r FROM v), w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY report_id, k ORDER BY r DESC, pos) = 1) SELECT report_id, pos, k, r FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY report_id, pos) = 1")
def _(t: Tables) -> DataFrame:
    """The most severe of a key in each scan, then the first scan's of each key."""
    f = findings(t).select("report_id", "pos", F.concat_ws("|", F.coalesce("plugin", F.lit("")), F.coalesce("target", F.lit(""))).alias("k"), S.rank(S.normalised(_c("severity"))).alias("r"))
    worst = R.first_of(f, ["report_id", "k"], [-_c("r"), _c("pos")])
    return R.first_of(worst, ["k"], [_c("report_id"), _c("pos")]).select("report_id", "pos", "k", "r")


# Contexts

_SIM = "greatest(0, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]))"


@query("srt07_similar_chunks", f"WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT doc_id, round({_SIM}, 4) AS similarity FROM embeddings JOIN documents ON doc_id = vec_id, q WHERE source IS NOT NULL ORDER BY {_SIM} DESC, doc_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    """Chunks of the files at hand that are nearest to a question: vectors meet their chunks, then a distributed top-k."""
    q = t("embeddings").orderBy("vec_id").limit(1).select(_c("embedding").alias("e"))  # one query vector
    d = t("documents").filter("source IS NOT NULL").select("doc_id")
    near = t("embeddings").join(d, _c("vec_id") == _c("doc_id")).crossJoin(F.broadcast(q)).select("doc_id", F.greatest(F.lit(0.0), X.cosine(_c("embedding"), _c("e"))).alias("s"))
    return near.orderBy(F.desc("s"), "doc_id").limit(5).select("doc_id", F.round("s", 4).alias("similarity"))


@query("jon02_vector_hits", f"WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id, {_SIM} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 160) SELECT doc_id, source, round(s, 4) AS similarity FROM h JOIN documents ON doc_id = vec_id WHERE lang = 'en'")
def _(t: Tables) -> DataFrame:
    """The nearest vectors, joined with the chunks that are in scope."""
    q = t("embeddings").orderBy("vec_id").limit(1).select(_c("embedding").alias("e"))
    hits = t("embeddings").crossJoin(F.broadcast(q)).select("vec_id", F.greatest(F.lit(0.0), X.cosine(_c("embedding"), _c("e"))).alias("s")).orderBy(F.desc("s"), "vec_id").limit(160)
    return hits.join(t("documents").filter("lang = 'en'"), _c("vec_id") == _c("doc_id")).select("doc_id", "source", F.round("s", 4).alias("similarity"))


@query("srt06_document_order", "WITH o AS (SELECT source, row_number() OVER (ORDER BY source DESC) - 1 AS spot FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source > 'c')) SELECT doc_id, row_number() OVER (ORDER BY coalesce(spot, 999), doc_id) AS place FROM documents LEFT JOIN o USING (source) ORDER BY place LIMIT 500")
def _(t: Tables) -> DataFrame:
    """Chunks in the order of the files that were named; files without a place come last."""
    names = t("documents").filter("source IS NOT NULL AND source > 'c'").select("source").distinct()
    order = names.withColumn("at", F.row_number().over(W.orderBy(F.desc("source"))) - 1)
    rows = t("documents").select("doc_id", "source").join(F.broadcast(order) if names.count() <= K.BROADCAST else order, "source", "left")
    top = rows.orderBy(F.coalesce("at", F.lit(999)), "doc_id").limit(500)
    return top.select("doc_id", F.row_number().over(W.orderBy(F.coalesce("at", F.lit(999)), "doc_id")).cast("long").alias("place"))


@query("txt22_paragraphs_once", r"""WITH p AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents), q AS (SELECT *, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS k FROM p)
  SELECT doc_id, nth, md5(x) AS digest FROM q WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY doc_id, nth) = 1""")
def _(t: Tables) -> DataFrame:
    """Paragraphs of the chosen parents, each where it comes first among those of its file."""
    p = t("documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    p = p.withColumn("k", F.trim(F.regexp_replace(F.lower("x"), r"\s+", " "))).filter("k <> ''").select("source", F.md5("k").alias("k"), "doc_id", (_c("i") + 1).alias("nth"), F.md5("x").alias("digest"))
    return R.first_of(p, ["source", "k"], [_c("doc_id"), _c("nth")]).select("doc_id", "nth", "digest")


@query("txt21_roles", "SELECT doc_id, CASE WHEN source IN ('src5', 'src6') THEN 'DUAL_ROLE_CONFLICT' WHEN source IN ('src0', 'src1', 'src2') THEN 'POLICY' WHEN source IN ('src7', 'src8') THEN 'EVIDENCE' ELSE 'SHARED_CONTEXT' END AS role, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) // 4 AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    """Chunks by the part of their file: policy, evidence, both (a conflict) or neither. Contexts are put together from these
    rows in order of their ids, under a budget, so no role's texts meet in one task."""
    lists = [F.array(*map(F.lit, x)) for x in (("src0", "src1", "src2", "src5", "src6"), ("src5", "src6", "src7", "src8"))]
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", L.file_role(F.coalesce("source", F.lit("")), *lists).alias("role"), F.md5(text).alias("digest"), X.token_estimate(text).alias("tokens"))


@query("txt21_role_contexts", "WITH r AS (SELECT doc_id, CASE WHEN source IN ('src5', 'src6') THEN 'DUAL_ROLE_CONFLICT' WHEN source IN ('src0', 'src1', 'src2') THEN 'POLICY' WHEN source IN ('src7', 'src8') THEN 'EVIDENCE' ELSE 'SHARED_CONTEXT' END AS role, coalesce(text, '') AS x FROM documents), s AS (SELECT *, sum(length(x) // 4) OVER (PARTITION BY role ORDER BY doc_id) AS run FROM r) SELECT role, count(*) AS n, md5(string_agg(x, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM s WHERE run <= 6000 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The context of each role: whole chunks in order as long as 6,000 tokens hold them. Chunks take one token at least or
    none, and of those of a role only the first that can fit are ranked, so a task sends few."""
    lists = [F.array(*map(F.lit, x)) for x in (("src0", "src1", "src2", "src5", "src6"), ("src5", "src6", "src7", "src8"))]
    r = t("documents").select("doc_id", L.file_role(F.coalesce("source", F.lit("")), *lists).alias("role"), F.coalesce("text", F.lit("")).alias("x"))
    sums = r.groupBy("role", F.floor(F.col("doc_id") / 64).alias("block")).agg(F.sum(X.token_estimate(_c("x"))).alias("k"))
    before = F.sum("k").over(W.partitionBy("role").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    fits = sums.withColumn("run", F.coalesce(before, F.lit(0))).filter("run <= 6000").select("role", "block", "run")
    rows = r.withColumn("block", F.floor(F.col("doc_id") / 64)).join(fits, ["role", "block"])
    run = F.col("run") + F.sum(X.token_estimate(_c("x"))).over(W.partitionBy("role", "block").orderBy("doc_id"))
    chosen = rows.withColumn("total", run).filter("total <= 6000").groupBy("role").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "x"))).alias("xs"))
    return chosen.select("role", "n", F.md5(F.array_join(F.transform("xs", lambda s: s["x"]), "\n\n")).alias("digest"))


@query("txt23_chat_context", f"WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT label, vec_id, {_SIM} AS s FROM embeddings, q), v AS (SELECT label, vec_id, s AS score FROM s WHERE s > 0), k AS (SELECT label, vec_id, (vec_id % 7)::DOUBLE AS score FROM embeddings WHERE label NOT IN (SELECT label FROM v)) SELECT label, vec_id FROM (SELECT * FROM v UNION ALL SELECT * FROM k) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5")
def _(t: Tables) -> DataFrame:
    """The five nearest chunks of each session; a session without any similarity falls back to counts of words."""
    q = t("embeddings").orderBy("vec_id").limit(1).select(_c("embedding").alias("e"))
    s = t("embeddings").crossJoin(F.broadcast(q)).select("label", "vec_id", F.greatest(F.lit(0.0), X.cosine(_c("embedding"), _c("e"))).alias("score"))
    near = s.filter("score > 0")
    rest = s.join(near.select("label").distinct(), "label", "left_anti").withColumn("score", (_c("vec_id") % 7).cast("double"))
    return R.newest_per(near.unionByName(rest), ["label"], [F.desc("score"), _c("vec_id")], 5).select("label", "vec_id")


@query("jon10_import_anti_join", "SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.turn = 0 AND coalesce(d.text, '') = coalesce(c.text, '') AND coalesce(d.role, '') = coalesce(c.role, ''))")
def _(t: Tables) -> DataFrame:
    """Rows that aren't known by text and role; digests meet, not texts."""
    key = F.md5(F.concat_ws("\x01", F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))))
    c = t("conversations").select("conv_id", "turn", key.alias("k"))
    return c.join(c.filter("turn = 0").select("k"), "k", "left_anti").select("conv_id", "turn")


# Stores: each query writes a table twice in the folder that the cluster shares and reads it back


def _folder(rows: DataFrame, name: str) -> str:
    import uuid

    spark = rows.sparkSession  # below the application's folder, which session.clear deletes
    return f"{shared_dir(spark)}/attestor/{spark.sparkContext.applicationId}/stores/{name}-{uuid.uuid4().hex}"


@query("snk01_insert", "SELECT o_orderkey, replace(o_orderstatus, 'P', '') AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", F.replace("o_orderstatus", F.lit("P"), F.lit("\0")).alias("status"), F.col("o_orderstatus").alias("s"))
    path = _folder(o, "findings")
    stores.insert(o.filter("o_orderkey % 2 = 0").drop("s"), path, ["o_orderkey"])
    stores.insert(o.filter("s = 'F'").drop("s"), path, ["o_orderkey"])
    return o.sparkSession.read.parquet(path)


@query("snk02_replace_scope", "SELECT doc_id, coalesce(lang, '') AS lang, lang = 'en' AS replaced FROM documents WHERE lang IS NOT NULL AND lang <> 'de' AND (lang <> 'en' OR doc_id % 2 = 0)")
def _(t: Tables) -> DataFrame:
    d = t("documents").filter("lang IS NOT NULL").select("doc_id", "lang")
    path = _folder(d, "chunks")
    stores.replace_scope(d.withColumn("replaced", F.lit(False)), path, ["lang"])
    # German documents are named, but have no rows any more
    named = d.filter("lang IN ('en', 'de')").select("lang").distinct()
    stores.replace_scope(d.filter("lang = 'en' AND doc_id % 2 = 0").withColumn("replaced", F.lit(True)), path, ["lang"], named)
    return d.sparkSession.read.parquet(path).select("doc_id", "lang", "replaced")


@query("snk04_upsert_newest", "SELECT user_id, event_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ORDER BY ts DESC, event_id LIMIT 60")
def _(t: Tables) -> DataFrame:
    """Telemetry by session, merged in two halves and cut to its newest rows."""
    e = t("events").select("user_id", "event_id", "value", "ts")
    both = stores.merged(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"])
    return stores.newest(both, [F.desc("ts"), _c("event_id")], 60).select("user_id", "event_id", "value")


@query("snk08_json_round_trip", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE turn > 0")
def _(t: Tables) -> DataFrame:
    """All rows are exported as JSON; those that are known aren't imported again."""
    c = t("conversations").select("conv_id", "turn", "role", "text")
    path = _folder(c, "feedback")
    stores.export_json(c, path)
    return stores.imported(c.filter("turn = 0"), path, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("snk05_csv_export", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def _(t: Tables) -> DataFrame:
    c = t("conversations").select("conv_id", "turn", "role", "text")
    path = _folder(c, "export")
    stores.export_csv(c, path)
    back = c.sparkSession.read.option("header", "true").option("escape", '"').option("multiLine", "true").schema(c.schema).csv(path)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("snk09_copy_changed", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey < 3")
def _(t: Tables) -> DataFrame:
    """Of two tables that were copied, the one that changed is copied again."""
    n, r = t("nation"), t("region")
    path = _folder(n, "replica")
    stores.copy_changed({"nation": n, "region": r}, path)
    changed = stores.copy_changed({"nation": n, "region": r.filter("r_regionkey < 3")}, path)
    assert changed == ["region"]
    read = n.sparkSession.read.parquet
    return read(f"{path}/nation").agg(F.lit("nation").alias("name"), F.count("*").alias("n")).unionByName(read(f"{path}/region").agg(F.lit("region").alias("name"), F.count("*").alias("n")))


@query("hlp42_controls_edited", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey % 5 = 0 AS is_deleted FROM part WHERE p_partkey % 7 <> 0")
def _(t: Tables) -> DataFrame:
    """Custom controls after updates (every third), soft deletes (every fifth) and hard deletes (every seventh)."""
    p = t("part").select("p_partkey", _c("p_name").alias("name"), F.lit(False).alias("is_deleted"), F.lit(0).alias("version"))
    edits = p.filter("p_partkey % 3 = 0").select("p_partkey", F.upper("name").alias("name"), "is_deleted", F.lit(1).alias("version"))
    now = stores.merged(p, edits, ["p_partkey"], ["version"])
    now = now.withColumn("is_deleted", _c("p_partkey") % 5 == 0)
    return now.join(p.filter("p_partkey % 7 = 0").select("p_partkey"), "p_partkey", "left_anti").select("p_partkey", "name", "is_deleted")
