"""Queries over evidence texts: normal forms, chunks, ranking, duplicates, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import chunking as K
from ..operators import relational as R
from ..operators import retrieval as V
from ..session import written
from .registry import Tables, query

#: The query of the ranking examples: words and weights.
TERMS = {"the": 1.0, "that": 1.0, "thing": 2.0, "with": 1.0}
_NORMAL_OF = lambda e: rf"lower(trim(regexp_replace(translate(coalesce({e}, ''), '‘’“”', '\'\'\'\'\"\"'), '[\x20\x09-\x0D]+', ' ', 'g')))".replace("\\'", "'")
_NORMAL = _NORMAL_OF("text")
_ALNUM_OF = lambda e: f"trim(regexp_replace(regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"
_STRIP_OF = lambda e: rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"
_WORDS_OF = lambda e: rf"len(list_filter(string_split_regex({e}, '\s+'), lambda w: w <> ''))"
_SENTENCES_OF = lambda e: rf"list_filter(list_transform(string_split(regexp_replace({e}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP_OF('s')}), lambda s: {_WORDS_OF('s')} >= 4)"
_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_-]+'), lambda x: length(x) >= 3)"


@query("scl26_normal_text", f"SELECT doc_id, md5({_NORMAL}) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(X.normal(F.col("text")).cast("binary")).alias("digest"))


@query("scl27_alphanumeric", "SELECT doc_id, length(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.length(X.alphanumeric(F.col("text"))).cast("long").alias("n"))


@query("scl10_keyword_hit", "SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(?:^|[^a-z0-9])(?:this|from|was)(?:[^a-z0-9]|$)')")
def _(t: Tables) -> DataFrame:
    return t("documents").filter(X.word_hit(F.col("text"), ["this", "from", "was"])).select("doc_id")


_OCT = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_NET = rf"\b((?:{_OCT}\.){{2}}{_OCT})\.{_OCT}\b"
_MASKED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]{{2,}}', '[EMAIL REDACTED]', 'g'),
  '(?s)^(.*?){_NET}', '\1\2.xxx (IP masked)'), '{_NET}', '\1.xxx', 'g'), '(^|[^0-9]){X.PHONE}($|[^0-9])', '\1[PHONE REDACTED]\2', 'g')"""


@query("scl32_redaction", f"SELECT doc_id, md5({_MASKED}) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(X.masked(F.col("text")).cast("binary")).alias("digest"))


@query("scl44_content_key", "SELECT substr(md5(text), 1, 12) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t("documents").groupBy(X.content_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("scl43_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("scl46_sentences", f"SELECT doc_id, len({_SENTENCES_OF('text')}) AS n, md5(array_to_string({_SENTENCES_OF('text')}, '|')) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(X.sentences(F.col("text")), "|")).alias("digest"))


@query("scl47_cosine", "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 4) AS similarity FROM embeddings, q")
def _(t: Tables) -> DataFrame:
    q = t("embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("e"))
    return t("embeddings").crossJoin(F.broadcast(q)).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("e")), 4).alias("similarity"))


@query("scl49_token_estimate", "SELECT doc_id, floor(length(text) / 4)::BIGINT AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_LINES = f"list_filter(list_transform(string_split(x, chr(10)), lambda l: {_STRIP_OF('l')}), lambda l: l <> '')"
_BEGINS = rf"""i > 1 AND (regexp_matches(l, '{K.SECTION}') OR (regexp_matches(ls[i - 1], '[.?!"”]$') AND NOT regexp_matches(ls[i - 1], '(?:i\.e\.|e\.g\.|approx\.)$') AND regexp_matches(l, '^[\p{{Lu}}0-9]')))"""
_PARAGRAPHS = rf"""p0 AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
p1 AS (SELECT doc_id, x, list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {_STRIP_OF('p')}), lambda p: {_WORDS_OF('p')} >= 8) AS blocks, {_LINES} AS ls FROM p0),
p2 AS (SELECT *, flatten(list_transform(blocks, lambda p: CASE WHEN length(p) > 800 THEN list_filter(list_transform(string_split(p, chr(10)), lambda q: {_STRIP_OF('q')}), lambda q: {_WORDS_OF('q')} >= 4) ELSE [p] END)) AS fine,
  string_split(array_to_string(list_transform(ls, lambda l, i: CASE WHEN {_BEGINS} THEN chr(1) ELSE ' ' END || l), ''), chr(1)) AS merged FROM p1),
p3 AS (SELECT doc_id, CASE WHEN len(fine) <= 5 OR coalesce(list_sum(list_transform(fine, lambda p: length(p))), 0) > 1200 * len(fine)
  THEN list_filter(list_transform(merged, lambda p: {_STRIP_OF('p')}), lambda p: {_WORDS_OF('p')} >= 8) ELSE fine END AS ps FROM p2),
p4 AS (SELECT doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) - 1 AS pos FROM p3),
p5 AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(paragraph, '{K.HEADER}') AND length(paragraph) < 120 THEN paragraph END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM p4),
p6 AS (SELECT doc_id, pos, coalesce(last_value(nullif(section, '') IGNORE NULLS) OVER w, '') AS section, array_to_string(list(paragraph) OVER w, chr(10) || chr(10)) AS body FROM p5 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"""
_BODY = "CASE WHEN section <> '' THEN '[' || section || ']' || chr(10) || body ELSE body END"
_CAPPED = f"CASE WHEN length(y) > 2000 THEN {_STRIP_OF("CASE WHEN contains(substr(y, 1, 2000), '.') THEN left(substr(y, 1, 2000), 2001 - instr(reverse(substr(y, 1, 2000)), '.')) ELSE substr(y, 1, 2001) END")} ELSE y END"
_CHUNKS = f"""{_PARAGRAPHS}, c1 AS (SELECT doc_id, pos, section, body, {_BODY} AS y FROM p6), c2 AS (SELECT *, {_CAPPED} AS z FROM c1),
c3 AS (SELECT doc_id, pos, section, CASE WHEN length(y) > 2000 THEN z ELSE body END AS parent, CASE WHEN len({_SENTENCES_OF('z')}) > 0 THEN {_SENTENCES_OF('z')} ELSE [z] END AS ss FROM c2),
c4 AS (SELECT doc_id, pos, section, parent, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS nth FROM c3),
c5 AS (SELECT *, CASE WHEN section <> '' AND NOT starts_with(s, '[') THEN '[' || section || '] ' || s ELSE s END AS content FROM c4)"""


@query("txt03_paragraphs", f"WITH {_PARAGRAPHS} SELECT doc_id, pos, md5(paragraph) AS digest FROM p4")
def _(t: Tables) -> DataFrame:
    return K.numbered(t("documents"), ["doc_id"], "text").select("doc_id", "pos", F.md5("paragraph").alias("digest"))


@query("win05_section_headers", f"WITH {_PARAGRAPHS} SELECT doc_id, pos, section FROM p5")
def _(t: Tables) -> DataFrame:
    return K.numbered(t("documents"), ["doc_id"], "text").select("doc_id", "pos", "section")


@query("win04_sliding_paragraphs", f"WITH {_PARAGRAPHS} SELECT doc_id, pos, md5(body) AS digest FROM p6")
def _(t: Tables) -> DataFrame:
    return K.windows(K.numbered(t("documents"), ["doc_id"], "text"), ["doc_id"]).select("doc_id", "pos", F.md5("body").alias("digest"))


@query("win06_window_section", f"WITH {_PARAGRAPHS} SELECT doc_id, pos, section FROM p6")
def _(t: Tables) -> DataFrame:
    return K.windows(K.numbered(t("documents"), ["doc_id"], "text"), ["doc_id"]).select("doc_id", "pos", "section")


@query("txt05_capped", f"WITH {_CHUNKS} SELECT doc_id, pos, length(z) AS n, md5(z) AS digest FROM c2")
def _(t: Tables) -> DataFrame:
    w = K.windows(K.numbered(t("documents"), ["doc_id"], "text"), ["doc_id"])
    z = K.capped(F.when(F.col("section") != "", F.concat(F.lit("["), "section", F.lit("]\n"), "body")).otherwise(F.col("body")))
    return w.select("doc_id", "pos", F.length(z).cast("long").alias("n"), F.md5(z).alias("digest"))


@query("txt04_sentence_chunks", f"WITH {_CHUNKS} SELECT doc_id, pos, nth, md5(content) AS content, md5(parent) AS parent FROM c5 QUALIFY row_number() OVER (PARTITION BY doc_id, content ORDER BY pos, nth) = 1")
def _(t: Tables) -> DataFrame:
    return K.chunks(t("documents"), ["doc_id"], "text").select("doc_id", "pos", "nth", F.md5("content").alias("content"), F.md5("parent").alias("parent"))


@query("ded03_chunk_dedup", "SELECT source, count(*) AS kept FROM (SELECT DISTINCT source, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    # the digest stands for the line, so whole lines aren't shuffled
    p = t("documents").select("source", F.explode(F.split("text", "\n")).alias("p")).select("source", F.sha2("p", 256).alias("h"))
    return p.distinct().groupBy("source").agg(F.count("*").alias("kept"))


@query("txt06_html_strip", r"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<(script|style|head|meta)[^>]*>.*?</(script|style|head|meta)>', ' ', 'g'), '<[^>]*>', ' ', 'g')) AS n FROM pages")
def _(t: Tables) -> DataFrame:
    bare = F.regexp_replace("html", r"(?is)<(script|style|head|meta)[^>]*>.*?</(script|style|head|meta)>", " ")
    return t("pages").select("page_id", F.length(F.regexp_replace(bare, "<[^>]*>", " ")).cast("long").alias("n"))


@query("txt07_tokens", f"SELECT doc_id, len({_TOKENS}) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))


_QUERIES = (TERMS, {"policy": 2.0, "this": 1.0, "from": 1.0, "was": 0.5})
_ALL = list(dict.fromkeys(t for q in _QUERIES for t in q))


def _bm25_sql(source: str = "documents", queries=(TERMS,)) -> str:
    names = list(dict.fromkeys(t for q in queries for t in q))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS t{i}" for i, x in enumerate(names))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(names)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) < 0 THEN 0.25 * mean ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    one = lambda q: " + ".join(f"{w} * {idf(names.index(x))} * t{names.index(x)} * 2.5 / (t{names.index(x)} + 1.5 * (0.25 + 0.75 * dl / av))" for x, w in q.items())
    return f"""k AS (SELECT doc_id, {_TOKENS} AS w FROM {source}), r AS (SELECT doc_id, len(w) AS dl, {tf} FROM k), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, {df} FROM r),
  o AS (SELECT x, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS x FROM k) GROUP BY 1), m AS (SELECT avg(ln(((SELECT n FROM s) - df + 0.5) / (df + 0.5))) AS mean FROM o), b AS (SELECT doc_id, greatest({", ".join(map(one, queries))}) AS score FROM r, s, m)"""


@query("txt08_bm25", f"WITH {_bm25_sql(queries=_QUERIES)} SELECT doc_id, round(score, 4) AS score FROM b WHERE score > 0")
def _(t: Tables) -> DataFrame:
    """The better of two queries, one for policies and one for evidence."""
    return V.bm25(t("documents"), _QUERIES, "doc_id", "text").select("doc_id", F.round("score", 4).alias("score"))


@query("txt09_term_counts", "SELECT doc_id, " + " + ".join(f"{w} * (length(t) - length(replace(t, '{x}', ''))) / {len(x)}" for x, w in TERMS.items()) + " AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(t: Tables) -> DataFrame:
    low, score = F.lower("text"), F.lit(0.0)
    for x, w in TERMS.items():
        score = score + w * (F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / len(x)
    return t("documents").select("doc_id", score.alias("score"))


_N = lambda words: " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in words)
_BOOST = f"(1 + 0.15::DOUBLE * ({_N(V.GOVERNING)}) - 0.10::DOUBLE * ({_N(V.EXPLAINING)}))"


@query("txt10_governance_boost", f"SELECT doc_id, round({_BOOST}, 2) AS boost FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.round(V.boost(F.col("text")), 2).alias("boost"))


# The chain from scores to a context: two rankings, candidates, duplicates, files, budget.

_JACCARD = "CASE WHEN len(list_distinct(x.w || y.w)) = 0 THEN 1.0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w))::DOUBLE END"
_CHAIN = f"""WITH {_bm25_sql(queries=_QUERIES)}, q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
h0 AS (SELECT d.doc_id, d.source AS file, coalesce(d.text, '') AS text, b.score * {_BOOST} AS keyword, (SELECT greatest(0, list_cosine_similarity(x.embedding::DOUBLE[], q.e::DOUBLE[])) FROM embeddings x, q WHERE x.vec_id = d.doc_id) AS vector FROM documents d JOIN b USING (doc_id)),
h AS (SELECT *, round(0.4::DOUBLE * CASE WHEN max(keyword) OVER () > 0 THEN keyword / max(keyword) OVER () ELSE 0 END + 0.6::DOUBLE * coalesce(vector, 0), 9) AS score FROM h0),
c0 AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM h), c AS (SELECT * EXCLUDE r FROM c0 WHERE r <= 40 AND (score > 0.05 OR (r <= 20 AND NOT EXISTS (SELECT 1 FROM h WHERE score > 0.05)))),
e AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ORDER BY score DESC, doc_id) = 1),
l AS (SELECT list([struct_pack(id := doc_id, w := list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda z: z <> '')))] ORDER BY score DESC, doc_id) AS xs FROM e),
u AS (SELECT e.* FROM e WHERE doc_id IN (SELECT unnest(list_transform(list_reduce(xs, lambda kept, one: CASE WHEN len(list_filter(kept, lambda y: list_any_value(list_transform(one, lambda x: {_JACCARD} >= 0.97)))) > 0 THEN kept ELSE kept || one END), lambda k: k.id)) FROM l)),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM u QUALIFY r <= 10),
f AS (SELECT h.*, 0 AS r FROM h WHERE score > 0.15 AND file NOT IN (SELECT file FROM t WHERE file IS NOT NULL) AND md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) NOT IN (SELECT md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FROM u) QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, doc_id) = 1),
g AS (SELECT * FROM (SELECT * FROM t UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (ORDER BY r, score DESC, doc_id) <= 10),
w AS (SELECT *, sum(length(text) // 4) OVER (ORDER BY score DESC, doc_id) AS run FROM g), x AS (SELECT *, max((run > 6000)::INT) OVER (ORDER BY score DESC, doc_id) AS stop FROM w),
z AS (SELECT * FROM x WHERE stop = 0 AND run - length(text) // 4 < 3000)
"""


def _hybrid(t: Tables) -> DataFrame:
    """(doc_id, file, digest, keyword, vector, score): scores travel without texts."""
    d = t("documents").select("doc_id", F.col("source").alias("file"), "text", V.boost(F.col("text")).alias("boost"), V.text_key(F.col("text")).alias("digest"))
    b = V.bm25(d, _QUERIES, "doc_id", "text", keep_all=True, carry=["file", "boost", "digest"])
    first = t("embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("e"))
    near = t("embeddings").crossJoin(F.broadcast(first)).select(F.col("vec_id").alias("doc_id"), F.greatest(F.lit(0.0), X.cosine(F.col("embedding"), F.col("e"))).alias("vector"))
    rows = b.select("doc_id", "file", "digest", (F.col("score") * F.col("boost")).alias("keyword")).join(near, "doc_id", "left")
    return V.hybrid(rows, []).withColumn("score", F.round("score", 9))


def _candidates(t: Tables) -> DataFrame:
    return _with_texts(t, V.distinct_texts(V.candidates(_hybrid(t), [], ["doc_id"]), [], ["doc_id"], "digest"))


def _with_texts(t: Tables, few: DataFrame) -> DataFrame:
    """Candidates, of which there are MOST at most, with their texts."""
    return t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")


_TEN = lambda df: df.select("doc_id", F.round("score", 4).alias("score"))


@query("txt13_hybrid", _CHAIN + "SELECT doc_id, round(score, 4) AS score FROM h")
def _(t: Tables) -> DataFrame:
    return _TEN(_hybrid(t))


@query("txt14_candidates", _CHAIN + "SELECT doc_id, round(score, 4) AS score FROM c")
def _(t: Tables) -> DataFrame:
    return _TEN(V.candidates(_hybrid(t), [], ["doc_id"]))


@query("txt16_unlike_candidates", _CHAIN + "SELECT doc_id, round(score, 4) AS score FROM u")
def _(t: Tables) -> DataFrame:
    return _TEN(V.unlike(_candidates(t), [], ["doc_id"], "text"))


@query("txt17_reranked", _CHAIN + "SELECT doc_id, round(0.3::DOUBLE * score + 0.7::DOUBLE * (length(text) % 100 / 100.0)::DOUBLE, 4) AS score FROM u")
def _(t: Tables) -> DataFrame:
    """The second model's scores are given as a column; here the length stands for them."""
    u = V.unlike(_candidates(t), [], ["doc_id"], "text").withColumn("model", F.length("text") % 100 / 100.0)
    return _TEN(V.reranked(u, "model"))


@query("txt18_file_diversity", _CHAIN + "SELECT doc_id, round(score, 4) AS score FROM g")
def _(t: Tables) -> DataFrame:
    every = written(_hybrid(t), "hybrid")  # it is read three times
    u = V.unlike(_with_texts(t, V.distinct_texts(V.candidates(every, [], ["doc_id"]), [], ["doc_id"], "digest")), [], ["doc_id"], "text")
    return _TEN(V.diverse(u, every, [], ["doc_id"], "file", "digest", 10))


@query("txt20_context_budget", _CHAIN + "SELECT doc_id, round(score, 4) AS score FROM z")
def _(t: Tables) -> DataFrame:
    every = written(_hybrid(t), "hybrid")  # it is read three times
    u = V.unlike(_with_texts(t, V.distinct_texts(V.candidates(every, [], ["doc_id"]), [], ["doc_id"], "digest")), [], ["doc_id"], "text")
    g = _with_texts(t, V.diverse(u, every, [], ["doc_id"], "file", "digest", 10))
    return _TEN(V.within_budget(g, [F.desc("score"), F.col("doc_id")], X.token_estimate(F.col("text")), 3000, 6000, []))


@query("txt11_nearest", "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[])), 4) AS similarity FROM embeddings, q ORDER BY greatest(0, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[])) DESC, vec_id LIMIT 40")
def _(t: Tables) -> DataFrame:
    first = t("embeddings").orderBy("vec_id").limit(1).collect()  # one query vector
    near = V.nearest(t("embeddings"), first[0]["embedding"] if first else [], "vec_id", "embedding", 40)
    return near.select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("txt15_exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(text)")
def _(t: Tables) -> DataFrame:
    key = F.sha2(F.trim("text"), 256)  # the digest is shuffled, not the text
    return t("documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("win08_token_budget", """WITH r AS (SELECT conv_id, turn, length(text) // 4 AS k, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations),
x AS (SELECT *, max((s > 120)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS stop FROM r) SELECT conv_id, turn FROM x WHERE stop = 0 AND s - k < 80""")
def _(t: Tables) -> DataFrame:
    c = t("conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("k"))
    return V.within_budget(c, [F.col("turn")], F.col("k"), 80, 120, ["conv_id"]).select("conv_id", "turn")


@query("jon19_duplicate_quotes", f"SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5({_NORMAL})) AS n, text FROM documents WHERE length(text) >= 15) WHERE n >= 2")
def _(t: Tables) -> DataFrame:
    d = t("documents").filter(F.length("text") >= 15).select("doc_id", F.md5(X.normal(F.col("text")).cast("binary")).alias("k"))
    groups = d.groupBy("k").agg(F.count("*").alias("n")).filter("n >= 2")  # combined before the shuffle, unlike a window
    return d.join(groups, "k").select("doc_id", "n")


_EXCERPTS = rf"list_filter(list_transform(list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda e: {_STRIP_OF('e')} <> ''), lambda e: regexp_replace({_STRIP_OF('e')}, '^[\s\x22\x27“”]+|[\s\x22\x27“”]+$', '', 'g')), lambda e: true)"
_GROUNDED = f"""e0 AS (SELECT item_id, {_EXCERPTS} AS es FROM benchmark), e1 AS (SELECT item_id, len(es) AS n, unnest(es) AS e FROM e0), e2 AS (SELECT item_id, n, {_NORMAL_OF('e')} AS q, {_ALNUM_OF('e')} AS a FROM e1 WHERE upper(e) <> 'NOT_FOUND'),
d AS (SELECT doc_id, {_NORMAL} AS t, {_ALNUM_OF('text')} AS a FROM documents),
g AS (SELECT item_id, n, doc_id, count(*) AS held FROM e2 JOIN d ON (q <> '' AND contains(t, q)) OR (e2.a <> '' AND contains(d.a, e2.a)) GROUP BY ALL)"""


@query("jon20_grounding", f"WITH {_GROUNDED} SELECT item_id, count(*) AS documents, min(doc_id) AS first FROM g WHERE held = n GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The documents that hold the whole of a quote."""
    held = V.grounded(t("documents"), t("benchmark"), "doc_id", "item_id", "text")
    return held.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.min("doc").alias("first"))


@query("val03_grounding_status", f"WITH {_GROUNDED} SELECT item_id, CASE WHEN max((held = n)::INT) = 1 THEN 'GROUNDED' WHEN count(held) > 0 THEN 'PARTIALLY_GROUNDED' ELSE 'NOT_GROUNDED' END AS status FROM benchmark LEFT JOIN g USING (item_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return V.best_grounding(t("documents"), t("benchmark"), "doc_id", "item_id", "text").withColumnRenamed("item", "item_id")


_ANY = lambda words: "(" + " OR ".join(f"contains(lower(s), '{w}')" for w in words) + ")"


@query("val04_unsupported_claims", rf"""WITH s0 AS (SELECT doc_id, list_transform(string_split(regexp_replace({_STRIP_OF('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP_OF('s')}) AS ss FROM documents),
s1 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS nth FROM s0), s2 AS (SELECT *, list_filter(string_split_regex(lower(s), '\s+'), lambda w: w <> '') AS w FROM s1 WHERE length(s) >= 20 AND {_ANY(V.CLAIMING)} AND NOT {_ANY(V.ABSENT)})
SELECT s2.doc_id, nth, md5(s) AS digest FROM s2 JOIN documents d ON d.doc_id = s2.doc_id + 1 WHERE len(w) >= 4 AND coalesce(d.text, '') <> ''
  AND len(list_filter(range(1, len(w) - 1), lambda i: contains(lower(d.text), w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) = 0""")
def _(t: Tables) -> DataFrame:
    """Each document's claims against the one after it."""
    d = t("documents").select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), "text")
    return V.unsupported(d, after, "doc_id", "text").select("doc_id", "nth", F.md5("sentence").alias("digest"))


_FIRST = "f AS (SELECT * FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))"


@query("flagship_evidence_ranking", f"WITH {_FIRST}, {_bm25_sql('f')} SELECT doc_id, round(score, 4) AS score FROM b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def flagship(t: Tables) -> DataFrame:
    """The ten best of the distinct documents for a query. Texts are met by their ids only."""
    d = t("documents")
    first = d.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    ranked = V.bm25(d.join(first, "doc_id", "left_semi"), TERMS, "doc_id", "text")
    return ranked.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 4).alias("score"))
