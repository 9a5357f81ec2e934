"""Evidence retrieval: BM25, vectors, hybrid scores, budgets."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..session import bound_batches, ship, written

#: Fixed values of the ranking function: saturation, length normalisation, and the floor of negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: A word as `X.tokens` has it, of a text in lower case; words that a task counts before it hands them on.
TOKEN, HELD = re.compile("[a-z0-9_-]{3,}"), 100_000
#: Words of the shingles by which quotes find their documents.
SHINGLE = 6
#: First words of runs that are told by a set of words; excerpts that are broadcast; excerpts of one or two words that meet every document.
ANCHORS, BROADCAST, LOOKED_UP = 5_000, 200_000, 500


def bm25(docs: DataFrame, terms: Mapping[str, float] | Sequence[Mapping[str, float]], id_col: str, text_col: str, keep_all: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carry..., score) for rows with one of the terms, or for all rows. `terms` are query words with their weights; of
    several queries the best score counts.

    A word that most rows have would weigh less than nothing; it gets EPSILON of the mean weight of all words instead. Rows
    are cut down to their length and the counts of the query's words, which is written and read twice; the vocabulary is a
    count that combines before the shuffle. Words are those of `X.tokens`, taken by one pattern a batch."""
    queries = [terms] if isinstance(terms, Mapping) else list(terms)
    names = list(dict.fromkeys(t for q in queries for t in q))
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(id_col, *carry, _counted(names)(low).alias("_n"))
    rows = rows.select(id_col, *carry, F.col("_n")[0].alias("_dl"), *[F.col("_n")[i + 1].alias(f"_tf{i}") for i in range(len(names))])
    rows = written(rows, "term-counts")
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(names))])
    seen = docs.select(low.alias("t")).mapInPandas(_vocabulary, "t string, df long").groupBy("t").agg(F.sum("df").alias("df"))
    weight = lambda n, df: F.log((n - df + 0.5) / (df + 0.5))
    # one row of statistics and one of the mean
    mean = seen.crossJoin(F.broadcast(stats.select("_n"))).agg(F.avg(weight(F.col("_n"), F.col("df"))).alias("_mean"))
    rows = rows.crossJoin(F.broadcast(stats.crossJoin(mean)))
    scores = []
    for q in queries:
        score = F.lit(0.0)
        for t, w in q.items():
            i = names.index(t)
            idf = weight(F.col("_n"), F.col(f"_df{i}"))
            idf = F.when(idf < 0, EPSILON * F.col("_mean")).otherwise(idf)
            tf = F.col(f"_tf{i}").cast("double")
            score = score + w * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
        scores.append(score)
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    out = rows.select(id_col, *carry, best.alias("score"))
    return out if keep_all else out.filter("score > 0")


def _counted(names: Sequence[str]):
    """array of the number of a text's words and how often it has each of `names`."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def counted(texts: pd.Series) -> pd.Series:
        found = map(Counter, map(TOKEN.findall, texts))
        return pd.Series([[c.total(), *[c[t] for t in names]] for c in found], index=texts.index, dtype=object)

    return counted


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(t, df): words with the number of texts that have them, added up over the texts of a task as long as they are few."""
    seen: Counter[str] = Counter()
    for b in batches:
        for text in b["t"]:
            seen.update(set(TOKEN.findall(text)))
            if len(seen) >= HELD:
                yield pd.DataFrame({"t": list(seen.keys()), "df": list(seen.values())})
                seen.clear()
    yield pd.DataFrame({"t": pd.Series(list(seen.keys()), dtype=object), "df": pd.Series(list(seen.values()), dtype="int64")})


def nearest(vectors: DataFrame, query: Sequence[float], id_col: str, vector_col: str, k: int) -> DataFrame:
    """(id, similarity) of the k rows nearest to one query vector, never below zero; an exact scan and a distributed top-k."""
    q = F.array(*[F.lit(float(v)) for v in query])
    near = vectors.select(id_col, F.greatest(F.lit(0.0), X.cosine(F.col(vector_col), q)).alias("similarity"))
    return near.orderBy(F.desc("similarity"), id_col).limit(k)


# Words that formal documents have, and those of texts that only explain; shares of the two rankings; the cut
# of candidates; how alike two chunks may be; the least score of a file that must be heard.
GOVERNING = (
    "effective date", "version", "approved by", "document owner", "review cycle", "revision history", "effective", "annual review",
    "implementation", "status: active", "status: approved", "policy statement",
)
EXPLAINING = ("is defined as", "refers to", "what is ", "definition of", "background and introduction", "general overview", "purpose of this document is to define")
WORD_SHARE, VECTOR_SHARE, CUT, MOST, SOME, ALIKE, HEARD = 0.4, 0.6, 0.05, 40, 20, 0.97, 0.15
RERANKED, KEPT = 0.7, 0.3


def boost(text: Column) -> Column:
    """What a chunk's score is multiplied by: more for formal documents, less for explanations."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return 1.0 + 0.15 * n(GOVERNING) - 0.10 * n(EXPLAINING)


def hybrid(rows: DataFrame, keys: Sequence[str], keyword: str = "keyword", vector: str | None = "vector") -> DataFrame:
    """`rows` with score: the keyword score as a share of the best of its query and the similarity (0 if a row has none).
    Without a query vector it is the keyword score."""
    if vector is None:
        return rows.withColumn("score", F.col(keyword))
    top = rows.groupBy(*keys).agg(F.max(keyword).alias("_top"))  # one row a query
    rows = rows.join(F.broadcast(top), list(keys)) if keys else rows.crossJoin(F.broadcast(top))
    share = F.when(F.col("_top") > 0, F.col(keyword) / F.col("_top")).otherwise(0.0)
    return rows.withColumn("score", WORD_SHARE * share + VECTOR_SHARE * F.coalesce(F.col(vector), F.lit(0.0))).drop("_top")


def _ranked(keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.row_number().over(W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("score"), *order))


def candidates(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The best MOST rows of each query above the cut, or the best SOME where none is. Limits on ranks are pushed below the
    shuffle, so a task sends no more than MOST rows of a query."""
    best = rows.withColumn("_r", _ranked(keys, order)).filter(F.col("_r") <= MOST)
    over = W.partitionBy(*(keys or [F.lit(1)]))
    best = best.withColumn("_any", F.max("score").over(over) > CUT)
    return best.filter((F.col("_any") & (F.col("score") > CUT)) | (~F.col("_any") & (F.col("_r") <= SOME))).drop("_r", "_any")


def text_key(text: Column) -> Column:
    """What rows with equal texts share; it stands for the text until few rows are left."""
    return F.md5(X.stripped(F.coalesce(text, F.lit(""))))


def distinct_texts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """The best of candidates with equal texts (`digest` is their `text_key`)."""
    over = W.partitionBy(*keys, digest).orderBy(F.desc("score"), *order)
    return rows.withColumn("_r", F.row_number().over(over)).filter("_r = 1").drop("_r")


def unlike(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, alike: float = ALIKE) -> DataFrame:
    """Candidates in order of score, but for those whose words nearly are those of a better one that stays. Candidates of a
    query are at most MOST, so they are compared within one array."""
    columns = rows.columns
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9_]+"), lambda w: w != ""))
    item = F.struct((-F.col("score")).alias("_o"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row"), words.alias("words"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    near = lambda x: lambda y: X.jaccard(x["words"], y["words"]) >= alike
    stay = F.aggregate("items", F.filter("items", lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, near(x)), kept).otherwise(F.concat(kept, F.array(x))))
    return lists.select(F.explode(stay).alias("x")).select("x.row.*")


def reranked(rows: DataFrame, model_score: str) -> DataFrame:
    """Scores of candidates mixed with those that a second model gave them."""
    return rows.withColumn("score", KEPT * F.col("score") + RERANKED * F.col(model_score))


def diverse(chosen: DataFrame, everything: DataFrame, keys: Sequence[str], order: Sequence[str], file: str, digest: str, k: int) -> DataFrame:
    """The best k of each query. A file that has none among them, but a row with a score above HEARD whose text isn't there,
    takes the place of the last ones with its best row."""
    top = chosen.withColumn("_r", _ranked(keys, order)).filter(F.col("_r") <= k)
    heard = top.select(*keys, file).distinct()
    texts = chosen.select(*keys, digest).distinct()
    rest = everything.filter(F.col("score") > HEARD).join(heard, [*keys, file], "left_anti")
    rest = rest.join(texts, [*keys, digest], "left_anti")
    best = F.row_number().over(W.partitionBy(*keys, file).orderBy(F.desc("score"), *order))
    rest = rest.withColumn("_b", best).filter("_b = 1").drop("_b").withColumn("_r", F.lit(0))
    columns = [c for c in chosen.columns if c in everything.columns]
    both = top.select(*columns, "_r").unionByName(rest.select(*columns, "_r"))
    place = F.row_number().over(W.partitionBy(*(keys or [F.lit(1)])).orderBy("_r", F.desc("score"), *order))
    return both.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p", "_r")


def within_budget(df: DataFrame, order: Sequence[Column], tokens: Column, target: int, hard: int, keys: Sequence[str]) -> DataFrame:
    """Rows in order until the target is reached or the hard limit would be passed."""
    w = W.partitionBy(*(keys or [F.lit(1)])).orderBy(*order)
    df = df.withColumn("_sum", F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_stop", F.coalesce(F.max(F.when(F.col("_sum") > hard, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return df.filter((F.col("_stop") == 0) & (F.col("_sum") - tokens < target)).drop("_sum", "_stop")


def _words(alphanumeric: Column) -> Column:
    return F.filter(F.split(alphanumeric, " "), lambda w: w != "")


def _excerpts(text: Column) -> Column:
    """Parts of a quote between blank lines, without quotation marks around them; array<struct<t, a>>: their normal form and
    their letters and digits. A part that says nothing has empty forms."""
    trimmed = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), X.stripped), lambda e: e != "")
    bare = F.transform(trimmed, lambda e: F.regexp_replace(e, r"^[\s\"'“”]+|[\s\"'“”]+$", ""))
    said = F.transform(bare, lambda e: F.when(F.upper(e) == "NOT_FOUND", "").otherwise(e))
    return F.transform(said, lambda e: F.struct(X.normal(e).alias("t"), X.alphanumeric(e).alias("a")))


def _held(e: Column, t: Column, a: Column) -> Column:
    return ((e["t"] != "") & t.contains(e["t"])) | ((e["a"] != "") & a.contains(e["a"]))


def grounding(quote: Column, document: Column) -> Column:
    """GROUNDED if every excerpt of a quote stands in the document, PARTIALLY_GROUNDED if some do, else NOT_GROUNDED."""
    e, t, a = _excerpts(quote), X.normal(document), X.alphanumeric(document)
    n = F.size(F.filter(e, lambda x: _held(x, t, a)))
    return F.when(n == 0, "NOT_GROUNDED").when(n < F.size(e), "PARTIALLY_GROUNDED").otherwise("GROUNDED")


def found_excerpts(docs: DataFrame, quotes: DataFrame, doc_id: str, item_id: str, text: str) -> DataFrame:
    """(row, item, excerpts, doc, held, copies): for each row of `quotes` (row numbers it) and each document that holds at
    least one of its excerpts, how many it holds, and how many rows are that document.

    An excerpt counts as held if its normal form, or else its letters and digits alone, stand in the document. The words of
    an excerpt but its first and last are whole words of a document that holds it, so the document has the run of up to
    SHINGLE of them: an equi-join on hashes of runs finds candidates, and only those are looked up. Where few words begin a
    run, only places of those words are hashed. Excerpts of one or two words meet every document if they are few, else those
    that share their first three characters. Repeated rows and repeated or null ids are kept apart; null texts count as empty."""
    items = quotes.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item"), _excerpts(F.col(text)).alias("e"))
    items = written(items.filter(F.size("e") > 0), "quotes")
    parts = items.select("row", F.posexplode("e").alias("nth", "x")).filter("x.t <> '' OR x.a <> ''").withColumn("w", _words(F.col("x.a")))
    run = F.slice("w", F.lit(2), F.greatest(F.lit(0), F.least(F.lit(SHINGLE), F.size("w") - 2)))
    parts = written(parts.select("row", "nth", "x", F.when(F.size("w") > 2, F.xxhash64(run)).alias("key"), F.get("w", F.lit(1)).alias("anchor"), F.size(run).alias("n")), "excerpts")
    keyed = parts.filter("key IS NOT NULL")
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]  # SHINGLE of them at most
    name = F.md5(F.concat_ws("\x01", F.col(doc_id).cast("string"), F.col(text)))
    found = []
    if sizes:
        anchors = [r["anchor"] for r in keyed.select("anchor").distinct().limit(ANCHORS + 1).collect()]
        begins = (lambda w: w.isin(*anchors)) if len(anchors) <= ANCHORS else (lambda w: F.lit(True))

        def hashes(w: Column) -> Column:
            at = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: begins(F.get(w, i - 1)))
            return F.flatten(F.transform(at, lambda i: F.array(*[F.when(i + m - 1 <= F.size(w), F.xxhash64(F.slice(w, i, F.lit(m)))) for m in sizes])))

        few = keyed.count() <= BROADCAST
        words = docs.select(name.alias("_d"), _words(X.alphanumeric(F.col(text))).alias("w")).filter(F.size("w") > 0)
        keys = words.select("_d", F.explode(F.array_distinct(X.let(F.col("w"), hashes))).alias("key"))
        meant = keyed.select("key", "row", "nth", "x")
        found.append(keys.join(F.broadcast(meant) if few else meant, "key").select("_d", "row", "nth", "x"))
    tiny = parts.filter("key IS NULL").select("row", "nth", "x")
    n = tiny.count()
    if n > LOOKED_UP:
        three = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3)))
        keys = docs.select(name.alias("_d"), F.explode(F.array_distinct(F.concat(three(X.normal(F.col(text))), three(X.alphanumeric(F.col(text)))))).alias("k"))
        own = tiny.withColumn("k", F.explode(F.array_distinct(F.array(F.left("x.t", F.lit(3)), F.left("x.a", F.lit(3)))))).filter(F.length("k") == 3)
        found.append(keys.join(own, "k").select("_d", "row", "nth", "x"))
        tiny = tiny.filter((F.length("x.t") < 3) | (F.length("x.a") < 3))
        n = tiny.count()
    if n:  # one or two words, or one or two characters
        found.append(docs.select(name.alias("_d"), F.col(text)).join(F.broadcast(tiny) if n <= BROADCAST else tiny, _held(F.col("x"), X.normal(F.col(text)), X.alphanumeric(F.col(text)))).select("_d", "row", "nth", "x"))
    if not found:
        found.append(parts.select(F.lit("").alias("_d"), "row", "nth", "x").filter("false"))
    # written, so that its size decides whether the texts are shuffled to meet it
    pairs = reduce(DataFrame.unionByName, found).dropDuplicates(["_d", "row", "nth"])
    pairs = written(pairs, "grounding")
    whole = docs.select(name.alias("_d"), F.col(doc_id).alias("doc"), F.col(text).alias("_text")).join(pairs, "_d")
    long = whole.filter(_held(F.col("x"), X.normal(F.col("_text")), X.alphanumeric(F.col("_text"))))
    held = long.groupBy("row", "_d", "doc").agg(F.countDistinct("nth").alias("held"), F.count("*").alias("n"))
    held = held.withColumn("copies", (F.col("n") / F.col("held")).cast("int"))
    return held.join(items.select("row", "item", F.size("e").alias("excerpts")), "row").select("row", "item", "excerpts", "doc", "held", "copies")


def grounded(docs: DataFrame, quotes: DataFrame, doc_id: str, item_id: str, text: str) -> DataFrame:
    """(item, doc) for each row of `quotes` and each row of `docs` that holds every excerpt of it."""
    whole = found_excerpts(docs, quotes, doc_id, item_id, text).filter("held = excerpts")
    return whole.select("item", "doc", F.explode(F.sequence(F.lit(1), "copies"))).select("item", "doc")


def best_grounding(docs: DataFrame, quotes: DataFrame, doc_id: str, item_id: str, text: str) -> DataFrame:
    """(item, status) for each row of `quotes`: the best that any one document gives it."""
    found = found_excerpts(docs, quotes, doc_id, item_id, text)
    best = found.groupBy("row").agg(F.first("item").alias("item"), F.bool_or(F.col("held") == F.col("excerpts")).alias("whole"))
    some = best.select("item", F.when(F.col("whole"), "GROUNDED").otherwise("PARTIALLY_GROUNDED").alias("status"))
    # rows without any document are told by what is left of the count of rows of each item
    counts = quotes.groupBy(F.col(item_id).alias("item")).agg(F.count("*").alias("n"))
    hits = some.groupBy(F.col("item").alias("_i")).agg(F.count("*").alias("h"))
    left = counts.join(hits, F.col("item").eqNullSafe(F.col("_i")), "left").withColumn("left", F.col("n") - F.coalesce("h", F.lit(0))).filter("left > 0")
    none = left.select("item", F.explode(F.array_repeat(F.lit("NOT_GROUNDED"), F.col("left").cast("int"))).alias("status"))
    return some.unionAll(none)


# Verbs of sentences that claim something of a document, and words of sentences that say what isn't there.
CLAIMING = ("mentions", "contains", "outlines", "states", "describes", "includes", "provides", "defines", "details")
ABSENT = (
    "not found", "not evidenced", "not provided", "not documented", "does not contain", "does not include", "does not specify", "no evidence",
    "no documented", "could not be found", "was not located", "absent from",
)


def claims(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, nth, sentence, windows): the sentences that claim something, with their windows of three words in lower case."""
    parts = F.transform(F.split(X.stripped(F.col(text_col)), r"(?<=[.!?])\s+"), X.stripped)
    rows = texts.select(F.col(id_col), F.posexplode(parts).alias("nth", "sentence"))
    low = F.lower("sentence")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    rows = rows.filter((F.length("sentence") >= 20) & has(CLAIMING) & ~has(ABSENT)).withColumn("w", words).filter("size(w) >= 4")
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))
    return rows.select(id_col, "nth", "sentence", F.array_distinct(windows).alias("windows"))


def unsupported(reasoning: DataFrame, documents: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, nth, sentence): claims of a reasoning of which no window of three words stands in its document (of equal key)."""
    d = documents.select(F.col(key).alias("_k"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    rows = claims(reasoning, key, text_col).join(d, F.col(key) == F.col("_k"))
    return rows.filter(~F.exists("windows", lambda w: F.col("_t").contains(w)) & (F.col("_t") != "")).select(key, "nth", "sentence")
