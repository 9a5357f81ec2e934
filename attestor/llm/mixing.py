"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Sources, in code point order and nulls last, weigh 5, 2, 1, repeating. They share the words of the whole table by
weight; no target exceeds `EPOCHS` times its source, and what is above is shared anew. This is a water level: with
sources sorted by limit / weight, those below the level stop at their limit, and a running sum finds the level.

A source takes as many complete epochs as its target holds; the rest goes to documents in the order of their keys
-ln(u) / w, u a hash of id and text and w the document's quality weight, until the prefix sum of sizes meets the budget. The
last document gives only the words that are left.

A source may hold most rows, so its keys are cut into buckets of about `ROWS` rows by a distribution function of the
keys; bucket totals are summed first, and rows are sorted only within their bucket. Rows with equal id and text have equal
keys: they are counted before they are sorted, so a group of copies is one row there, however large.

Null texts have size 0; an empty source takes nothing. Very long texts are counted whole. Null and repeated ids are kept
apart by their texts; of keys that tie, the lesser id and then the lesser digest comes first. Rows equal in id and text
share what their group takes: full ones first, then at most one in part. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import written

WEIGHTS, EPOCHS, ROWS, SEED = (5, 2, 1), 3, 5_000, 42
#: Quality weights of documents: the best class first.
CLASSES = (1.0, 0.8, 0.6)
#: A table of up to so many sources is broadcast.
BROADCAST = 10_000
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The number of runs of characters other than the six ASCII blanks."""
    inner = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def quality(size: Column, chars: Column) -> Column:
    """The weight of a document: texts of some length with words of usual length are best, scraps come last."""
    mean = chars / F.greatest(size, F.lit(1))
    good = (size >= 50) & mean.between(3, 12)
    return F.when(good, CLASSES[0]).when((size >= 10) & mean.between(2, 20), CLASSES[1]).otherwise(CLASSES[2])


def with_key(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """`docs` with _source (never null), _size, _digest (of the text) and _key."""
    size = words(F.col(text_col))
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = docs.withColumn("_digest", text)
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_digest", F.lit(str(SEED))))
    u = (F.conv(F.left(digest, F.lit(12)), 16, 10).cast("double") + 0.5) / float(16**12)
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("z"))  # null goes last
    docs = docs.withColumns({"_source": source, "_size": size, "_chars": F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    return docs.withColumn("_key", -F.log(u) / quality(F.col("_size"), F.col("_chars"))).drop("_chars")


def targets(rows: DataFrame) -> DataFrame:
    """(_source, source_size, n, target, epochs, budget, buckets): one row for each source of rows with _source, _size,
    _copies. All sources meet in one task: a row for each, and windows over them need no more than that."""
    s = rows.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("source_size"), F.count("*").alias("n"))
    everything = W.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy("_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", (EPOCHS * F.col("source_size")).cast("double"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("w"), "_source")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("passed", F.coalesce(F.sum("w").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.col("before")) / (F.col("all_w") - F.col("passed"))
    s = s.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    # the water level is that of the first source above it
    s = s.withColumn("water", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "_source", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("w")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(EPOCHS))).otherwise(0).cast("long")
    s = s.withColumn("epochs", epochs)
    s = s.withColumn("budget", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    s = s.withColumn("buckets", F.ceil(F.col("n") / ROWS).cast("long"))
    return s.select("_source", "source_size", "n", "target", "epochs", "budget", "buckets")


def _small(plan: DataFrame) -> DataFrame:
    """The table of sources, broadcast if it is small; a written table, so counting is cheap."""
    return F.broadcast(plan) if plan.count() <= BROADCAST else plan


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, _source, _key, _digest, size, copies, source_size, target, epochs, part) for every distinct id and text of a
    source, and the plan of the sources. `part` is what its copies take together beyond complete epochs."""
    rows = with_key(docs.select(F.col(id_col), F.col(source_col), F.col(text_col)), id_col, source_col, text_col)
    rows = rows.groupBy(id_col, "_source", "_digest", "_size", "_key").agg(F.count("*").alias("_copies"))
    rows = written(rows, "mix-rows")
    plan = written(targets(rows), "mix-plan")
    rows = rows.join(_small(plan), "_source")
    # the mean distribution function over the weight classes; no class alone can overfill a bucket by more than their number
    spread = F.lit(1.0)
    for w in CLASSES:
        spread = spread - F.exp(-F.lit(w) * F.col("_key")) / len(CLASSES)
    rows = rows.withColumn("_bucket", F.least(F.col("buckets") - 1, F.floor(spread * F.col("buckets"))))
    rows = rows.withColumn("_all", F.col("_size") * F.col("_copies"))
    totals = rows.groupBy("_source", "_bucket").agg(F.sum("_all").alias("_sum"))
    earlier = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    rows = rows.join(totals, ["_source", "_bucket"])
    inside = W.partitionBy("_source", "_bucket").orderBy("_key", id_col, "_digest").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_earlier") + F.coalesce(F.sum("_all").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_all"), F.col("budget") - start)).cast("long")
    return rows.select(
        id_col, "_source", "_key", "_digest", F.col("_size").alias("size"), F.col("_copies").alias("copies"), "source_size", "target", "epochs", part.alias("part")
    ), plan


def report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken) for every row of `docs`."""
    rows, _ = taken(docs, id_col, source_col, text_col)
    # copies are made in steps, so that no array has one element for each of them
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / ROWS)))
    rows = rows.withColumn("_step", steps)
    nth = F.explode(F.sequence(F.col("_step") * ROWS, F.least(F.col("copies"), (F.col("_step") + 1) * ROWS) - 1))
    own = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("_nth") * F.col("size")))
    return rows.withColumn("_nth", nth).select(id_col, "size", "source_size", "target", (F.col("epochs") * F.col("size") + own).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """`docs`, each row as often as the mix takes it. Selection is a cutoff of keys in each source, so texts aren't
    shuffled; the document that the budget ends in is taken if at least half of it is. Only rows at a cutoff are numbered,
    where several copies of one document may meet it."""
    rows, plan = taken(docs, id_col, source_col, text_col)
    whole_copies = F.floor(F.col("part") / F.col("size") + 0.5).cast("long")
    at = rows.filter("size > 0 AND 2 * part >= size")
    cutoff = at.groupBy("_source").agg(F.max(F.struct("_key", id_col, "_digest", whole_copies.alias("n"))).alias("_cut"))
    cutoff = cutoff.select("_source", F.col("_cut._key").alias("_cutoff"), F.col("_cut")[id_col].alias("_cut_id"), F.col("_cut._digest").alias("_cut_digest"), F.col("_cut.n").alias("_cut_n"))
    plan = written(plan.join(cutoff, "_source", "left").select("_source", "epochs", *cutoff.columns[1:]), "mix-cutoffs")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[F.col(c).alias(f"_{i}") for i, c in enumerate((id_col, source_col, text_col))])
    keyed = with_key(whole, "_0", "_1", "_2").join(_small(plan), "_source")
    own = F.struct("_key", "_0", "_digest")
    cut = F.struct(F.col("_cutoff").alias("_key"), F.col("_cut_id").alias("_0"), F.col("_cut_digest").alias("_digest"))
    place = F.when(F.col("_cutoff").isNull(), 1).when(own.eqNullSafe(cut), 0).when(own < cut, -1).otherwise(1)
    keyed = keyed.select("_doc", "_source", "epochs", "_cut_n", place.alias("_place"))
    sure = keyed.filter("_place <> 0").select("_doc", (F.col("epochs") + F.when(F.col("_place") < 0, 1).otherwise(0)).alias("_times"))
    # copies of the document at the cutoff: some of them are taken once more; a written table gives them steady numbers
    ties = written(keyed.filter("_place = 0").withColumn("_part", F.spark_partition_id()), "mix-ties")
    before = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = ties.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    counts = counts.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(W.partitionBy("_source", "_part").orderBy(F.lit(1)))
    ties = ties.join(counts, ["_source", "_part"]).select("_doc", "epochs", (number <= F.col("_cut_n")).cast("int").alias("_more"))
    both = sure.unionByName(ties.select("_doc", (F.col("epochs") + F.col("_more")).alias("_times")))
    repeated = both.select("_doc", F.col("_times").cast("int").alias("_times")).filter("_times > 0")
    return repeated.select("_doc", F.explode(F.sequence(F.lit(1), "_times"))).select("_doc.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS src, coalesce(text, '') AS t,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    md5(coalesce(text, '')) AS digest, ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':{SEED}'), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (
  SELECT doc_id, src, size, digest, -ln(u) / CASE WHEN size >= 50 AND length(t) / greatest(size, 1) BETWEEN 3 AND 12 THEN {CLASSES[0]}::DOUBLE
    WHEN size >= 10 AND length(t) / greatest(size, 1) BETWEEN 2 AND 20 THEN {CLASSES[1]}::DOUBLE ELSE {CLASSES[2]}::DOUBLE END AS key FROM d),
s AS (SELECT src, sum(size)::BIGINT AS source_size, (ARRAY[5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w FROM k GROUP BY src),
r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0) AS before, coalesce(sum(w) OVER b, 0) AS passed
  FROM s WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - before) / (all_w - passed) AS level FROM r),
m AS (SELECT *, cap <= level * w AS capped FROM l),
g AS (SELECT *, CASE WHEN capped THEN cap ELSE w * (SELECT level FROM m x WHERE NOT x.capped ORDER BY x.cap / x.w, x.src LIMIT 1) END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM g),
p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target::DOUBLE AS target, e.epochs, greatest(0, round(e.target)::BIGINT - e.epochs * e.source_size) AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.src ORDER BY k.key, k.doc_id NULLS FIRST, k.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN e USING (src))
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - start)))::BIGINT AS taken FROM p
"""
