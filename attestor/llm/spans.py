"""Positions of regular-expression matches with DataFrame functions alone.

Spark returns the matches of a pattern (`regexp_extract_all`) and the text between them (`split`), not their
positions. Zipping both gives, for every match, the gap before it; a running sum of gap and match lengths gives code
point positions. The scan is one projection over the text; only matches are shuffled, keyed by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Code points of context that go along with a match.
CONTEXT = 48

_OCCURRENCE = "array<struct<hit:string,gap:string,next:string>>"


@dataclass(frozen=True)
class Kind:
    """`pattern` must be linear-time on long texts. `guard` is false only for texts without a match.
    `valid` takes (hit, before, after) and says whether a match counts; `order` breaks ties of equal starts.
    `cut` turns a match into an array of (gap, hit) that joined give the match again; each hit then stands for itself."""

    name: str
    pattern: str
    order: int
    guard: Callable[[Column], Column]
    valid: Callable[[Column, Column, Column], Column]
    base: bool = True
    tag: str = ""
    cut: Callable[[Column], Column] | None = None


def occurrences(df: DataFrame, kinds: Sequence[Kind], text: str) -> DataFrame:
    """Adds `_occ_<name>` for each kind: the matches in order, each with the gaps around it; a text with n matches has
    n + 1 entries, the last without a match, and a text without any match has none."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    t = F.col(text)
    gaps = {k.name: F.when(k.guard(t), F.split(t, k.pattern, -1)).alias(f"_gap_{k.name}") for k in kinds}
    df = df.select(*keep, *gaps.values())
    hits = [
        F.when(F.size(f"_gap_{k.name}") > 1, F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).alias(f"_hit_{k.name}")
        for k in kinds
    ]
    df = df.select(*keep, *[F.col(f"_gap_{k.name}") for k in kinds], *hits)
    zipped = []
    for k in kinds:
        gap, hit = F.col(f"_gap_{k.name}"), F.col(f"_hit_{k.name}")
        z = F.arrays_zip(hit.alias("hit"), gap.alias("gap"), F.slice(gap, 2, 2**30).alias("next"))
        zipped.append(F.when(hit.isNotNull(), z.cast(_OCCURRENCE)).alias(f"_occ_{k.name}"))
    df = df.select(*keep, *zipped)
    for k in (k for k in kinds if k.cut):
        occ = f"_occ_{k.name}"
        pieces = df.withColumn(occ, F.flatten(F.transform(occ, _pieces(k.cut))))
        gaps = F.slice(F.transform(occ, lambda o: o["gap"]), 2, 2**30)
        df = pieces.withColumn(occ, F.zip_with(occ, gaps, lambda o, n: F.struct(o["hit"].alias("hit"), o["gap"].alias("gap"), n.alias("next"))))
    return df


def _pieces(cut: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The entries that stand for one."""

    def entry(gap: Column, hit: Column) -> Column:
        return F.struct(hit.alias("hit"), gap.alias("gap"))

    def of(o: Column) -> Column:
        own = F.transform(cut(o["hit"]), lambda p, j: entry(F.when(j == 0, F.concat(o["gap"], p["gap"])).otherwise(p["gap"]), p["hit"]))
        return F.when(o["hit"].isNull(), F.array(entry(o["gap"], o["hit"]))).otherwise(own)

    return of


def _context(occ: Column, o: Column, i: Column) -> tuple[Column, Column, Column]:
    """The match of entry i of `occ` (o) and the code points of the whole text before and after it. A match has one code
    point at least, so those of CONTEXT entries on either side are enough; they are only joined if the gap is too short."""

    def joined(first: Column, n: Column, entry: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.slice(occ, first, n), entry), "")

    n = F.least(i, F.lit(CONTEXT))
    hit, gap, follow = (lambda x: F.coalesce(x["hit"], F.lit(""))), o["gap"], F.coalesce(o["next"], F.lit(""))
    before = F.when(F.length(gap) >= CONTEXT, gap).otherwise(F.concat(joined(i - n + 1, n, lambda x: F.concat(x["gap"], hit(x))), gap))
    after = F.when(F.length(follow) >= CONTEXT, follow).otherwise(joined(i + 2, F.lit(CONTEXT), lambda x: F.concat(x["gap"], hit(x))))
    return o["hit"], F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT))


def found(df: DataFrame, kinds: Sequence[Kind], key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each valid match: key, keep..., kind, ord, start, end, hit, before, after, base. A row of `df` without
    any match gives one row whose kind is null, so no row is lost. Rows with one key are hash-partitioned together."""
    df = occurrences(df.select(key, *keep, text), kinds, text)

    def packed(k: Kind) -> Column:
        def one(o: Column, i: Column) -> Column:
            hit, before, after = _context(F.col(f"_occ_{k.name}"), o, i)
            return F.struct(
                F.lit(k.order).alias("ord"), i.alias("pos"), hit.alias("hit"),
                F.length(o["gap"]).alias("gap"), before.alias("before"), after.alias("after"),
            )

        none = F.array().cast("array<struct<ord:int,pos:int,hit:string,gap:int,before:string,after:string>>")
        full = F.filter(F.transform(F.col(f"_occ_{k.name}"), one), lambda x: x["hit"].isNotNull())
        return F.coalesce(full, none)

    parts = df.select(key, *keep, F.explode_outer(F.concat(*[packed(k) for k in kinds])).alias("_p"))
    parts = parts.select(key, *keep, "_p.*").repartition(key)
    long = F.col("gap").cast("long") + F.length("hit")
    end = F.sum(long).over(W.partitionBy(key, "ord").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    name = F.create_map(*[F.lit(x) for k in kinds for x in (k.order, k.name)])
    base = F.create_map(*[F.lit(x) for k in kinds for x in (k.order, k.base)])
    valid = F.lit(None).cast("boolean")
    for k in kinds:
        valid = F.when(F.col("ord") == k.order, k.valid(F.col("hit"), F.col("before"), F.col("after"))).otherwise(valid)
    # A failing match becomes a row without kind; it still stands for its document.
    parts = parts.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    return parts.select(
        key, *keep, F.when(F.col("_ok"), name[F.col("ord")]).alias("kind"), "ord", "start", "end", "hit", "before", "after",
        F.coalesce(F.col("_ok") & base[F.col("ord")], F.lit(False)).alias("base"),
    )


def joined(items: Column) -> Column:
    """`kind:start:end` of an array of structs that begin with start and ord, in that order."""
    return F.array_join(
        F.transform(F.array_sort(items), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(rows: DataFrame, key: str, doc: str, kinds: Sequence[Kind], extra: Sequence[Column] = ()) -> DataFrame:
    """Per row of the input: counts of base kinds, the digest of base spans and all spans as text."""
    item = F.struct("start", "ord", "end", "kind")
    some = F.col("kind").isNotNull()
    grouped = rows.groupBy(key, doc).agg(
        *[F.count_if((F.col("kind") == k.name) & F.col("base")).alias(f"n_{k.name}") for k in kinds if k.base],
        F.collect_list(F.when(F.col("base") & some, item)).alias("_base"),
        F.collect_list(F.when(some, item)).alias("_all"),
        *extra,
    )
    return grouped.select(
        doc, *[f"n_{k.name}" for k in kinds if k.base],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"),
        *[c for c in grouped.columns if c not in {key, doc, "_base", "_all"} and not c.startswith("n_")],
    )


def redacted(df: DataFrame, kinds: Sequence[Kind], text: str) -> DataFrame:
    """`df` with the valid matches of each kind replaced by its tag, kind after kind, without a shuffle."""
    columns = df.columns

    def piece(k: Kind) -> Callable[[Column], Column]:
        def of(o: Column, i: Column) -> Column:
            hit, before, after = _context(F.col(f"_occ_{k.name}"), o, i)
            sure = hit.isNotNull() & F.coalesce(k.valid(hit, before, after), F.lit(False))
            return F.concat(o["gap"], F.when(sure, F.lit(k.tag)).otherwise(F.coalesce(hit, F.lit(""))))

        return of

    for k in kinds:
        occ = F.col(f"_occ_{k.name}")
        new = F.when(occ.isNotNull(), F.array_join(F.transform(occ, piece(k)), "")).otherwise(F.col(text))
        df = occurrences(df, [k], text).select(*[new.alias(text) if c == text else F.col(f"`{c}`") for c in columns])
    return df
