"""Scope detection: which kinds of policy a document speaks of, and the controls that follow.

Kinds come from keywords, from likeness to descriptions of the kinds, and from words of master policies, which stand for
several kinds at once. A document without any kind has all of them. Keywords, descriptions, and controls of kinds are tables
of the caller; they are small and refused beyond `MOST` rows, as each document is compared with all of them in one pass.
Keywords of up to four characters count as whole words only, longer ones also inside words.

Null and empty texts have no keyword; documents without a vector are told by their words alone; repeated keywords and rows of
controls count once; rows with equal ids are one document. An empty table of documents gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MOST = 5_000
#: The least likeness, and the characters in which a master policy names itself.
LIKE, HEAD, SHORT = 0.645, 5000, 4


def _rows(df: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in df.select(*columns).distinct().limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows of {', '.join(columns)}")
    return sorted(r for r in rows if None not in r)


def _names(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words is in a lower-cased text."""
    whole = "|".join(re.escape(w) for w in words if len(w) <= SHORT)
    inside = [text.contains(w) for w in words if len(w) > SHORT]
    out = text.rlike(rf"(?<![a-z0-9_])(?:{whole})(?![a-z0-9_])") if whole else F.lit(False)
    for hit in inside:
        out = out | hit
    return out


def kinds(docs: DataFrame, signals: DataFrame, described: DataFrame | None = None, umbrella: Sequence[str] = (), expands_to: Sequence[str] = (), everything: Sequence[str] = ()) -> DataFrame:
    """(id, kind, why): kinds of each document (id, text, and vector where `described` is given). `signals` is (kind, keyword),
    `described` (kind, vector). `why` is the first reason in order: keyword, likeness, umbrella, or all."""
    low = F.lower(F.coalesce("text", F.lit("")))
    of: dict[str, list[str]] = {}
    for kind, word in _rows(signals, "kind", "keyword"):
        of.setdefault(kind, []).append(word.lower())
    why = [(low_hit, k, 1) for k, ws in of.items() for low_hit in [_names(F.col("low"), [w for w in ws if w])]]
    if described is not None:
        why += [(X.cosine(F.col("vector"), F.array(*map(F.lit, v))) >= LIKE, k, 2) for k, v in _rows(described, "kind", "vector")]
    head = F.left("low", F.lit(HEAD))
    master = F.lit(False)
    for w in umbrella:
        master = master | head.contains(w)
    why += [(F.col("master"), k, 3) for k in expands_to]
    rows = docs.withColumn("low", low).withColumn("master", master)
    found = F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"))) for hit, k, n in why]), lambda x: x.isNotNull()) if why else F.array().cast("array<struct<kind:string,n:int>>")
    every = sorted({*everything, *of, *expands_to})
    all_kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(4).alias("n")) for k in every]) if every else F.array().cast("array<struct<kind:string,n:int>>")
    rows = rows.select("id", found.alias("f"))
    out = rows.select("id", F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(all_kinds)).alias("x")).groupBy("id", "x.kind").agg(F.min("x.n").alias("n"))
    return out.select("id", "kind", F.element_at(F.array(*map(F.lit, ("keyword", "likeness", "umbrella", "all"))), F.col("n")).alias("why"))


def controls(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, control): controls of the kinds of each document, once each. `mapping` is (kind, control)."""
    few = F.broadcast(mapping.select("kind", "control").distinct()) if mapping.count() <= MOST else mapping.select("kind", "control").distinct()
    return found.select("id", "kind").join(few, "kind").select("id", "control").distinct()


CUSTOM = "struct<kind:string,keywords:array<string>,generated:array<string>>"


def custom(rows: DataFrame, control: str, settings: str, active: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, mapping) out of controls that auditors have added: `settings` is JSON with a kind and keywords, their own and generated
    ones. Without a kind, or with JSON that can't be read, a control belongs to General; blank keywords are left out; only rows with a true
    `active` column count, if one is named."""
    x = rows.filter(F.coalesce(F.col(active), F.lit(False))) if active else rows
    x = x.select(F.col(control).alias("control"), F.from_json(F.coalesce(F.col(settings), F.lit("{}")), CUSTOM).alias("s"))
    kind = F.coalesce(F.nullif(F.trim("s.kind"), F.lit("")), F.lit("General"))
    none = F.array().cast("array<string>")
    words = F.filter(F.transform(F.concat(F.coalesce("s.keywords", none), F.coalesce("s.generated", none)), lambda w: F.lower(F.trim(w))), lambda w: F.coalesce(w, F.lit("")) != "")
    signals = x.select(kind.alias("kind"), F.explode(words).alias("keyword")).distinct()
    return signals, x.filter(F.col("control").isNotNull()).select(kind.alias("kind"), "control").distinct()
