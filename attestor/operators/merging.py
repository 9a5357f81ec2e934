"""Findings that a report lists in several tables, as one.

A report's tables name findings in full or cut short, with or without host and score. Rows are taken in the order of the report;
each joins an earlier finding of another table that agrees with it: same severity, scores and hosts that don't differ, and the
same title. If exactly one has the very title it is that one; otherwise, if none has it, exactly one whose title is the longer or
shorter form. What fits two findings joins neither.

Titles agree only if they share their first `CUT` characters, so rows meet in blocks of a report, a severity and the beginning
of a title; the order within a block is that of the report, which is all that the rule depends on. A block is one task's work and
lies within one report.

Null titles are empty, and empty ones agree with none; null hosts count as not named. Equal rows of one table stay apart. An
empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship

CUT = 20
FIELDS = "report {kind}, nth long, title string, severity string, score double, target string, remediation string, cves array<string>, evidence string, rows array<long>"


def plain_title(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "), F.lit(" .,;:"))


def agree(a: str, b: str) -> bool:
    """Equal titles, or one that is cut short after CUT characters or more."""
    return bool(a) and bool(b) and (a == b or (len(a) >= CUT and b.startswith(a)) or (len(b) >= CUT and a.startswith(b)))


def _fits(g: dict, f: dict) -> bool:
    scores = g["score"] is None or f["score"] is None or g["score"] == f["score"]
    return g["table"] != f["table"] and scores and (not g["target"] or not f["target"] or g["target"].lower() == f["target"].lower())


def fold(rows: list[dict]) -> list[dict]:
    """The findings of a block's rows, which are in the order of the report."""
    out: list[dict] = []
    for f in rows:
        near = [g for g in out if _fits(g, f)]
        exact = [g for g in near if g["plain"] == f["plain"] and f["plain"]]
        other = [g for g in near if agree(g["plain"], f["plain"])]
        into = exact[0] if len(exact) == 1 else other[0] if not exact and len(other) == 1 else None
        if into is None:
            out.append(f | {"rows": [f["nth"]], "cves": list(dict.fromkeys(f["cves"] or []))})
            continue
        if len(f["title"] or "") > len(into["title"] or ""):
            into |= {"title": f["title"], "plain": f["plain"]}
        for c in ("target", "remediation"):
            into[c] = into[c] or f[c]
        into["score"] = f["score"] if into["score"] is None else into["score"]
        into["cves"] = list(dict.fromkeys([*into["cves"], *(f["cves"] or [])]))
        into["evidence"] = "\n\n".join(x for x in (into["evidence"], (f["evidence"] or "").split("\n\n", 1)[-1]) if x)
        into["rows"].append(f["nth"])
    return out


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by their first `keys` columns, in tables that end where a block ends, and where their blocks begin.
    A block that lies across batches is put together."""
    begun: list[pa.Table] = []  # the block that the next batch may continue
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        beside = pa.concat_tables([begun[-1].slice(begun[-1].num_rows - 1), t]).combine_chunks() if begun else t
        differs = np.zeros(beside.num_rows - 1, bool)
        for c in beside.columns[:keys]:
            none = c.is_null().to_numpy()
            differs |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
        starts = np.flatnonzero(differs) + (0 if begun else 1)
        if len(starts):
            done = pa.concat_tables([*begun, t.slice(0, starts[-1])]).combine_chunks()
            yield done, np.concatenate(([0], starts[:-1] + sum(x.num_rows for x in begun)))
            begun, t = [], t.slice(starts[-1])
        begun.append(t)
    if begun:
        yield pa.concat_tables(begun).combine_chunks(), np.array([0])


def merged(findings: DataFrame) -> DataFrame:
    """One row for each finding of each report, with the numbers of its rows. Needed columns: report, nth (place in the report),
    table, title, severity, score, target, remediation, cves, evidence.

    Blocks come sorted to their task, many in a batch; only those with rows of two tables are folded in Python."""
    spark = findings.sparkSession
    bound_batches(spark, 4096)
    ship(spark)
    kind = findings.schema["report"].dataType.simpleString()
    names = ("report", "nth", "table", "title", "severity", "score", "target", "remediation", "cves", "evidence")
    rows = findings.select(*names, plain_title(F.col("title")).alias("plain")).withColumn("block", F.left("plain", F.lit(CUT)))
    rows = rows.withColumn("cves", F.array_distinct(F.coalesce("cves", F.array().cast("array<string>")))).withColumn("rows", F.array(F.col("nth").cast("long")))
    keep = [c.strip().split(" ")[0] for c in FIELDS.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _blocks(batches, 3):
            sizes = np.diff([*starts, t.num_rows])
            tables = t["table"].combine_chunks().dictionary_encode()
            tables = (tables.combine_chunks() if isinstance(tables, pa.ChunkedArray) else tables).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            several = np.minimum.reduceat(tables, starts) != np.maximum.reduceat(tables, starts)
            alone = t.filter(pa.array(np.repeat(~several, sizes))).select(keep)
            yield from alone.to_batches()
            mixed = t.filter(pa.array(np.repeat(several, sizes)))
            block, found = mixed.to_pylist(), []
            ends = np.cumsum(sizes[several]).tolist()
            for first, end in zip([0, *ends], ends):
                found += fold(block[first:end])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], alone.schema.field(c).type) for c in keep], schema=alone.schema)

    dealt = rows.filter("block <> ''").repartition("report", "severity", "block").sortWithinPartitions("report", "severity", "block", "nth")
    found = dealt.select("report", "severity", "block", *[c for c in (*names, "plain", "rows") if c not in ("report", "severity")]).mapInArrow(of, FIELDS.format(kind=kind))
    return found.unionByName(rows.filter("block = ''").select(keep))
