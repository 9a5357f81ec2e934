"""Connected components of an edge table by contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Up to so many rows of vertices are broadcast.
BROADCAST = 500_000


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(v, root) for every vertex with an edge to another; root is the smallest vertex it is connected with.

    In each round a vertex points to the one that has the least hash among itself and its neighbours, and takes over where
    that one points to. Edges are then drawn between where their ends point to, and those within one vertex go, so the table
    shrinks by a constant factor a round whatever its shape: hashes differ from round to round, so long chains and stars
    fall together alike. Each round is a written table, which cuts lineage and survives executors."""
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    rest = written(edges.select(*pair(src, dst)).filter("a <> b").distinct(), "edges")
    of, rounds = rest.select(F.col("a").alias("v"), F.col("b").alias("at")).filter("false"), 0
    while not rest.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), F.col(c).alias("u"))  # noqa: B023, E731
        both = rest.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(rest.select(F.col("b").alias("v"), F.col("a").alias("u")))
        near = both.groupBy("v").agg(F.min(rank("u")).alias("m"))
        points = written(near.select("v", F.least(rank("v"), F.col("m"))["u"].alias("to")), "points")
        small = points.count() <= BROADCAST
        meets = lambda df: F.broadcast(df) if small else df  # noqa: B023, E731
        # what a vertex points to is a vertex, so the join keeps all rows
        step = written(points.join(meets(points.select(F.col("v").alias("to"), F.col("to").alias("far"))), "to").select("v", "far"), "step")
        end = lambda c, out: meets(step.select(F.col("v").alias(c), F.col("far").alias(out)))  # noqa: B023, E731
        of = written(_moved(of, end("at", "far")).unionByName(step.join(of.select("v"), "v", "left_anti").select("v", F.col("far").alias("at"))), "labels")
        ends = rest.join(end("a", "x"), "a").join(end("b", "y"), "b")
        rest = written(ends.filter("x <> y").select(*pair("x", "y")).distinct(), "edges")
        rounds += 1
    least = of.groupBy("at").agg(F.min("v").alias("root"))
    return of.join(least, "at").select("v", "root")


def _moved(of: DataFrame, step: DataFrame) -> DataFrame:
    """Labels after a step; those that no edge is left of stay."""
    moved: Column = F.coalesce("far", "at")
    return of.join(step, "at", "left").select("v", moved.alias("at"))
