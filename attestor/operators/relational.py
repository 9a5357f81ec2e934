"""DataFrame operators with the ordering rules that findings need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order given, by one aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    # min_by over a struct of orderings keeps map-side combination, which a row_number window doesn't have
    by = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def newest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Up to n rows for each key in the order given."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def fail_open(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition, or all rows if none does."""
    any_row = df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(any_row)).filter(condition | ~F.col("_any")).drop("_any")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def chunks(df: DataFrame, order: str, size: int, overlap: int, value: str, keys: Sequence[str]) -> DataFrame:
    """Rows of each key in windows of `size` that share `overlap` rows: (keys..., chunk, first, n, values)."""
    step = size - overlap
    at = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    df = df.withColumn("_at", at)
    # row i lies in the chunks that begin at i - size + 1 .. i; only starts that are multiples of the step exist
    low = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step)).cast("int")
    df = df.withColumn("chunk", F.explode(F.sequence(low, F.floor(F.col("_at") / step).cast("int"))))
    return df.groupBy(*keys, "chunk").agg(F.min("_at").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).cast("string").alias("v")))), lambda s: s["v"]), ",").alias("values"))
