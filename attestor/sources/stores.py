"""Tables that are written, replaced, merged and exchanged.

Writers leave a table as it was if they fail halfway, or can be run again with the same result. Null and empty tables are
written as tables without rows. Paths may be in any store that Spark writes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def without_nul(rows: DataFrame) -> DataFrame:
    """Text columns without the characters that databases refuse."""
    return rows.select(*[F.translate(c, "\0", "").alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])


def insert(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys aren't in the table yet, each key once: inserting them again adds nothing. The keys are read
    before rows are appended, so a table has one writer at a time."""
    spark, fresh = rows.sparkSession, without_nul(rows).dropDuplicates(list(keys))
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)


def replace_scope(rows: DataFrame, path: str, scope: Sequence[str], scopes: DataFrame | None = None) -> None:
    """Put rows in the place of those with the same scope (say file and report); other scopes stay untouched. Of `scopes`, if they
    are named, those without any new row are emptied: a document without chunks keeps no old ones. Running it again
    gives the same table. A table has one writer at a time."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)
    if scopes is None:
        return
    same = [rows[c].eqNullSafe(scopes[c]) for c in scope]
    jvm = spark.sparkContext._jvm
    names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for gone in scopes.select(*scope).distinct().join(rows.select(*scope).distinct(), same, "left_anti").toLocalIterator():
        folder = "/".join(names.getPartitionPathString(c, None if gone[c] is None else str(gone[c])) for c in scope)
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the newest by `order`, rows of `new` before those of `old` where it ties. It combines before the shuffle."""
    columns = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*columns).withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order, "_new")).alias("r"))
    return best.select("r.*")


def newest(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The table cut to its newest n rows."""
    return rows.orderBy(*order).limit(n)


def purged(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows that are no older than so many days."""
    return rows.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """A table with a header for spreadsheets; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def imported(known: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows of JSON files that aren't known by their keys, each once. Missing values in the files count as empty texts; a
    stored null doesn't match them. Keys meet as digests, so long texts aren't shuffled."""
    schema = known.schema
    rows = known.sparkSession.read.schema(schema).json(path).fillna("", subset=[f.name for f in schema if f.name in keys and f.dataType.simpleString() == "string"])
    key = lambda: F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return rows.withColumn("_k", key()).join(known.select(key().alias("_k")), "_k", "left_anti").dropDuplicates(["_k"]).drop("_k")


def knowledge(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of knowledge from JSON; without rows where there is no file, or none that can be read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free digest."""
    each = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(each), F.lit(0)).alias("mix"), F.coalesce(F.sum(F.pmod(each, F.lit(1 << 32))), F.lit(0)).alias("total"))


def copy_changed(tables: Mapping[str, DataFrame], target: str) -> list[str]:
    """Copy the tables that differ from their copies below `target`; returns their names."""
    changed = []
    for name, rows in tables.items():
        spark, path = rows.sparkSession, f"{target}/{name}"
        if not _exists(spark, path) or fingerprint(rows).first() != fingerprint(spark.read.parquet(path)).first():
            rows.write.mode("overwrite").parquet(path)
            changed.append(name)
    return changed


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
