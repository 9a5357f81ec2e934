"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Files that a task writes at a time, and bytes of a group of rows, which each of them holds in memory.
OPEN_FILES, GROUP = 16, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, in whatever store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where it is unset and the master is
    local (tests). Executors elsewhere couldn't read a folder of this machine, so there it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        if not sc.master.startswith("local") and sc._jsc.sc().getCheckpointDir().isEmpty():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
        where = sc._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def written(df: DataFrame, label: str, folders: Sequence[str] = ()) -> DataFrame:
    """Cut lineage: write `df` as parquet in the shared folder, in folders by the values of columns if asked, and read it back.

    Unlike a local checkpoint the files outlive the executors that wrote them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestor/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if folders:
        # a task that holds a file of each folder open need not sort its rows, on disk if they are many; it does if folders are more
        key, writer = "spark.sql.maxConcurrentOutputFileWriters", df.write.partitionBy(*folders).options(compression="zstd", **{"parquet.block.size": GROUP, "parquet.enable.dictionary": False})
        before = spark.conf.get(key)
        spark.conf.set(key, str(OPEN_FILES))
        try:
            writer.parquet(path)
        finally:
            spark.conf.set(key, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that `written` has made for this application. Frames that read them are of no use afterwards, so
    call it once their results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/attestor/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small; a batch of long texts must fit a Python worker. Frames are lazy, so the bound
    has to stay in the session until they run: it only ever falls, and a lower one that the caller set is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless they import it from the same place as the driver."""
    here = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    sc = spark.sparkContext
    if any(p and Path(p).resolve() == ROOT for p in here) or getattr(sc, "_attestor_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="attestor-")) / "attestor.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "attestor").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._attestor_shipped = True
